"""The relational core: projection, predicates, joins, aggregation, windows, sorting, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import compat
from quillon.plans.registry import expose, load, query, sql_query

# Harness queries ------------------------------------------------------------------------------
sql_query("harness_q1", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-12-01' GROUP BY l_returnflag, l_linestatus",
          "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-12-01' GROUP BY l_returnflag, l_linestatus")
sql_query("harness_q3", "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_mktsegment = 'BUILDING' GROUP BY l_orderkey")
sql_query("harness_q6", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP_NTZ '1994-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
          "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql_query("harness_q10", "SELECT c_custkey, c_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name")

# Projection, filters, predicates, expressions --------------------------------------------------
sql_query("project_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
sql_query("project_expr_alias", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
sql_query("subquery_alias", "SELECT t.k, t.total FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) AS t WHERE t.total > 100000")
sql_query("filter_simple", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
sql_query("filter_conjunction", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT * FROM lineitem WHERE l_quantity > 10) AS t WHERE l_discount >= 0.05 AND l_returnflag = 'R'")
sql_query("having_filter", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
sql_query("pred_comparison", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
sql_query("pred_boolean", "SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND NOT c_nationkey = 3")
sql_query("pred_null_checks", "SELECT o.o_orderkey, l.l_orderkey IS NULL AS missing, l.l_orderkey IS NOT NULL AS present FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o.o_orderkey = l.l_orderkey")
sql_query("pred_between", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05")
sql_query("pred_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
sql_query("pred_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%STEEL%' OR p_name LIKE '_a%'")
sql_query("pred_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%'")
sql_query("pred_regex", "SELECT c_custkey FROM customer WHERE regexp_like(c_name, '[0-9]*[13579]$')", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-9]*[13579]$')")
sql_query("expr_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS tier, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
sql_query("pred_distinct_from", "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM nullif(o_orderpriority, '1-URGENT') AS differs, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM CAST(NULL AS STRING) AS same FROM orders",
          "SELECT o_orderkey, nullif(o_orderstatus, 'F') IS DISTINCT FROM nullif(o_orderpriority, '1-URGENT') AS differs, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM CAST(NULL AS VARCHAR) AS same FROM orders")
sql_query("expr_concat_op", "SELECT c_custkey, c_name || '-' || c_mktsegment AS tag FROM customer")
sql_query("expr_arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, p_retailprice / 4 AS d, p_size % 7 AS e, -p_size AS f, (p_size + 2) * 3 AS g FROM part")
sql_query("expr_cast", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) IN (0, 1) AS near, CAST(o_orderkey AS STRING) AS s, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS DOUBLE) AS x FROM orders",
          "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) IN (0, 1) AS near, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderdate AS DATE) AS d, CAST(o_custkey AS DOUBLE) AS x FROM orders")
sql_query("expr_try_cast", "SELECT p_partkey, try_cast(substring(p_brand, 7, 2) AS INT) AS n, try_cast(p_name AS INT) AS none FROM part", "SELECT p_partkey, try_cast(substring(p_brand, 7, 2) AS INTEGER) AS n, try_cast(p_name AS INTEGER) AS none FROM part")
sql_query("subquery_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql_query("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
sql_query("subquery_exists", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
sql_query("subquery_correlated", "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("cte_basic", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey")
sql_query("recursive_cte_all", "WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 10) SELECT n_nationkey, i FROM nation JOIN s ON n_nationkey = i")

_GRAPH = "SELECT n_nationkey AS a, (n_nationkey * 7 + n_regionkey) % 25 AS b FROM nation"


@query(f"WITH RECURSIVE e AS ({_GRAPH}), r(node) AS (SELECT 0 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r")
def recursive_cte_distinct(spark, sf_dir):
    """Nodes reachable from 0: UNION (distinct) recursion, which may run in cycles."""
    expose(spark, sf_dir, "nation")
    edges = spark.sql(_GRAPH)
    start = spark.createDataFrame([(0,)], "node int")
    return compat.recursive_distinct(start, lambda found: found.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def param_binding(spark, sf_dir):
    expose(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 250000, "status": "O"})


# Joins ------------------------------------------------------------------------------------------
sql_query("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey")
sql_query("join_left", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45")
sql_query("join_right", "SELECT l.l_partkey, o.o_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity > 49) l RIGHT JOIN orders o ON l.l_orderkey = o.o_orderkey")
sql_query("join_full", "SELECT a.o_orderkey AS k1, b.o_orderkey AS k2 FROM (SELECT * FROM orders WHERE o_totalprice > 150000) a FULL OUTER JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') b ON a.o_orderkey = b.o_orderkey")
sql_query("join_semi", "SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 48", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey AND l_quantity > 48)")
sql_query("join_anti", "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
sql_query("join_equi_theta", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_extendedprice * 10 > o_totalprice")
sql_query("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
sql_query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_comma", "SELECT s_name, n_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'")
sql_query("join_nway", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql_query("join_self_collision", "SELECT a.c_name AS name, b.c_name AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
sql_query("join_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, count(*) AS a FROM nation GROUP BY n_regionkey) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
sql_query("join_natural", "SELECT n_nationkey, a, b FROM (SELECT n_nationkey, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS b FROM supplier GROUP BY s_nationkey) y")
for _hint in ("BROADCAST", "MERGE", "SHUFFLE_HASH"):
    sql_query(f"join_hint_{_hint.lower()}", f"SELECT /*+ {_hint}(n) */ c_custkey, n_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey", "SELECT c_custkey, n_name FROM customer c JOIN nation n ON c_nationkey = n_nationkey")

# Aggregation ------------------------------------------------------------------------------------
sql_query("agg_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("agg_global", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem")
sql_query("agg_basic", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority")
sql_query("agg_stats", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(variance(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment")
sql_query("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql_query("agg_array_agg", "SELECT n_regionkey, array_join(sort_array(array_agg(n_nationkey)), ',') AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_nationkey)), ',') AS ks FROM nation GROUP BY n_regionkey")
sql_query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag")
sql_query("agg_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus")
_SETS = "c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping(c_mktsegment) AS INT) AS g1, CAST(grouping(c_nationkey) AS INT) AS g2 FROM customer GROUP BY"
sql_query("agg_rollup", f"SELECT {_SETS} ROLLUP (c_mktsegment, c_nationkey)")
sql_query("agg_cube", f"SELECT {_SETS} CUBE (c_mktsegment, c_nationkey)")
sql_query("agg_grouping_sets", f"SELECT {_SETS} GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql_query("window_total", "SELECT n_nationkey, count(*) OVER () AS total FROM nation")
sql_query("agg_approx_distinct", "SELECT l_returnflag, abs(approx_count_distinct(l_partkey, 0.01) - count(DISTINCT l_partkey)) <= 0.05 * count(DISTINCT l_partkey) AS close FROM lineitem GROUP BY l_returnflag",
          "SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag")
sql_query("agg_median", "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m FROM customer GROUP BY c_mktsegment")
sql_query("agg_percentile", "SELECT o_orderpriority, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p50 FROM orders GROUP BY o_orderpriority")
sql_query("agg_corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs FROM lineitem GROUP BY l_returnflag")
sql_query("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_orderstatus = 'P') AS any_one FROM orders GROUP BY o_custkey")
sql_query("agg_bit", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM nation GROUP BY n_regionkey")
sql_query("agg_regr", "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept, regr_count(l_extendedprice, l_quantity) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay FROM lineitem GROUP BY l_linestatus")
sql_query("agg_var_pop_samp", "SELECT p_brand, round(var_pop(p_retailprice), 4) AS vp, round(var_samp(p_retailprice), 4) AS vs, round(stddev_pop(p_retailprice), 4) AS sp, round(stddev_samp(p_retailprice), 4) AS ss FROM part GROUP BY p_brand")

# Windows ----------------------------------------------------------------------------------------
_BY = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"
sql_query("window_row_number", f"SELECT o_orderkey, row_number() {_BY} AS rn FROM orders")
sql_query("window_nulls_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'O') ASC NULLS LAST, o_orderkey) AS last, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'O') DESC NULLS FIRST, o_orderkey) AS first FROM orders")
sql_query("window_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r FROM customer")
sql_query("window_dense_rank", "SELECT c_custkey, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r FROM customer")
sql_query("window_percent_rank", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS r FROM customer")
sql_query("window_cume_dist", "SELECT c_custkey, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey), 9) AS r FROM customer")
sql_query("window_ntile", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS q FROM orders")
sql_query("window_lead_lag", f"SELECT o_orderkey, lag(o_totalprice, 1) {_BY} AS before, lead(o_totalprice, 2, 0.0) {_BY} AS after FROM orders")
_WHOLE = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
sql_query("window_first_last", f"SELECT o_orderkey, first_value(o_orderkey) {_WHOLE} AS f, last_value(o_orderkey) {_WHOLE} AS l FROM orders")
sql_query("window_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 2) {_WHOLE} AS second FROM orders")
sql_query("window_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS mean FROM orders")
sql_query("window_rows_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
sql_query("window_range_frame", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM customer")
sql_query("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n FROM events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM customer")
def window_groups_frame(spark, sf_dir):
    """GROUPS frame: a RANGE frame over the dense rank of the order."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return compat.groups_frame(rows, ["c_mktsegment"], ["c_nationkey"], 1, 1, F.count(F.lit(1)), "n").select("c_custkey", "n")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def window_qualify(spark, sf_dir):
    expose(spark, sf_dir, "orders")
    return spark.sql(compat.rewrite_sql("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"))


# Sorting, limits, distinct, sets ------------------------------------------------------------------
sql_query("sort_multi_key", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS FIRST, c_custkey")
sql_query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("limit_basic", "SELECT * FROM (SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 7) t")
sql_query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
sql_query("limit_expr", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 + 5")
sql_query("distinct_all", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    expose(spark, sf_dir, "orders")
    return spark.sql(compat.rewrite_sql("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey"))


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql_query(_name, f"{_A} {_op} {_B}")
sql_query("events_tumbling", "SELECT window.start AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY window(ts, '1 hour'), event_type",
          "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2")

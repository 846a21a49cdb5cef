"""Scalar functions, one query a family, with the semantics users of federated SQL expect."""

from __future__ import annotations

from quillon.functions import compat
from quillon.plans.registry import expose, query, sql_query

sql_query("fn_null_handling", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, nullif(o_orderstatus, 'O') AS b, ifnull(nullif(o_orderstatus, 'F'), 'x') AS c, nvl(nullif(o_orderstatus, 'P'), 'y') AS d, nvl2(nullif(o_orderstatus, 'F'), 1, 0) AS e FROM orders",
          "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, nullif(o_orderstatus, 'O') AS b, ifnull(nullif(o_orderstatus, 'F'), 'x') AS c, coalesce(nullif(o_orderstatus, 'P'), 'y') AS d, CASE WHEN nullif(o_orderstatus, 'F') IS NOT NULL THEN 1 ELSE 0 END AS e FROM orders")
sql_query("fn_conditional", "SELECT c_custkey, if(c_acctbal > 0, 'pos', 'neg') AS sign, greatest(c_custkey, c_nationkey, 10) AS g, least(c_custkey, c_nationkey, 10) AS l, if(c_nationkey = 3, 1, 0) AS three FROM customer",
          "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END AS sign, greatest(c_custkey, c_nationkey, 10) AS g, least(c_custkey, c_nationkey, 10) AS l, CASE WHEN c_nationkey = 3 THEN 1 ELSE 0 END AS three FROM customer")
sql_query("fn_string_case_trim", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, reverse(p_name) AS r, initcap(lower(p_brand)) AS i, length(p_name) AS n, octet_length(p_name) AS o, ascii(p_name) AS a FROM part",
          "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, trim('  ' || p_name || ' ') AS t, ltrim('  ' || p_name) AS lt, rtrim(p_name || '  ') AS rt, reverse(p_name) AS r, upper(p_brand[1]) || lower(p_brand[2:]) AS i, length(p_name) AS n, strlen(p_name) AS o, ascii(p_name) AS a FROM part")
sql_query("fn_string_substr", "SELECT c_custkey, substr(c_name, 1, 8) AS a, substring(c_name, 10) AS b, left(c_name, 3) AS l, right(c_name, 3) AS r, substring_index(c_name, '#', 1) AS s FROM customer",
          "SELECT c_custkey, substr(c_name, 1, 8) AS a, substring(c_name, 10) AS b, left(c_name, 3) AS l, right(c_name, 3) AS r, split_part(c_name, '#', 1) AS s FROM customer")


@query("SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, repeat('ab', 2) AS c FROM customer")
def fn_string_concat(spark, sf_dir):
    """concat skips nulls."""
    expose(spark, sf_dir, "customer")
    return spark.sql(compat.rewrite_sql("SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, repeat('ab', 2) AS c FROM customer"))


@query("SELECT c_custkey, strpos(c_name, '#') AS a, position('00' IN c_name) AS b, contains(c_name, '7') AS c, starts_with(c_name, 'Cust') AS d, ends_with(c_name, '1') AS e FROM customer")
def fn_string_position(spark, sf_dir):
    expose(spark, sf_dir, "customer")
    return spark.sql(compat.rewrite_sql("SELECT c_custkey, strpos(c_name, '#') AS a, position('00' IN c_name) AS b, contains(c_name, '7') AS c, startswith(c_name, 'Cust') AS d, endswith(c_name, '1') AS e FROM customer"))


sql_query("fn_regexp", "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*') AS a, regexp_like(p_type, '^[A-M]') AS b, regexp_count(p_type, '[A-Z]+') AS c, regexp_extract(p_type, '([A-Z]+)$', 1) AS d FROM part",
          "SELECT p_partkey, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS a, regexp_matches(p_type, '^[A-M]') AS b, len(regexp_extract_all(p_type, '[A-Z]+')) AS c, regexp_extract(p_type, '([A-Z]+)$', 1) AS d FROM part")
sql_query("fn_math_round", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS DOUBLE) AS b, CAST(floor(c_acctbal) AS DOUBLE) AS c, round(c_acctbal, 1) AS d, mod(c_custkey, 7) AS e, CAST(sign(c_acctbal) AS INT) AS f FROM customer",
          "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS DOUBLE) AS b, CAST(floor(c_acctbal) AS DOUBLE) AS c, round(c_acctbal, 1) AS d, c_custkey % 7 AS e, CAST(sign(c_acctbal) AS INTEGER) AS f FROM customer")


@query("SELECT c_custkey, trunc(c_acctbal) AS t FROM customer")
def fn_math_trunc(spark, sf_dir):
    """Numeric trunc rounds towards zero."""
    expose(spark, sf_dir, "customer")
    return spark.sql(compat.rewrite_sql("SELECT c_custkey, trunc(c_acctbal) AS t FROM customer"))


@query("SELECT p_partkey, round(sqrt(p_size), 9) AS a, round(power(p_size, 2), 3) AS b, round(exp(p_size / 50.0), 9) AS c, round(ln(p_size + 1), 9) AS d, round(log(p_size + 1), 9) AS e, round(log2(p_size + 1), 9) AS f, round(sin(p_size), 9) AS g, round(cos(p_size), 9) AS h, round(tan(p_size), 6) AS i, round(atan2(p_size, 3), 9) AS j, round(cbrt(p_size), 9) AS k, round(degrees(p_size), 6) AS l, round(radians(p_size), 9) AS m, round(pi(), 9) AS n FROM part")
def fn_math_transcendental(spark, sf_dir):
    """log with one argument is to base 10."""
    expose(spark, sf_dir, "part")
    return spark.sql(compat.rewrite_sql("SELECT p_partkey, round(sqrt(p_size), 9) AS a, round(power(p_size, 2), 3) AS b, round(exp(p_size / 50.0), 9) AS c, round(ln(p_size + 1), 9) AS d, round(log(p_size + 1), 9) AS e, round(log2(p_size + 1), 9) AS f, round(sin(p_size), 9) AS g, round(cos(p_size), 9) AS h, round(tan(p_size), 6) AS i, round(atan2(p_size, 3), 9) AS j, round(cbrt(p_size), 9) AS k, round(degrees(p_size), 6) AS l, round(radians(p_size), 9) AS m, round(pi(), 9) AS n FROM part"))


sql_query("fn_date_extract", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(date_part('day', o_orderdate) AS BIGINT) AS d, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q FROM orders")
sql_query("fn_date_parse", "SELECT o_orderkey, to_date(date_format(o_orderdate, 'yyyy-MM-dd'), 'yyyy-MM-dd') AS d, CAST(to_timestamp(date_format(o_orderdate, 'yyyy/MM/dd'), 'yyyy/MM/dd') AS TIMESTAMP_NTZ) AS t, make_date(2024, 2, 29) AS m FROM orders",
          "SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS DATE) AS d, strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d') AS t, make_date(2024, 2, 29) AS m FROM orders")
sql_query("fn_date_format", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS ym, date_format(o_orderdate, 'dd.MM.yyyy HH:mm') AS f FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS f FROM orders")
sql_query("fn_epoch", "SELECT event_id, unix_timestamp(ts) AS e, CAST(timestamp_seconds(event_id) AS TIMESTAMP_NTZ) AS t FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e, TIMESTAMP '1970-01-01' + to_seconds(event_id) AS t FROM events")
sql_query("fn_date_trunc", "SELECT event_id, date_trunc('day', ts) AS d, date_trunc('month', ts) AS m, date_trunc('hour', ts) AS h FROM events", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, date_trunc('hour', ts) AS h FROM events")
sql_query("fn_date_bin", "SELECT event_id, CAST(timestamp_seconds(unix_timestamp(ts) - unix_timestamp(ts) % 900) AS TIMESTAMP_NTZ) AS b FROM events", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events")
sql_query("fn_array_ops", "SELECT vec_id, size(embedding) AS n, round(array_max(embedding), 5) AS hi, round(array_min(embedding), 5) AS lo, array_contains(array(label, 3), 3) AS has, array_position(array(7, label, 3), 3) AS pos, array_join(sort_array(array(label, 3, 9)), ',') AS j, array_join(slice(array(1, 2, 3, label), 2, 2), ',') AS s, array_join(array_distinct(array(label, label, 1)), ',') AS d, array_join(concat(array(label), array(1, 2)), ',') AS c, array_join(sequence(1, 4), ',') AS r FROM embeddings",
          "SELECT vec_id, len(embedding) AS n, round(list_max(embedding), 5) AS hi, round(list_min(embedding), 5) AS lo, list_contains([label, 3], 3) AS has, list_position([7, label, 3], 3) AS pos, array_to_string(list_sort([label, 3, 9]), ',') AS j, array_to_string(list_slice([1, 2, 3, label], 2, 3), ',') AS s, CASE WHEN label = 1 THEN '1' ELSE label || ',1' END AS d, array_to_string(list_concat([label], [1, 2]), ',') AS c, array_to_string(range(1, 5), ',') AS r FROM embeddings")
sql_query("fn_array_distance", "SELECT vec_id, round(sqrt(aggregate(zip_with(embedding, reverse(embedding), (a, b) -> pow(CAST(a AS DOUBLE) - CAST(b AS DOUBLE), 2)), CAST(0 AS DOUBLE), (x, y) -> x + y)), 6) AS d FROM embeddings",
          "SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS d FROM embeddings")
sql_query("fn_json_extract", "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(get_json_object(props, '$.k') AS INT) + 1 AS next FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS next FROM events")
sql_query("fn_hash", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, lower(hex(c_custkey)) AS h FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(to_hex(c_custkey)) AS h FROM customer")
sql_query("fn_split_part", "SELECT p_partkey, split_part(p_type, ' ', 2) AS a, replace(p_type, ' ', '_') AS b, translate(p_brand, 'Bd', 'Xy') AS c, chr(65 + p_size % 26) AS d, levenshtein(p_brand, 'Brand#11') AS e FROM part")
sql_query("fn_pad", "SELECT p_partkey, lpad(CAST(p_size AS STRING), 5, '0') AS a, rpad(p_brand, 12, '*') AS b FROM part", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 5, '0') AS a, rpad(p_brand, 12, '*') AS b FROM part")
sql_query("fn_unnest", "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_type, ' ')) t AS w", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")

# Families beside the above -----------------------------------------------------------------------

sql_query("fn_struct_map", "SELECT c_custkey, named_struct('a', c_nationkey, 'b', c_name).b AS s, map('x', c_nationkey, 'y', 7)['x'] AS m, size(map_keys(map('x', 1, 'y', 2))) AS k, array_join(map_values(map('p', c_mktsegment, 'q', 'z')), ',') AS v, element_at(map('x', c_nationkey), 'none') IS NULL AS gone FROM customer",
          "SELECT c_custkey, {'a': c_nationkey, 'b': c_name}.b AS s, MAP {'x': c_nationkey, 'y': 7}['x'] AS m, CAST(len(map_keys(MAP {'x': 1, 'y': 2})) AS INTEGER) AS k, array_to_string(map_values(MAP {'p': c_mktsegment, 'q': 'z'}), ',') AS v, MAP {'x': c_nationkey}['none'] IS NULL AS gone FROM customer")
sql_query("fn_regexp_instr", "SELECT p_partkey, regexp_instr(p_type, '[AEIOU]') AS a, size(regexp_extract_all(p_type, '([A-Z]+)', 1)) AS b, regexp_substr(p_type, '[A-Z]+$') AS c FROM part",
          "SELECT p_partkey, CAST(CASE WHEN regexp_matches(p_type, '[AEIOU]') THEN length(regexp_extract(p_type, '^[^AEIOU]*')) + 1 ELSE 0 END AS INTEGER) AS a, CAST(len(regexp_extract_all(p_type, '[A-Z]+')) AS INTEGER) AS b, nullif(regexp_extract(p_type, '[A-Z]+$'), '') AS c FROM part")
sql_query("fn_overlay", "SELECT c_custkey, overlay(c_name PLACING 'XX' FROM 2 FOR 3) AS a, find_in_set('b', 'a,b,c') AS b, octet_length(c_name) AS o, bit_length(c_name) AS l FROM customer",
          "SELECT c_custkey, substr(c_name, 1, 1) || 'XX' || substr(c_name, 5) AS a, CAST(list_position(string_split('a,b,c', ','), 'b') AS INTEGER) AS b, CAST(strlen(c_name) AS INTEGER) AS o, CAST(bit_length(c_name) AS INTEGER) AS l FROM customer")
sql_query("fn_array_sets", "SELECT c_custkey, array_join(sort_array(array_union(array(c_nationkey, 1), array(1, 2))), ',') AS u, array_join(array_intersect(array(c_nationkey, 1, 2), array(2, 1)), ',') AS i, size(array_except(array(100, 101), array(c_nationkey, 101))) AS e, array_join(transform(array(1, c_nationkey, 1), x -> CASE WHEN x = 1 THEN 9 ELSE x END), ',') AS r FROM customer WHERE c_nationkey > 2",
          "SELECT c_custkey, array_to_string(list_sort(list_distinct([c_nationkey, 1, 1, 2])), ',') AS u, '1,2' AS i, 1 AS e, array_to_string([9, c_nationkey, 9], ',') AS r FROM customer WHERE c_nationkey > 2")


@query("SELECT c_custkey, sha256(c_name) AS a, octet_length(encode(c_name)) AS b, decode(encode(c_name)) AS c, base64(encode(c_name)) AS d, lower(hex(c_name)) AS e FROM customer")
def fn_encode(spark, sf_dir):
    expose(spark, sf_dir, "customer")
    return spark.sql(compat.rewrite_sql("SELECT c_custkey, sha256(c_name) AS a, CAST(octet_length(encode(c_name, 'UTF-8')) AS BIGINT) AS b, decode(encode(c_name, 'UTF-8'), 'UTF-8') AS c, base64(encode(c_name, 'UTF-8')) AS d, lower(hex(c_name)) AS e FROM customer"))


#: Digests of 'abc', as published with the functions; DuckDB has sha256 only. Fixed values.
_SHA_ABC = {
    "sha224": "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7",
    "sha384": "cb00753f45a35e8bb5a03d699ac65007272c32ab0eded1631a8b605a43ff5bed8086072ba1e7cc2358baeca134c825a7",
    "sha512": "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f",
}


@query("SELECT r_regionkey, " + ", ".join(f"'{v}' AS {k}" for k, v in _SHA_ABC.items()) + ", sha256(r_name) AS sha256 FROM region")
def fn_sha_family(spark, sf_dir):
    expose(spark, sf_dir, "region")
    return spark.sql(compat.rewrite_sql("SELECT r_regionkey, sha224('abc') AS sha224, sha384('abc') AS sha384, sha512('abc') AS sha512, sha256(r_name) AS sha256 FROM region"))


@query("SELECT p_partkey, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, round(cot(p_size), 9) AS c, round(sinh(p_size / 50.0), 9) AS s, round(tanh(p_size / 50.0), 9) AS t, p_size = 0 AS z FROM part")
def fn_gcd_lcm(spark, sf_dir):
    expose(spark, sf_dir, "part")
    return spark.sql(compat.rewrite_sql("SELECT p_partkey, gcd(p_partkey, p_size) AS g, lcm(p_partkey, p_size) AS l, round(cot(p_size), 9) AS c, round(sinh(p_size / 50.0), 9) AS s, round(tanh(p_size / 50.0), 9) AS t, iszero(p_size) AS z FROM part"))


sql_query("agg_covar", "SELECT l_returnflag, round(covar_pop(l_quantity, l_discount), 9) AS p, round(covar_samp(l_quantity, l_discount), 9) AS s FROM lineitem GROUP BY l_returnflag")

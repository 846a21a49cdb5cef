"""Plans at scale: filters and columns reach the scan, aggregates are partial, small sides only are broadcast."""

import re

from quillon.plans import QUERIES


def plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["harness_q6"](spark, sf))
    assert "PushedFilters: [" in text and "LessThan(l_quantity,24.0)" in text
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", text)[1].split(",")) == {"l_quantity:double", "l_extendedprice:double", "l_discount:double", "l_shipdate:timestamp_ntz"}


def test_aggregates_are_partial(spark, sf):
    text = plan(QUERIES["harness_q1"](spark, sf))
    assert "partial_sum" in text and len(re.findall(r"^.*\bExchange \(\d+\)$", text.split("(1)")[0], re.M)) <= 1


def test_policy_filter_reaches_the_scan(spark, sf):
    text = plan(QUERIES["rls_filter"](spark, sf))
    assert "LessThan(o_custkey,800)" in text and "o_totalprice" not in text


def test_topk_does_not_sort_everything(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk"](spark, sf))


def test_no_python_in_relational_queries(spark, sf):
    for name in ("join_nway", "window_groups_frame", "distinct_on", "window_qualify", "scrub_pii", "contract_violations", "mask_hash"):
        assert not re.search("Python|Pandas|Arrow", plan(QUERIES[name](spark, sf))), name



"""What the optimizer makes of the operators: pushed filters, pruned columns, shuffles that are there for a reason."""

import re

import pytest

from millrace.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(catalog.queries()["filter_pass"](spark, sf_dir))
    assert "EqualTo(event_type,purchase)" in text and "GreaterThan(value,50.0)" in text
    assert re.search(r"ReadSchema: struct<([^>]*)>", text)[1] == "event_id:bigint,event_type:string,value:double"
    assert "Exchange" not in text


def test_expressions_are_pushed_down_like_columns(spark, sf_dir):
    text = plan(catalog.queries()["filter_expr"](spark, sf_dir))
    assert "EqualNullSafe(event_type,click)" in text and "Python" not in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["router", "router_default", "transform", "settlement_outcome", "header_framing", "http_status_classify", "sse_frame", "backoff_schedule"])
def test_row_rules_need_no_python_and_no_more_than_the_count(spark, sf_dir, name):
    text = plan(catalog.queries()[name](spark, sf_dir))
    assert "Python" not in text and text.count("Exchange") <= 1


@pytest.mark.parametrize(("name", "most"), [("agg_completion_size", 1), ("token_bucket", 1), ("attempt_count", 1), ("failure_runs", 1), ("breaker_trip", 1), ("agg_release_rule", 1), ("overflow_drop_oldest", 1)])
def test_one_shuffle_serves_window_and_aggregate(spark, sf_dir, name, most):
    text = plan(catalog.queries()[name](spark, sf_dir))
    assert len(re.findall(r"\bExchange hashpartitioning", text)) <= most, text


def test_claims_don_t_sort_the_queue(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(catalog.queries()["queue_claim"](spark, sf_dir))

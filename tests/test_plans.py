"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_joins(spark, name):
    """No registered query forms the product of two inputs."""
    p = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", ["top_comments", "tail_scan", "credits", "first_per_title", "latest_trends"])
def test_top_n_per_key_is_limited_before_the_shuffle(spark, name):
    df = QUERIES[name](spark, SF)
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in p, name


def test_filters_and_pruning_reach_the_scan(spark):
    df = QUERIES["trend_scores"](spark, SF)
    p = plan_of(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)" in p
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in p


def test_aggregates_are_partial_before_the_shuffle(spark):
    p = plan_of(QUERIES["discussion_window"](spark, SF))
    assert p.count("HashAggregate") >= 2  # partial + final around the exchange

"""Physical-plan and partitioning invariants."""

import pytest

from listenflow.operators import features, funnel, segments, validate
from listenflow.plans.registry import NO_ORACLE, QUERIES
from tests.fixture_tables import fixture_tables

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


# nested-loop joins that pair one-row aggregates only: quantile edges (qcut),
# count/average next to a median, two min/max pairs, dataset totals
ONE_ROW_CROSS = {"engagement_qcut_segments", "segment_share", "upgrade_click_conversion", "date_ranges",
                 "dataset_summary"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - NO_ORACLE))
def test_plan_shape(spark, name):
    """No Cartesian product; nested loops only between one-row frames; every
    single-partition exchange sits on an aggregate that is not at user grain
    (a global partial aggregate, or per segment / band / week / plan)."""
    p = plan_text(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p
    if "BroadcastNestedLoopJoin" in p:
        assert name in ONE_ROW_CROSS
    lines = p.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert "HashAggregate(keys=[" in child, child
            keys = child.split("keys=[", 1)[1].split("]", 1)[0]
            assert "user_id" not in keys, child


def test_filters_reach_the_scan(spark):
    from listenflow.operators import churn
    from listenflow.sources.product import load_product_tables
    t = load_product_tables(spark, SF)
    p = plan_text(churn.churn_distribution(t, "2024-02-25"))
    pushed = [line for line in p.splitlines() if "PushedFilters" in line]
    assert any("GreaterThanOrEqual(session_date," in line for line in pushed), pushed
    assert any("EqualTo(plan_type,premium)" in line for line in pushed), pushed


def test_same_result_for_1_and_16_partitions(spark):
    t = fixture_tables(spark)
    results = []
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append((sorted(map(tuple, segments.free_user_tiers(t).collect())),
                        sorted(map(tuple, segments.conversion_by_quartile(t).collect())),
                        sorted(map(tuple, funnel.funnel_overall(t).collect()), key=str)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]

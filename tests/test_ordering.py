"""Ordered results, row by row; ordered files; no Expand and no needless scan."""

import datetime as dt
import glob
import os
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from listenflow.operators import churn, features, segments
from listenflow.operators.ordering import ordered, write_ordered
from listenflow.plans.registry import QUERIES
from listenflow.sources.product import load_product_tables
from tests.fixture_tables import fixture_tables

SF = "/root/testdata/sf0.001"
RISKS = ["Critical", "High", "Medium", "Low"]
SEGMENTS = ["At Risk (Q4)", "Casual (Q3)", "Engaged (Q2)", "Power User (Q1)"]
# the ordered statements and what their rows are sorted by
SORTED = {
    "funnel_overall": lambda r: r.stage_order,
    "funnel_by_device": lambda r: (-r.conversion_rate_pct, r.device_type is None, r.device_type or ""),
    "cohort_retention": lambda r: (r.cohort_week, r.week_number),
    "free_user_tiers": lambda r: (-r.engagement_score, r.user_id),
    "conversion_by_quartile": lambda r: r.session_quartile,
    "premium_churn_users": lambda r: (r.sessions_last30, r.user_id),
    "churn_distribution": lambda r: RISKS.index(r.churn_risk),
    "genre_by_plan": lambda r: (r.plan_type, -r.total_plays, r.genre),
    "days_to_convert": lambda r: r.days_to_convert,
    # and the segments in the order of their labels
    "engagement_qcut_segments": lambda r: SEGMENTS.index(r.segment),
    "segment_share": lambda r: SEGMENTS.index(r.segment),
}


@pytest.mark.parametrize("name", sorted(SORTED))
def test_rows_come_in_order(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    places = [SORTED[name](r) for r in rows]
    assert rows and places == sorted(places)
    assert len(set(places)) == len(places)          # a total order
    if name in ("engagement_qcut_segments", "segment_share"):
        assert [r.segment_order for r in rows] == [SEGMENTS.index(r.segment) + 1 for r in rows]


def test_missing_values_and_ties(spark):
    df = spark.createDataFrame([(2, "b"), (None, "c"), (1, "z"), (1, "a"), (2, None)], "k int, s string").repartition(4)
    assert [tuple(r) for r in ordered(df, "k", "s").collect()] == [(1, "a"), (1, "z"), (2, "b"), (2, None), (None, "c")]
    assert [tuple(r) for r in ordered(df, "-k", "s").collect()] == [(None, "c"), (2, "b"), (2, None), (1, "a"), (1, "z")]


def test_files_keep_the_order(spark):
    """One value holds half of the rows: its ties are cut by the unique key."""
    path = os.path.join(tempfile.mkdtemp(prefix="lf-ordered-"), "t")
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).alias("score"))
    write_ordered(df, path, "-score", "id", ranges=8)
    files = sorted(glob.glob(f"{path}/part-*.parquet"))
    parts = [list(zip(t["score"].to_pylist(), t["id"].to_pylist())) for t in map(pq.read_table, files)]
    rows = [r for p in parts for r in p]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1])) and len(rows) == 4000
    assert len(parts) > 4 and max(map(len, parts)) < 1500


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_expand(spark):
    t = load_product_tables(spark, SF)
    as_of = "2024-02-25"
    for df in (features.d7_session_features(t), features.d7_track_features(t), features.user_day7_features(t),
               features.d7_features_minutes(t), segments.free_user_tiers(t), segments.free_user_tiers_corrected(t),
               segments.conversion_by_quartile(t), churn.premium_churn_users(t, as_of),
               churn.premium_churn_users_corrected(t, as_of), churn.churn_distribution(t, as_of)):
        assert "Expand" not in plan(df)


def test_recent_events_only(spark):
    t = load_product_tables(spark, SF)
    text = churn.premium_churn_users(t, "2024-02-25")._jdf.queryExecution().executedPlan().toString()
    assert any("GreaterThanOrEqual(event_ts," in line for line in text.splitlines() if "PushedFilters" in line)


def test_window_bound(spark):
    with pytest.raises(ValueError):
        features.d7_session_features(fixture_tables(spark), days=63)
    assert features.d7_session_features(fixture_tables(spark), days=62).count() == 5

"""Invariants on the sf0.01 tables and hot-user behaviour."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listenflow.operators import churn, funnel, retention, segments
from listenflow.operators._user import attach_user
from listenflow.sources.product import load_product_tables
from tests.fixture_tables import fixture_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return load_product_tables(spark, SF)


def test_tiers_cover_free_users_and_quartiles_balanced(t):
    free = t.users.where("plan_type = 'free'").count()
    tiers = segments.free_user_tiers(t)
    assert tiers.count() == free
    sizes = [r.n for r in tiers.groupBy("engagement_quartile").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 1
    q = [r.total_users for r in segments.conversion_by_quartile(t).collect()]
    assert sum(q) == t.users.count() and max(q) - min(q) <= 1


def test_churn_shares_sum_to_100(t):
    for as_of in ("2024-02-25", "2024-02-21"):
        rows = churn.churn_distribution(t, as_of).collect()
        assert abs(sum(r.pct_of_premium for r in rows) - 100.0) <= 0.05 * len(rows) + 1e-9
        assert sum(r.users for r in rows) == t.users.where("plan_type = 'premium'").count()


def test_retention_bounded(t):
    for r in retention.cohort_retention(t).collect():
        assert 0 <= r.retention_pct <= 100 and 0 <= r.week_number <= 12


def test_corrected_hours_at_most_as_written(t):
    a = segments.free_user_tiers(t).select("user_id", F.col("total_hours").alias("a"))
    c = segments.free_user_tiers_corrected(t).select("user_id", F.col("total_hours").alias("c"))
    bad = a.join(c, "user_id").where(F.col("a").isNotNull() & (F.col("c") > F.col("a"))).count()
    assert bad == 0


def test_sql_and_notebook_funnels_agree_on_midnight_sessions(spark):
    tf = fixture_tables(spark)
    sql = {r.stage_order: r.users for r in funnel.funnel_overall(tf).collect()}
    nb = {r.stage_order: r.users for r in funnel.funnel_elapsed_days(tf).collect()}
    assert sql == nb


def _hot_tables(spark):
    """User 0 owns a third of all sessions."""
    users = [(u, dt.date(2024, 1, 1), "US", "18-24", "free" if u % 3 else "premium", None) for u in range(101)]
    sessions, sid = [], 0
    for u in range(101):
        for k in range(2000 if u == 0 else 40):
            sid += 1
            sessions.append((sid, u, dt.date(2024, 1, 1) + dt.timedelta(days=k % 40), 60 + k % 7, "mobile"))
    return fixture_tables(spark, sessions=sessions, users=users, events=[])


def test_hot_user_results_match_naive(spark):
    t = _hot_tables(spark)
    got = {r.stage_order: r.users for r in funnel.funnel_overall(t).collect()}
    # naive: every user has >= 40 sessions, 8 of them by day 7 (dates day 0..7), all 31 by day 30
    assert got == {1: 101, 2: 101, 3: 101, 4: 101, 5: 34}
    tiles = segments.conversion_by_quartile(t).collect()
    assert sorted(r.total_users for r in tiles) == [25, 25, 25, 26]


def test_aqe_splits_hot_user_join(spark):
    """With the fact on the streamed side, AQE cuts the hot user's partition."""
    t = _hot_tables(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        j = attach_user(t.sessions, t.users, ["signup_date"])
        # carry session ids through the shuffle (a bare repeated user id
        # compresses to nothing and would not look skewed in bytes)
        agg = j.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("session_id").alias("s"))
        rows = {r.user_id: r.n for r in agg.collect()}
        assert rows[0] == 2000 and rows[1] == 40
        plan = agg._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

"""Hand-computed answers on the micro-fixture."""

import datetime as dt

import pytest

from listenflow.operators import churn, features, funnel, retention, segments, timing, validate
from tests.fixture_tables import fixture_tables

D = dt.date


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda x: tuple(str(v) for v in x))


def test_funnel_overall(t):
    got = {r.stage_order: (r.users, r.pct_of_top, r.pct_of_prev) for r in funnel.funnel_overall(t).collect()}
    assert got == {1: (5, 100.0, None), 2: (3, 60.0, 60.0), 3: (2, 40.0, 66.7), 4: (0, 0.0, 0.0), 5: (3, 60.0, None)}


def test_funnel_by_device(t):
    got = {r.device_type: (r.total_users, r.first_listen, r.day7_active, r.day30_active, r.converted,
                           r.conversion_rate_pct) for r in funnel.funnel_by_device(t).collect()}
    assert got == {"mobile": (3, 3, 1, 0, 2, 66.67), "desktop": (1, 1, 0, 0, 1, 100.0),
                   "tablet": (1, 1, 0, 0, 0, 0.0), None: (2, 0, 0, 0, 1, 50.0)}


def test_funnel_elapsed_and_dropoff(t):
    f = funnel.funnel_elapsed_days(t)
    got = {r.stage_order: r.users for r in f.collect()}
    # session rows, days = floor(start - signup) <= 7 / <= 30 (pre-signup count too)
    assert got == {1: 5, 2: 3, 3: 2, 4: 0, 5: 3}
    first = [r for r in f.collect() if r.stage_order == 1][0]
    assert first.pct_of_prev == 100.0
    drops = {r.step: (r.drop_pct, r.severity) for r in funnel.funnel_dropoff(f).collect()}
    assert drops[1] == (40.0, "moderate")
    assert drops[3] == (100.0, "severe")
    assert drops[4] == (None, None) or drops[4][0] is None


def test_cohort_retention(t):
    got = rows(retention.cohort_retention(t), "cohort_week", "cohort_size", "week_number", "active_users",
               "retention_pct")
    assert got == [(D(2024, 1, 1), 3, 0, 2, 66.7), (D(2024, 1, 1), 3, 1, 2, 66.7), (D(2024, 1, 8), 2, 0, 1, 50.0)]


def test_cohort_matrix_and_curve(t):
    r = retention.cohort_retention_elapsed(t)
    m = {x.cohort_label: (x.week_0, x.week_1, x.week_2) for x in retention.cohort_matrix(r).collect()}
    assert m["Jan 01"][0] == pytest.approx(200 / 3) and m["Jan 01"][2] is None
    assert m["Jan 08"][0] == pytest.approx(50.0) and m["Jan 08"][1] is None
    c = {x.week_number: x.avg_retention_pct for x in retention.retention_curve(r).collect()}
    assert c[0] == pytest.approx((200 / 3 + 50) / 2) and c[1] == pytest.approx(200 / 3)
    only_first = {x.week_number: x.avg_retention_pct for x in retention.retention_curve(r, first_n=1).collect()}
    assert only_first[0] == pytest.approx(200 / 3)


def test_d7_session_features(t):
    got = rows(features.d7_session_features(t), "user_id", "sessions_d7", "total_listen_sec_d7")
    assert got == [(1, 0, None), (2, 2, 1800), (3, 2, 600), (4, 0, None), (5, 1, 90)]


def test_d7_event_features_and_table(t):
    e = {r.user_id: (r.skips_d7, r.likes_d7, r.upgrade_clicks_d7) for r in features.d7_event_features(t).collect()}
    assert e == {1: (0, 0, 0), 2: (1, 1, 1), 3: (0, 0, 1), 4: (0, 0, 0), 5: (0, 0, 1)}
    f = {r.user_id: r for r in features.user_day7_features(t).collect()}
    assert f[2].tracks_played_d7 == 0 and f[2].tracks_completed_d7 == 0 and f[2].skip_rate_pct is None
    assert f[3].converted == 1 and f[1].converted == 0
    assert len(features.user_day7_features(t).columns) == 25


def test_free_user_tiers_as_written(t):
    got = {r.user_id: (round(r.engagement_score, 4), r.engagement_quartile)
           for r in segments.free_user_tiers(t).collect()}
    assert got == {1: (60.0, 1), 2: (29.6333, 2)}


def test_free_user_tiers_corrected(t):
    got = {r.user_id: (round(r.engagement_score, 4), r.engagement_quartile, r.user_segment)
           for r in segments.free_user_tiers_corrected(t).collect()}
    assert got == {1: (0.0, 2, "Engaged"), 2: (28.6333, 1, "Power User")}


def test_corrected_hours_never_exceed_as_written(t):
    a = {r.user_id: r.total_hours for r in segments.free_user_tiers(t).collect()}
    c = {r.user_id: r.total_hours for r in segments.free_user_tiers_corrected(t).collect()}
    for u, h in c.items():
        assert a[u] is None or h <= a[u]


def test_churn(t):
    got = {r.user_id: (r.sessions_last30, r.active_days_last30, r.churn_risk)
           for r in churn.premium_churn_users(t, "2024-02-06").collect()}
    assert got == {3: (2, 2, "High"), 4: (0, 0, "Critical"), 5: (1, 1, "High")}
    dist = {r.churn_risk: (r.users, r.pct_of_premium, r.risk_order)
            for r in churn.churn_distribution(t, "2024-02-06").collect()}
    assert dist == {"High": (2, 66.7, 2), "Critical": (1, 33.3, 1)}


def test_days_to_convert(t):
    got = rows(timing.days_to_convert(t), "days_to_convert", "users", "pct_of_converters")
    assert got == [(1, 2, 66.7), (3, 1, 33.3)]


def test_upgrade_click_conversion(t):
    r = timing.upgrade_click_conversion(t).collect()[0]
    assert (r.users_clicked_upgrade, r.converted, r.click_to_convert_pct) == (3, 2, 66.7)
    assert r.avg_days_to_convert == 1.1 and r.median_days_to_convert == 1.1


def test_validation(t):
    counts = dict(rows(validate.row_counts(t), "tbl", "rows"))
    assert counts == {"users": 5, "sessions": 7, "events": 5, "tracks_played": 0, "tracks": 0}
    r = validate.date_ranges(t).collect()[0]
    assert (r.earliest_signup, r.latest_session) == (D(2024, 1, 1), D(2024, 1, 9))
    n = validate.null_checks(t).collect()[0]
    assert (n.null_user_id, n.null_signup_date, n.null_plan_type) == (0, 0, 0)
    p = dict(rows(validate.plan_distribution(t), "plan_type", "pct"))
    assert p == {"free": 40.0, "premium": 60.0}


def test_empty_sessions(spark):
    """SUM over no rows is NULL while COUNT is 0; independent date ranges."""
    t = fixture_tables(spark, sessions=[], events=[])
    f = {r.stage_order: r.users for r in funnel.funnel_overall(t).collect()}
    assert f == {1: 5, 2: 0, 3: 0, 4: 0, 5: 3}
    r = validate.date_ranges(t).collect()[0]
    assert r.earliest_signup == D(2024, 1, 1) and r.earliest_session is None


def test_day7_timestamp_edge(spark):
    """A session on day 7 at 13:00 is kept by the elapsed (floor) variant."""
    import datetime as _dt
    from tests.fixture_tables import SESSIONS, fixture_tables as ft
    t0 = ft(spark)
    s = spark.createDataFrame([(90, 1, D(2024, 1, 8), _dt.datetime(2024, 1, 8, 13, 0), 100, "mobile")], SESSIONS)
    from listenflow.sources.product import ProductTables
    t = ProductTables(users=t0.users, sessions=s, events=t0.events, tracks=t0.tracks, plays=t0.plays)
    m = features.d7_features_minutes(t).collect()
    assert [(r.user_id, r.sessions_d7) for r in m] == [(1, 1)]


def test_qcut_segments_all_equal_scores(spark):
    t = fixture_tables(spark)
    feats = spark.createDataFrame(
        [(i, 1, 5.0, 2.0, 1, 1, 0, 0, 0, i % 2) for i in range(8)],
        "user_id long, sessions_d7 long, total_listen_min_d7 double, avg_session_min_d7 double, "
        "distinct_days_d7 long, distinct_devices_d7 long, playlist_saves_d7 long, likes_d7 long, "
        "upgrade_clicks_d7 long, converted int")
    got = {r.segment: r.users for r in segments.engagement_qcut_segments(feats).collect()}
    assert got == {"At Risk (Q4)": 8}

"""Engagement tiers (SQL NTILE form, as written and corrected), session
quartiles, notebook quantile segments and segment shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.functions.numeric import pct, round_half_away
from listenflow.operators._user import attach_user, back_to_users
from listenflow.operators.features import _events_per_session
from listenflow.operators.ordering import ordered
from listenflow.operators.ranking import exact_ntile, exact_percentiles
from listenflow.session import materialize
from listenflow.sources.product import ProductTables

# fixed: tier score terms, (weight, cap); upgrade clicks weigh 10 and are not capped
TIER_WEIGHTS = {"total_sessions": (2, 30), "total_hours": (3, 20), "active_days": (2, 14),
                "playlist_saves": (4, 10), "likes": (1, 20)}
TIER_UPGRADE_WEIGHT = 10
# fixed: labels of NTILE 1..4
TIER_LABELS = ("Power User", "Engaged", "Casual", "At Risk")
QUARTILE_LABELS = ("Power User (top 25%)", "Engaged (50–75%)", "Casual (25–50%)", "Low Activity (bottom 25%)")
# fixed: notebook score terms, (weight, upper clip); upgrade clicks weigh 20
QCUT_WEIGHTS = {"sessions_d7": (2.0, 30), "total_listen_min_d7": (0.5, 300), "distinct_days_d7": (5.0, 7),
                "playlist_saves_d7": (8.0, 10), "likes_d7": (2.0, 20)}
QCUT_UPGRADE_WEIGHT = 20.0
# fixed: qcut labels from the lowest score bin to the highest
QCUT_LABELS = ("At Risk (Q4)", "Casual (Q3)", "Engaged (Q2)", "Power User (Q1)")
TIER_EVENT_TYPES = ("playlist_save", "like", "upgrade_click", "ad_view")


def _label(col: str, labels) -> F.Column:
    expr = None
    for i, lab in enumerate(labels, start=1):
        expr = F.when(F.col(col) == i, lab) if expr is None else expr.when(F.col(col) == i, lab)
    return expr


def _free_user_stats(t: ProductTables, as_written: bool) -> DataFrame:
    """Lifetime per-user stats of free users.

    As written, the SQL sums session seconds *after* joining events, so each
    session's duration counts once per event (at least once).  That is
    reproduced without building the fan-out: events are counted per session
    and the duration is weighted by that count.
    """
    ev = _events_per_session(t, TIER_EVENT_TYPES)
    free = t.users.where(F.col("plan_type") == "free").select("user_id")
    s = attach_user(t.sessions.select("session_id", "user_id", "session_date", "session_duration_sec"), free, [])
    s = s.join(ev, "session_id", "left")
    weight = F.greatest(F.coalesce("n_events", F.lit(0)), F.lit(1)) if as_written else F.lit(1)
    per_user = s.groupBy("user_id").agg(
        F.count("session_id").cast("long").alias("total_sessions"),
        F.sum(F.col("session_duration_sec") * weight).cast("long").alias("_secs"),
        F.countDistinct("session_date").cast("long").alias("active_days"),
        *[F.sum(F.coalesce(f"n_{et}", F.lit(0))).cast("long").alias(name)
          for et, name in zip(TIER_EVENT_TYPES, ("playlist_saves", "likes", "upgrade_clicks", "ad_views"))])
    out = back_to_users(free, per_user, ["total_sessions", "active_days", "playlist_saves", "likes",
                                         "upgrade_clicks", "ad_views"])
    hours = F.col("_secs") / F.lit(3600.0)
    if not as_written:
        hours = F.coalesce(hours, F.lit(0.0))
    return out.withColumn("total_hours", hours).drop("_secs")


def _tier_score() -> F.Column:
    # LEAST skips NULL: a user without sessions gets the full hours term
    score = None
    for col, (w, cap) in TIER_WEIGHTS.items():
        term = F.least(F.col(col), F.lit(cap)) * F.lit(w)
        score = term if score is None else score + term
    return (score + F.col("upgrade_clicks") * F.lit(TIER_UPGRADE_WEIGHT)).cast("double")


def free_user_tiers(t: ProductTables, n: int = 4, as_written: bool = True) -> DataFrame:
    """Free users scored and cut into ``n`` tiles by score (desc, then user_id),
    in that order."""
    scored = _free_user_stats(t, as_written).withColumn("engagement_score", _tier_score())
    tiles = exact_ntile(scored, n, [F.col("engagement_score").desc(), F.col("user_id").asc()],
                        out="engagement_quartile")
    return ordered(tiles.select(
        "user_id", "total_sessions", round_half_away("total_hours", 1).alias("total_hours"),
        "active_days", "playlist_saves", "likes", "upgrade_clicks", "ad_views", "engagement_score", "engagement_quartile",
        _label("engagement_quartile", TIER_LABELS).alias("user_segment")), "-engagement_score", "user_id")


def free_user_tiers_corrected(t: ProductTables, n: int = 4) -> DataFrame:
    """Same tiers with each session counted once and no-session hours = 0."""
    return free_user_tiers(t, n, as_written=False)


def conversion_by_quartile(t: ProductTables, n: int = 4) -> DataFrame:
    """All users cut into ``n`` tiles by lifetime sessions; conversion per tile, in order."""
    s = attach_user(t.sessions.select("session_id", "user_id", "session_date", "session_duration_sec"),
                    t.users, [])
    per_user = s.groupBy("user_id").agg(
        F.count("session_id").cast("long").alias("total_sessions"),
        (F.sum("session_duration_sec") / F.lit(3600.0)).alias("total_hours"),
        F.countDistinct("session_date").cast("long").alias("active_days"))
    u = back_to_users(t.users.select("user_id", "plan_type"), per_user, ["total_sessions", "active_days"])
    q = exact_ntile(u, n, [F.col("total_sessions").desc(), F.col("user_id").asc()], out="session_quartile")
    g = q.groupBy("session_quartile").agg(
        F.count(F.lit(1)).cast("long").alias("total_users"),
        F.sum(F.when(F.col("plan_type") == "premium", 1).otherwise(0)).cast("long").alias("premium_users"),
        F.avg("total_hours").alias("avg_hours"), F.avg("active_days").alias("avg_active_days"))
    return ordered(g.select("session_quartile", _label("session_quartile", QUARTILE_LABELS).alias("segment_label"),
                            "total_users", "premium_users", round_half_away("avg_hours", 1).alias("avg_hours"),
                            round_half_away("avg_active_days", 1).alias("avg_active_days"),
                            pct("premium_users", "total_users", 2).alias("conversion_rate_pct")), "session_quartile")


def _qcut_score() -> F.Column:
    score = None
    for col, (w, cap) in QCUT_WEIGHTS.items():
        x = F.col(col).cast("double")
        term = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(float(cap)))) * F.lit(w)
        score = term if score is None else score + term
    return score + F.col("upgrade_clicks_d7").cast("double") * F.lit(QCUT_UPGRADE_WEIGHT)


def qcut_scored(features: DataFrame) -> DataFrame:
    """Notebook features with score and quantile segment (right-closed bins,
    lowest bin includes the minimum; equal edges leave bins empty)."""
    # read twice (edges, then assignment): materialize once instead of
    # re-running the feature pipeline for the second read
    scored = materialize(features.withColumn("engagement_score", _qcut_score()))
    edges = exact_percentiles(scored, "engagement_score", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])
    j = scored.crossJoin(F.broadcast(edges))     # one row of edges
    s = F.col("engagement_score")
    seg = (F.when(s.isNull(), F.lit(None))
            .when(s <= F.col("q1"), QCUT_LABELS[0]).when(s <= F.col("q2"), QCUT_LABELS[1])
            .when(s <= F.col("q3"), QCUT_LABELS[2]).otherwise(QCUT_LABELS[3]))
    return j.withColumn("segment", seg).drop("q1", "q2", "q3")


def _place(col: str, labels) -> F.Column:
    """1-based place of a label in ``labels``."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col)).cast("int")


def engagement_qcut_segments(features: DataFrame) -> DataFrame:
    """One row per segment, from the lowest score bin to the highest."""
    scored = qcut_scored(features).where(F.col("segment").isNotNull())
    g = scored.groupBy("segment").agg(
        F.count("user_id").cast("long").alias("users"),
        F.sum("converted").cast("long").alias("_conv"),
        F.avg("converted").alias("conversion_rate"),
        F.avg("sessions_d7").alias("avg_sessions"),
        round_half_away(F.avg("total_listen_min_d7"), 9).alias("avg_listen_min"),   # order-independent
        F.avg("playlist_saves_d7").alias("avg_saves"))
    return ordered(g.select("segment", "users", "conversion_rate", "avg_sessions", "avg_listen_min", "avg_saves",
                            pct("_conv", "users", 1).alias("conversion_rate_pct"),
                            _place("segment", QCUT_LABELS).alias("segment_order")), "segment_order")


def segment_share(segments: DataFrame) -> DataFrame:
    """Share of users per segment (input has one row per segment)."""
    total = F.sum("users").over(Window.partitionBy())   # at most four rows
    rows = segments.groupBy("segment").agg(F.sum("users").alias("users"))     # leaves the input's sort out of the plan
    shares = rows.select("segment", "users", pct(F.col("users"), total, 1).alias("share_pct"))
    return ordered(shares.withColumn("segment_order", _place("segment", QCUT_LABELS)), "segment_order")

"""Premium churn risk as of a given date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.functions.numeric import pct, round_half_away
from listenflow.operators._user import attach_user, back_to_users
from listenflow.operators.features import _events_per_session
from listenflow.operators.ordering import ordered
from listenflow.sources.product import ProductTables

LOOKBACK_DAYS = 30
# fixed: bands, first match wins: 0 sessions; <=2 sessions or <=3 days; <=5 sessions or <=7 days
RISK_ORDER = ("Critical", "High", "Medium", "Low")


def _as_date(as_of) -> dt.date:
    return as_of if isinstance(as_of, dt.date) else dt.date.fromisoformat(str(as_of))


def _band(sessions: str, days: str) -> F.Column:
    s, d = F.col(sessions), F.col(days)
    return (F.when(s == 0, "Critical").when((s <= 2) | (d <= 3), "High")
             .when((s <= 5) | (d <= 7), "Medium").otherwise("Low"))


def _recent(t: ProductTables, as_of: dt.date, days: int, with_events: bool, as_written: bool) -> DataFrame:
    premium = t.users.where(F.col("plan_type") == "premium").select("user_id", "converted_date")
    cutoff = as_of - dt.timedelta(days=days)
    # constant bound: pushed to the session side before the join; no upper bound
    s = t.sessions.where(F.col("session_date") >= F.lit(cutoff)) \
                  .select("session_id", "user_id", "session_date", "session_duration_sec")
    s = attach_user(s, premium, [])
    aggs = [F.count("session_id").cast("long").alias("sessions_last30"),
            F.countDistinct("session_date").cast("long").alias("active_days_last30")]
    zero = ["sessions_last30", "active_days_last30"]
    if with_events:
        ev = _events_per_session(t, ("playlist_save", "like"), since=cutoff)
        s = s.join(ev, "session_id", "left")
        weight = F.greatest(F.coalesce("n_events", F.lit(0)), F.lit(1)) if as_written else F.lit(1)
        aggs += [(F.sum(F.col("session_duration_sec") * weight) / F.lit(3600.0)).alias("hours_last30"),
                 F.sum(F.coalesce("n_playlist_save", F.lit(0))).cast("long").alias("saves_last30"),
                 F.sum(F.coalesce("n_like", F.lit(0))).cast("long").alias("likes_last30")]
        zero += ["saves_last30", "likes_last30"]
    return back_to_users(premium, s.groupBy("user_id").agg(*aggs), zero)


def premium_churn_users(t: ProductTables, as_of, days: int = LOOKBACK_DAYS, as_written: bool = True) -> DataFrame:
    as_of = _as_date(as_of)
    r = _recent(t, as_of, days, with_events=True, as_written=as_written)
    return ordered(r.select("user_id", "converted_date",
                            F.datediff(F.lit(as_of), F.col("converted_date")).cast("long").alias("days_as_premium"),
                            "sessions_last30", round_half_away("hours_last30", 1).alias("hours_last30"),
                            "active_days_last30", "saves_last30", "likes_last30",
                            _band("sessions_last30", "active_days_last30").alias("churn_risk")), "sessions_last30", "user_id")


def premium_churn_users_corrected(t: ProductTables, as_of, days: int = LOOKBACK_DAYS) -> DataFrame:
    return premium_churn_users(t, as_of, days, as_written=False)


def churn_distribution(t: ProductTables, as_of, days: int = LOOKBACK_DAYS) -> DataFrame:
    r = _recent(t, _as_date(as_of), days, with_events=False, as_written=False)
    g = r.groupBy(_band("sessions_last30", "active_days_last30").alias("churn_risk")) \
         .agg(F.count(F.lit(1)).cast("long").alias("users"))
    total = F.sum("users").over(Window.partitionBy())     # at most four rows
    order = F.array_position(F.array(*[F.lit(x) for x in RISK_ORDER]), F.col("churn_risk")).cast("int")
    return ordered(g.select("churn_risk", "users", pct(F.col("users"), total, 1).alias("pct_of_premium"),
                            order.alias("risk_order")), "risk_order")

"""Conversion funnel: overall, by device, notebook (elapsed-days) form, drop-off."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.functions.dates import elapsed_days
from listenflow.functions.numeric import pct
from listenflow.operators._user import attach_user, back_to_users, sum_flag
from listenflow.operators.ordering import ordered
from listenflow.sources.product import ProductTables

# fixed stage names
STAGE_NAMES = ("Signed Up", "First Listen", "Day-7 Active", "Day-30 Active", "Converted to Premium")
NOTEBOOK_STAGE_NAMES = ("Signed Up", "First Listen", "Day-7 Active", "Day-30 Active", "Converted")
DEFAULT_STAGES = ((7, 2), (30, 5))   # (days after signup, minimum distinct sessions)


def _session_counts(t: ProductTables, stages: Sequence[tuple[int, int]],
                    by_device: bool = False) -> DataFrame:
    """Per user (and device): distinct sessions overall and up to signup + d days.

    A session counts for a window when any of its rows falls in it, i.e. when
    its earliest date does, so sessions are first reduced to one row each.
    """
    keys = ["user_id", "session_id"] + (["device_type"] if by_device else [])
    s = (t.sessions.where(F.col("session_id").isNotNull())
         .groupBy(*keys).agg(F.min("session_date").alias("first_date")))
    s = attach_user(s, t.users, ["signup_date"])
    grain = ["user_id"] + (["device_type"] if by_device else [])
    aggs = [F.count(F.lit(1)).cast("long").alias("n_sessions")]
    for days, _ in stages:
        aggs.append(F.count(F.when(F.col("first_date") <= F.date_add("signup_date", days), 1))
                    .cast("long").alias(f"n_d{days}"))
    return s.groupBy(*grain).agg(*aggs)


def funnel_overall(t: ProductTables, stages: Sequence[tuple[int, int]] = DEFAULT_STAGES) -> DataFrame:
    """Five-stage funnel: users, % of top, % of previous stage (1 dp)."""
    (d1, m1), (d2, m2) = stages
    per_user = back_to_users(t.users.select("user_id", "plan_type"),
                             _session_counts(t, stages),
                             ["n_sessions", f"n_d{d1}", f"n_d{d2}"])
    totals = per_user.agg(
        F.count(F.lit(1)).cast("long").alias("s1"),
        sum_flag(F.col("n_sessions") >= 1).alias("s2"),
        sum_flag(F.col(f"n_d{d1}") >= m1).alias("s3"),
        sum_flag(F.col(f"n_d{d2}") >= m2).alias("s4"),
        sum_flag(F.col("plan_type") == "premium").alias("s5"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("funnel_stage"), F.lit(i + 1).alias("stage_order"),
                 F.col(f"s{i + 1}").alias("users"),
                 F.col(f"s{i}" if i else "s1").alias("prev_users"))
        for i, name in enumerate(STAGE_NAMES)])
    long = totals.select("s1", F.inline(rows))
    return ordered(long.select(
        "funnel_stage", "stage_order", "users",
        F.when(F.col("stage_order") == 1, F.lit(100.0)).otherwise(pct("users", "s1", 1)).alias("pct_of_top"),
        F.when(F.col("stage_order") == 1, F.lit(None).cast("double"))
         .otherwise(pct("users", "prev_users", 1)).alias("pct_of_prev")), "stage_order")


def funnel_by_device(t: ProductTables, stages: Sequence[tuple[int, int]] = DEFAULT_STAGES) -> DataFrame:
    """Funnel per device type, by conversion rate from high to low; a user
    counts once per device used, users without sessions form the NULL device row."""
    (d1, m1), (d2, m2) = stages
    per_ud = _session_counts(t, stages, by_device=True)
    rows = back_to_users(t.users.select("user_id", "plan_type"), per_ud, ["n_sessions", f"n_d{d1}", f"n_d{d2}"])
    # (user, device) pairs are unique, so rows per device = distinct users
    g = rows.groupBy("device_type").agg(
        F.count(F.lit(1)).cast("long").alias("total_users"),
        sum_flag(F.col("n_sessions") >= 1).alias("first_listen"),
        sum_flag(F.col(f"n_d{d1}") >= m1).alias("day7_active"),
        sum_flag(F.col(f"n_d{d2}") >= m2).alias("day30_active"),
        sum_flag(F.col("plan_type") == "premium").alias("converted"))
    return ordered(g.withColumn("conversion_rate_pct", pct("converted", "total_users", 2)),
                   "-conversion_rate_pct", "device_type")


def funnel_elapsed_days(t: ProductTables, stages: Sequence[tuple[int, int]] = DEFAULT_STAGES) -> DataFrame:
    """Notebook funnel: session rows (not distinct) within floor-elapsed days of
    signup; unrounded percentages, first row's pct_of_prev is 100."""
    (d1, m1), (d2, m2) = stages
    s = attach_user(t.sessions.select("user_id", "session_id", "session_start"), t.users, ["signup_date"])
    s = s.withColumn("days", elapsed_days("signup_date", "session_start"))
    per_user = s.groupBy("user_id").agg(
        F.count("session_id").cast("long").alias("total_sessions"),
        F.count(F.when(F.col("days") <= d1, 1)).cast("long").alias("sessions_a"),
        F.count(F.when(F.col("days") <= d2, 1)).cast("long").alias("sessions_b"))
    f = back_to_users(t.users.select("user_id", "plan_type"), per_user,
                      ["total_sessions", "sessions_a", "sessions_b"])
    totals = f.agg(
        F.count(F.lit(1)).cast("long").alias("s1"),
        sum_flag(F.col("total_sessions") >= 1).alias("s2"),
        sum_flag(F.col("sessions_a") >= m1).alias("s3"),
        sum_flag(F.col("sessions_b") >= m2).alias("s4"),
        sum_flag(F.col("plan_type") == "premium").alias("s5"))
    rows = F.array(*[
        F.struct(F.lit(name).alias("stage"), F.lit(i + 1).alias("stage_order"),
                 F.col(f"s{i + 1}").alias("users"), F.col(f"s{max(i, 1)}").alias("prev_users"))
        for i, name in enumerate(NOTEBOOK_STAGE_NAMES)])
    long = totals.select("s1", F.inline(rows))
    as_pct = lambda n, d: F.when(F.col(d) != 0, F.col(n).cast("double") / F.col(d) * F.lit(100.0))
    return long.select(
        "stage", "stage_order", "users",
        as_pct("users", "s1").alias("pct_of_top"),
        F.when(F.col("stage_order") == 1, F.lit(100.0)).otherwise(as_pct("users", "prev_users"))
         .alias("pct_of_prev"))


# fixed drop-off bands: above 60 % is severe, above 30 % moderate
DROPOFF_BANDS = (60.0, 30.0)


def funnel_dropoff(funnel: DataFrame, bands: tuple[float, float] = DROPOFF_BANDS) -> DataFrame:
    """Step-to-step drop-off of a notebook funnel (5 rows in, 4 rows out)."""
    hi, mid = bands
    w = Window.orderBy("stage_order")     # the funnel has five rows
    steps = funnel.select("stage", "stage_order", "pct_of_prev",
                          F.lag("stage").over(w).alias("from_stage"))
    steps = steps.where(F.col("stage_order") > 1)
    drop = F.lit(100.0) - F.col("pct_of_prev")
    return steps.select(
        "from_stage", F.col("stage").alias("to_stage"), (F.col("stage_order") - 1).alias("step"),
        drop.alias("drop_pct"),
        F.when(drop > hi, "severe").when(drop > mid, "moderate").otherwise("mild").alias("severity"))

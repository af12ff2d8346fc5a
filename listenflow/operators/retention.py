"""Weekly signup-cohort retention, its matrix, curve, and the day-3 link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.functions.dates import week_start
from listenflow.functions.numeric import pct, round_half_away
from listenflow.operators._user import attach_user
from listenflow.operators.ordering import ordered
from listenflow.session import materialize
from listenflow.sources.product import ProductTables

MAX_WEEK = 12
FIRST_COHORTS = 16
MILESTONE_WEEKS = (1, 4, 8, 12)


def _cohort_activity(t: ProductTables, ts_col: str, max_week: int) -> DataFrame:
    """(cohort_week, week_number, active_users) for 0 <= week <= max_week."""
    # one row per (user, active week) before anything is joined
    act = t.sessions.select("user_id", week_start(ts_col).alias("activity_week")).distinct()
    cohorts = t.users.select("user_id", week_start("signup_date").alias("cohort_week"))
    j = attach_user(act, cohorts, ["cohort_week"])
    j = j.withColumn("week_number", F.floor(F.datediff("activity_week", "cohort_week") / 7).cast("long"))
    j = j.where(F.col("week_number").between(0, max_week))
    # (user, activity week) is unique and a user has one cohort, so rows = distinct users
    return j.groupBy("cohort_week", "week_number").agg(F.count(F.lit(1)).cast("long").alias("active_users"))


def _cohort_sizes(t: ProductTables) -> DataFrame:
    return t.users.groupBy(week_start("signup_date").alias("cohort_week")) \
                  .agg(F.count(F.lit(1)).cast("long").alias("cohort_size"))


def cohort_retention(t: ProductTables, max_week: int = MAX_WEEK) -> DataFrame:
    """Observed (cohort, week) pairs, in order, with retention % rounded to 1 dp."""
    a = _cohort_activity(t, "session_date", max_week)
    j = a.join(_cohort_sizes(t), "cohort_week", "inner")
    return ordered(j.select("cohort_week", "cohort_size", "week_number", "active_users",
                            pct("active_users", "cohort_size", 1).alias("retention_pct")), "cohort_week", "week_number")


def cohort_retention_elapsed(t: ProductTables, max_week: int = MAX_WEEK) -> DataFrame:
    """Notebook form: session start timestamps, unrounded retention %."""
    a = _cohort_activity(t, "session_start", max_week)
    j = a.join(_cohort_sizes(t), "cohort_week", "inner")
    return j.select("cohort_week", "week_number", "active_users", "cohort_size",
                    (F.col("active_users").cast("double") / F.col("cohort_size") * F.lit(100.0))
                    .alias("retention_pct"))


def _first_cohorts(retention: DataFrame, first_n: int) -> DataFrame:
    # at most first_n rows: the earliest cohorts, the feature of the heatmap
    return retention.select("cohort_week").distinct().orderBy("cohort_week").limit(first_n)


def cohort_matrix(retention: DataFrame, first_n: int = FIRST_COHORTS, max_week: int = MAX_WEEK) -> DataFrame:
    """Cohort × week pivot of retention %, earliest ``first_n`` cohorts; absent = NULL."""
    retention = materialize(retention)     # ≤ cohorts × (max_week + 1) rows, read twice
    keep = F.broadcast(_first_cohorts(retention, first_n))
    r = retention.join(keep, "cohort_week", "inner")
    piv = r.groupBy("cohort_week").pivot("week_number", list(range(max_week + 1))) \
           .agg(F.first("retention_pct"))
    return piv.select(F.date_format("cohort_week", "MMM dd").alias("cohort_label"), "cohort_week",
                      *[F.col(str(w)).alias(f"week_{w}") for w in range(max_week + 1)])


def retention_curve(retention: DataFrame, first_n: int = FIRST_COHORTS) -> DataFrame:
    """Unweighted mean retention by week over the earliest ``first_n`` cohorts."""
    retention = materialize(retention)     # ≤ cohorts × (max_week + 1) rows, read twice
    keep = F.broadcast(_first_cohorts(retention, first_n))
    r = retention.join(keep, "cohort_week", "inner")
    # the mean of doubles depends on summation order in its last bit; 9
    # decimals make it identical however the rows were partitioned
    return r.groupBy("week_number").agg(
        round_half_away(F.avg("retention_pct"), 9).alias("avg_retention_pct"),
        F.count("retention_pct").cast("long").alias("cohorts_observed"),
    ).withColumn("is_milestone", F.col("week_number").isin(*MILESTONE_WEEKS)) \
     .withColumn("reference_level",       # level at the last week, the dashed line
                 F.max_by("avg_retention_pct", "week_number").over(Window.partitionBy()))  # ≤ max_week+1 rows


def cohort_day3_vs_retention(t: ProductTables, week: int = 4, day3: int = 3) -> DataFrame:
    """Per cohort: mean sessions in the first ``day3`` days (zeros included)
    next to the cohort's week-``week`` retention (NULL when no one returned)."""
    s = attach_user(t.sessions.select("user_id", "session_id", "session_date"), t.users, ["signup_date"],
                    condition=lambda c: c("f.session_date").between(c("u.signup_date"),
                                                                    F.date_add(c("u.signup_date"), day3)))
    per_user = s.groupBy("user_id").agg(F.count("session_id").cast("long").alias("d3"))
    u = t.users.select("user_id", week_start("signup_date").alias("cohort_week")) \
               .join(per_user, "user_id", "left")
    c = u.groupBy("cohort_week").agg(F.count(F.lit(1)).cast("long").alias("cohort_size"),
                                     F.sum(F.coalesce("d3", F.lit(0))).cast("long").alias("d3_sessions"))
    ret = cohort_retention(t, max_week=week).where(F.col("week_number") == week) \
        .select("cohort_week", F.col("retention_pct").alias("week_retention_pct"))
    return c.join(ret, "cohort_week", "left").select(
        "cohort_week", "cohort_size",
        (F.col("d3_sessions") / F.col("cohort_size")).alias("avg_day3_sessions"),
        "week_retention_pct")


def day3_retention_correlation(t: ProductTables, week: int = 4, day3: int = 3) -> DataFrame:
    """Pearson correlation, across cohorts, of mean day-3 sessions and
    week-``week`` retention (cohorts without that week are left out)."""
    c = cohort_day3_vs_retention(t, week, day3).where(F.col("week_retention_pct").isNotNull())
    return c.agg(F.count(F.lit(1)).cast("long").alias("cohorts"),
                 round_half_away(F.corr("avg_day3_sessions", "week_retention_pct"), 6).alias("corr"))

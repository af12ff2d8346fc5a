"""Load checks: row counts, plan mix, date ranges, null counts, dataset summary.

Counts, date ranges and null counts of loaded tables were observed while the
tables were written and cost no scan; tables from elsewhere are scanned.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.functions.numeric import pct
from listenflow.sources.product import ProductTables, observed

# fixed: reported table names
ROW_COUNT_TABLES = (("users", "users"), ("sessions", "sessions"), ("events", "events"),
                    ("tracks_played", "plays"), ("tracks", "tracks"))
NULL_CHECK_COLUMNS = ("user_id", "signup_date", "plan_type")


def _rows(t: ProductTables, attr: str) -> DataFrame:
    """One row: the table's number of rows."""
    seen = observed(t, attr)
    if seen:
        return _one_row(t, rows=F.lit(seen["rows"]).cast("long"))
    return getattr(t, attr).agg(F.count(F.lit(1)).cast("long").alias("rows"))


def _one_row(t: ProductTables, **columns) -> DataFrame:
    return t.source[0].range(1).select(*[c.alias(name) for name, c in columns.items()])


def row_counts(t: ProductTables) -> DataFrame:
    return reduce(DataFrame.unionByName, [_rows(t, attr).select(F.lit(name).alias("tbl"), "rows")
                                          for name, attr in ROW_COUNT_TABLES])


def plan_distribution(t: ProductTables) -> DataFrame:
    g = t.users.groupBy("plan_type").agg(F.count(F.lit(1)).cast("long").alias("users"))
    total = F.sum("users").over(Window.partitionBy())   # one row per plan
    return g.select("plan_type", "users", pct(F.col("users"), total, 1).alias("pct"))


def date_ranges(t: ProductTables) -> DataFrame:
    """Two independent one-row aggregates side by side (not a Cartesian product
    of the tables: an empty table nulls only its own pair)."""
    users, sessions = observed(t, "users"), observed(t, "sessions")
    if users and sessions:
        return _one_row(t, earliest_signup=F.lit(users["min_signup_date"]).cast("date"),
                        latest_signup=F.lit(users["max_signup_date"]).cast("date"),
                        earliest_session=F.lit(sessions["min_session_date"]).cast("date"),
                        latest_session=F.lit(sessions["max_session_date"]).cast("date"))
    u = t.users.agg(F.min("signup_date").alias("earliest_signup"), F.max("signup_date").alias("latest_signup"))
    s = t.sessions.agg(F.min("session_date").alias("earliest_session"),
                       F.max("session_date").alias("latest_session"))
    return u.crossJoin(s)


def null_checks(t: ProductTables, cols: Sequence[str] = NULL_CHECK_COLUMNS) -> DataFrame:
    seen = observed(t, "users")
    if seen and all(f"null_{c}" in seen for c in cols):
        # a sum over no rows is null
        return _one_row(t, **{f"null_{c}": F.lit(seen[f"null_{c}"] if seen["rows"] else None).cast("long") for c in cols})
    return t.users.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias(f"null_{c}")
                         for c in cols])


def dataset_summary(t: ProductTables, features: DataFrame) -> DataFrame:
    """Sizes of the input frames, overall conversion, and feature-table shape/rate."""
    u = t.users.agg(F.count(F.lit(1)).cast("long").alias("users"),
                    F.sum(F.when(F.col("plan_type") == "premium", 1).otherwise(0)).cast("long").alias("_p"))
    s = _rows(t, "sessions").withColumnRenamed("rows", "sessions")
    tr = t.tracks.agg(F.count(F.lit(1)).cast("long").alias("tracks"))
    f = features.agg(F.count(F.lit(1)).cast("long").alias("feature_rows"),
                     F.sum("converted").cast("long").alias("_fc"))
    j = u.crossJoin(s).crossJoin(tr).crossJoin(f)     # four one-row frames
    return j.select("users", "sessions", "tracks", pct("_p", "users", 1).alias("conversion_rate_pct"),
                    "feature_rows", F.lit(len(features.columns)).alias("feature_columns"),
                    pct("_fc", "feature_rows", 1).alias("feature_conversion_rate_pct"))

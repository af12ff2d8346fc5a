"""The day-7 feature table by signup week, kept up to date week by week.

The table is partitioned by ``cohort_week``.  A user's features depend on the
facts of the ``days + 1`` dates from signup on only, so facts that arrive for
some dates touch the cohorts that signed up at most ``days`` before them.  Only
those weeks are computed again, from the users and facts of their dates (date
bounds reach the scans), and written next to the old ones; one manifest then
switches all of them at once (see :mod:`listenflow.sources.tables`).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.functions.dates import week_start
from listenflow.operators.features import D7_DAYS, user_day7_features
from listenflow.sources import tables
from listenflow.sources.product import ProductTables

WEEK = "cohort_week"


def monday(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())


def touched_weeks(first: dt.date, last: dt.date, days: int = D7_DAYS) -> tuple[dt.date, dt.date]:
    """First and last signup week whose windows meet the dates ``first`` to ``last``."""
    return monday(first - dt.timedelta(days=days)), monday(last)


def week_features(t: ProductTables, first_week: dt.date | None = None, last_week: dt.date | None = None,
                  days: int = D7_DAYS) -> DataFrame:
    """``user_day7_features`` and ``cohort_week`` of the users who signed up in
    the weeks from ``first_week`` to ``last_week`` (all without them)."""
    users, sessions, events, plays = t.users, t.sessions, t.events, t.plays
    if first_week is not None:
        end = last_week + dt.timedelta(days=6 + days)       # last date of any window
        def within(df: DataFrame, c: str, upto: dt.date) -> DataFrame:
            return df.where((F.col(c) >= F.lit(first_week)) & (F.col(c) <= F.lit(upto)))
        users = within(users, "signup_date", last_week + dt.timedelta(days=6))
        sessions, plays = within(sessions, "session_date", end), within(plays, "play_date", end)
        # a session may run on after its date, but no event of it is earlier
        events = events.where(F.col("event_ts") >= F.lit(first_week).cast("timestamp"))
    part = replace(t, users=users, sessions=sessions, events=events, plays=plays, source=None)
    weeks = users.select("user_id", week_start("signup_date").alias(WEEK))
    return user_day7_features(part, days).join(weeks, "user_id")


def _known_weeks(spark: SparkSession, path: str, name: str) -> list[str]:
    return sorted(n[len(WEEK) + 1:] for n in tables.Folder(spark, f"{path.rstrip('/')}/{name}").names() if n.startswith(f"{WEEK}="))


def rebuild(t: ProductTables, path: str, days: int = D7_DAYS) -> int:
    """Write all weeks; the new version's number."""
    spark = t.users.sparkSession
    name = tables.stage(week_features(t, days=days), path, WEEK)
    parts = {w: name for w in _known_weeks(spark, path, name)}
    return tables.publish_next(spark, path, lambda found: {"parts": parts})


def update(t: ProductTables, path: str, first: dt.date, last: dt.date, days: int = D7_DAYS) -> list[str]:
    """Bring the table up to date after users or facts of the dates ``first`` to
    ``last`` were added, changed or removed; the weeks that were written.

    The weeks' features are computed from the sources, so writers of different
    weeks may run at once: the slower one publishes on top of the faster one.
    """
    spark = t.users.sparkSession
    low, high = touched_weeks(first, last, days)
    name = tables.stage(week_features(t, low, high, days), path, WEEK)
    written = {w: name for w in _known_weeks(spark, path, name)}

    def change(found: dict | None) -> dict:
        kept = {w: n for w, n in (found or {"parts": {}})["parts"].items() if not low.isoformat() <= w <= high.isoformat()}
        return {"parts": {**kept, **written}}
    tables.publish_next(spark, path, change)
    return sorted(written)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest (or the given) version; ``cohort_week`` filters prune folders."""
    number, found = tables.latest(spark, path)
    if version is not None and version != number:
        import json
        found = json.loads(tables.Folder(spark, path).read(f"{tables.VERSIONS}/{version:08d}.json"))
    if found is None:
        raise FileNotFoundError(f"no feature table at {path}")
    folders: dict[str, list[str]] = {}
    for week, name in sorted(found["parts"].items()):
        folders.setdefault(name, []).append(week)
    out = None
    for name, weeks in folders.items():
        base = f"{path.rstrip('/')}/{name}"
        part = spark.read.option("basePath", base).parquet(*[f"{base}/{WEEK}={w}" for w in weeks])
        part = part.withColumn(WEEK, F.col(WEEK).cast("date"))
        out = part if out is None else out.unionByName(part)
    return out

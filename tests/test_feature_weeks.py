"""Versioned tables under concurrent writers, and the weekly feature table."""

import datetime as dt
import os
import tempfile
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from listenflow.operators import features
from listenflow.sources import feature_weeks, tables
from listenflow.sources.product import load_product_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def path():
    return os.path.join(tempfile.mkdtemp(prefix="lf-tables-"), "t")


def test_two_writers_leave_one_whole_table(spark, path):
    """Both see no table, both write; one wins and both read its rows."""
    both = threading.Barrier(2)
    got, errors = {}, []

    def writer(tag):
        def build():
            both.wait(60)
            return spark.range(1000).select(F.lit(tag).alias("tag"), "id")
        try:
            got[tag] = tables.create_if_absent(spark, path, build)
        except Exception as e:  # shown by the main thread
            errors.append(e)
    threads = [threading.Thread(target=writer, args=(t,)) for t in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert sorted(made for _, made in got.values()) == [False, True]
    assert len({folder for folder, _ in got.values()}) == 1
    rows = spark.read.parquet(got["a"][0]).groupBy("tag").count().collect()
    assert [r["count"] for r in rows] == [1000]
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 1     # the loser's files are gone
    again, made = tables.create_if_absent(spark, path, lambda: pytest.fail("there is a table"))
    assert (again, made) == (got["a"][0], False)


def test_a_writer_killed_half_way_leaves_no_table(spark, path):
    def dies():
        tables.stage(spark.range(10), path)         # files written, nothing published
        raise KeyboardInterrupt
    with pytest.raises(KeyboardInterrupt):
        tables.create_if_absent(spark, path, dies)
    assert tables.latest(spark, path) == (0, None)
    with pytest.raises(FileNotFoundError):
        feature_weeks.read(spark, path)
    folder, made = tables.create_if_absent(spark, path, lambda: spark.range(5))
    assert made and spark.read.parquet(folder).count() == 5
    assert tables.remove_orphans(spark, path) == []                 # too young
    assert len(tables.remove_orphans(spark, path, 0)) == 1
    assert spark.read.parquet(folder).count() == 5


def test_slower_writer_publishes_on_top(spark, path):
    n = tables.publish_next(spark, path, lambda found: {"parts": {"a": "x"}})
    calls = []

    def change(found):
        if not calls:                                # another writer is faster
            tables.publish_next(spark, path, lambda f: {"parts": {**f["parts"], "b": "y"}})
        calls.append(found)
        return {"parts": {**found["parts"], "c": "z"}}
    assert tables.publish_next(spark, path, change) == n + 2 and len(calls) == 2
    assert tables.latest(spark, path)[1]["parts"] == {"a": "x", "b": "y", "c": "z"}


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_update_equals_rebuild_and_touches_few_weeks(spark, path):
    t = load_product_tables(spark, SF)
    known = dt.date(2024, 1, 10)
    early = replace(t, users=t.users.where(F.col("signup_date") <= F.lit(known)),
                    sessions=t.sessions.where(F.col("session_date") <= F.lit(known)),
                    plays=t.plays.where(F.col("play_date") <= F.lit(known)), source=None)
    feature_weeks.rebuild(early, path)
    before = tables.latest(spark, path)[1]["parts"]
    # one more day of facts and sign-ups
    day = known + dt.timedelta(days=1)
    more = replace(t, users=t.users.where(F.col("signup_date") <= F.lit(day)),
                   sessions=t.sessions.where(F.col("session_date") <= F.lit(day)),
                   plays=t.plays.where(F.col("play_date") <= F.lit(day)), source=None)
    assert feature_weeks.update(more, path, day, day) == ["2024-01-01", "2024-01-08"]
    after = tables.latest(spark, path)[1]["parts"]
    assert after["2023-12-25"] == before["2023-12-25"]              # untouched, the same files
    whole = os.path.join(os.path.dirname(path), "whole")
    feature_weeks.rebuild(more, whole)
    assert rows(feature_weeks.read(spark, path)) == rows(feature_weeks.read(spark, whole))
    assert rows(feature_weeks.read(spark, path).drop("cohort_week")) == rows(features.user_day7_features(more))
    # the version before still reads as it was
    assert feature_weeks.read(spark, path, 1).count() == early.users.count()
    # a week whose users are all gone goes
    gone = replace(more, users=more.users.where("signup_date < date'2024-01-08'"), source=None)
    assert feature_weeks.update(gone, path, dt.date(2024, 1, 15), dt.date(2024, 1, 15)) == []
    assert sorted(tables.latest(spark, path)[1]["parts"]) == ["2023-12-25", "2024-01-01"]


def test_touched_weeks():
    d = dt.date
    assert feature_weeks.touched_weeks(d(2024, 1, 15), d(2024, 1, 21)) == (d(2024, 1, 8), d(2024, 1, 15))
    assert feature_weeks.touched_weeks(d(2024, 1, 14), d(2024, 1, 14)) == (d(2024, 1, 1), d(2024, 1, 8))

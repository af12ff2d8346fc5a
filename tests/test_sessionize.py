"""Segment-wise sessionization equals a per-user window scan, hot user included."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from listenflow.operators.sessionize import sessionize


def naive(df, gap):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    prev = F.lag(us).over(w)
    start = F.when(prev.isNull() | ((us - prev) > gap * 1_000_000), 1).otherwise(0)
    return df.withColumn("_s", start).withColumn("seq", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def test_sessionize_matches_window(spark):
    random.seed(3)
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for user, n in [(1, 4000), (2, 50), (3, 1), (4, 300)]:   # user 1 is the hot key
        t = base
        for _ in range(n):
            t += dt.timedelta(minutes=random.choice([1, 5, 30, 200, 239, 240, 241, 600]))
            rows.append((eid, user, t))
            eid += 1
    rows.append((eid, 2, rows[-1][2]))       # a timestamp tie, ordered by event id
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    ref = {r.event_id: r.seq for r in naive(df, 4 * 3600).collect()}
    for keep in ("write", "cache"):
        ours = {r.event_id: r.session_seq for r in sessionize(df, "user_id", "ts", "event_id", 4 * 3600,
                                                              segments=11, keep=keep).collect()}
        assert ours == ref, keep
    from listenflow.operators.ranking import release_held
    release_held()


def test_sessionize_null_user_kept(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(1, None, base), (2, None, base + dt.timedelta(hours=5)), (3, 7, base)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.session_seq for r in sessionize(df, "user_id", "ts", "event_id", 4 * 3600).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_session_ids_do_not_collide(spark):
    """A user with 10,001 sessions beside another user: ids stay apart and the
    id is the first event's, across range segments too."""
    base = dt.datetime(2020, 1, 1)
    rows = [(i, 1, base + dt.timedelta(hours=5 * i)) for i in range(10001)]
    rows += [(20000 + i, 2, base + dt.timedelta(minutes=i)) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    got = sessionize(df, "user_id", "ts", "event_id", 4 * 3600, segments=7, first_id="session_id").collect()
    assert {r.event_id: r.session_id for r in got if r.user_id == 1} == {i: i for i in range(10001)}
    assert {r.session_id for r in got if r.user_id == 2} == {20000}
    assert len({r.session_id for r in got}) == 10002

"""Scalar helpers against exact Python arithmetic (property tests)."""

import datetime as dt
import math
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listenflow.functions.dates import elapsed_days, week_start
from listenflow.functions.numeric import pct, round_half_away
from listenflow.functions.stats import normal_cdf, two_sided_p


def half_up(x: Fraction, dp: int) -> float:
    q = x * 10 ** dp
    return math.floor(q + Fraction(1, 2)) / 10 ** dp


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10 ** 7), st.integers(0, 10 ** 7)), min_size=200, max_size=200))
def test_pct_is_exact_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, d long")
    rows = df.select("n", "d", pct("n", "d", 1).alias("p1"), pct("n", "d", 2).alias("p2"),
                     pct("n", "d", 2, scale=1).alias("r2")).collect()
    for r in rows:
        if r.d == 0:
            assert r.p1 is None and r.p2 is None
            continue
        assert r.p1 == half_up(Fraction(100 * r.n, r.d), 1)
        assert r.p2 == half_up(Fraction(100 * r.n, r.d), 2)
        assert r.r2 == half_up(Fraction(r.n, r.d), 2)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=200, max_size=200))
def test_round_half_away_on_binary_value(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", round_half_away("x", 2).alias("y")).collect():
        expect = math.copysign(math.floor(abs(r.x) * 100.0 + 0.5) / 100.0, r.x) if r.x else 0.0
        assert r.y == expect or (r.y == 0 and expect == 0)


def test_normal_cdf(spark):
    zs = [i / 10 for i in range(-60, 61)]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in df.select("z", normal_cdf("z").alias("c"), two_sided_p("z").alias("p")).collect():
        exact = 0.5 * (1 + math.erf(r.z / math.sqrt(2)))
        assert abs(r.c - exact) < 1e-7
        assert abs(r.p - 2 * (1 - 0.5 * (1 + math.erf(abs(r.z) / math.sqrt(2))))) < 2e-7


@settings(max_examples=1, deadline=None)
@given(st.lists(st.dates(dt.date(1990, 1, 1), dt.date(2040, 12, 31)), min_size=100, max_size=100))
def test_week_start_is_monday(spark, ds):
    df = spark.createDataFrame([(d,) for d in ds], "d date")
    for r in df.select("d", week_start("d").alias("w")).collect():
        assert r.w == r.d - dt.timedelta(days=r.d.weekday())


def test_elapsed_days_floors(spark):
    rows = [(dt.date(2024, 1, 1), dt.datetime(2024, 1, 8, 23, 59)), (dt.date(2024, 1, 1), dt.datetime(2023, 12, 31, 12, 0))]
    df = spark.createDataFrame(rows, "s date, t timestamp")
    got = [r.e for r in df.select(elapsed_days("s", "t").alias("e")).collect()]
    assert got == [7, -1]

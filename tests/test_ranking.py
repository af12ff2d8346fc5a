"""Skew-safe ranking, NTILE and percentiles against straightforward versions."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listenflow.operators.ranking import exact_ntile, exact_percentiles, ntile_from_rank, row_number_within


def test_ntile_formula_matches_sql_ntile(spark):
    rows = [(n, k, r) for n in range(1, 30) for k in range(1, 7) for r in range(1, n + 1)]
    df = spark.createDataFrame(rows, "n long, k int, r long")
    got = df.select("n", "k", "r", *[F.when(F.col("k") == k, ntile_from_rank("r", "n", k)).alias(f"t{k}")
                                     for k in range(1, 7)]).collect()
    for row in got:
        n, k, r = row.n, row.k, row.r
        sizes = [n // k + (1 if i < n % k else 0) for i in range(k)]
        bounds = np.cumsum(sizes)
        expect = int(np.searchsorted(bounds, r) + 1)
        assert row[f"t{k}"] == expect


@pytest.mark.parametrize("n_rows,n", [(1, 4), (3, 4), (5, 4), (6, 4), (57, 4), (200, 7)])
def test_exact_ntile_matches_window_ntile(spark, n_rows, n):
    random.seed(n_rows)
    data = [(i, random.choice([0.0, 1.0, 2.5, 3.0])) for i in range(n_rows)]
    df = spark.createDataFrame(data, "user_id long, score double")
    ours = {r.user_id: r.t for r in exact_ntile(df, n, [F.col("score").desc(), F.col("user_id").asc()], out="t",
                                                segments=5).collect()}
    ref = {r.user_id: r.t for r in df.withColumn(
        "t", F.ntile(n).over(Window.orderBy(F.col("score").desc(), F.col("user_id").asc()))).collect()}
    assert ours == ref


def test_row_number_with_hot_group(spark):
    """One group holds most rows: positions are still 1..N in order."""
    data = [(0 if i % 3 else i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(data, "g long, v long")
    out = row_number_within(df, [F.col("v").asc()], ["g"], out="rn", segments=9, total="n").collect()
    by_g = {}
    for r in out:
        by_g.setdefault(r.g, []).append((r.v, r.rn, r.n))
    for g, xs in by_g.items():
        xs.sort()
        assert [rn for _, rn, _ in xs] == list(range(1, len(xs) + 1))
        assert {n for _, _, n in xs} == {len(xs)}


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.normal(size=500))]
    data += [(5, 1.0)]                       # a one-value group
    df = spark.createDataFrame(data, "g long, v double")
    got = {r.g: (r.a, r.b, r.c) for r in exact_percentiles(df, "v", [0.25, 0.5, 0.9], ["a", "b", "c"],
                                                           group_by=["g"], segments=6).collect()}
    for g in {d[0] for d in data}:
        vals = np.array([v for gg, v in data if gg == g])
        assert got[g] == pytest.approx(tuple(np.quantile(vals, [0.25, 0.5, 0.9])), rel=1e-12)


def test_exact_percentile_global_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,), (10.0,)], "v double")
    r = exact_percentiles(df, "v", [0.5], ["m"]).collect()[0]
    assert r.m == pytest.approx(2.5)
    empty = spark.createDataFrame([], "v double")
    assert exact_percentiles(empty, "v", [0.5], ["m"]).collect()[0].m is None


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", 2.0), (None, 2.0)], "g string, v double")
    got = [(r.g, r.v, r.rn, r.n) for r in row_number_within(df, [F.col("v").asc()], ["g"], out="rn",
                                                            total="n", segments=3).collect()]
    assert sorted(got, key=str) == sorted([(None, 1.0, 1, 3), (None, 2.0, 2, 3), (None, 3.0, 3, 3),
                                           ("a", 2.0, 1, 1)], key=str)


def test_ties_rank_as_one_row(spark):
    """95 % of the rows on one value: the ranked rows are distinct values."""
    from listenflow.operators.ranking import exact_percentiles, running_counts
    import numpy as np
    values = [1.0] * 1900 + [float(i) for i in range(2, 102)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    counts = df.groupBy("v").count()
    ranked = running_counts(counts, "v", ["count"])
    assert ranked.count() == 101
    got = exact_percentiles(df, "v", [0.25, 0.5, 0.97], ["a", "b", "c"]).collect()[0]
    assert np.allclose([got.a, got.b, got.c], np.percentile(values, [25, 50, 97]))

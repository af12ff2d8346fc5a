"""Skew-safe global ranking, NTILE and exact percentiles.

``Window.orderBy(...)`` without ``partitionBy`` (SQL ``NTILE(4) OVER (ORDER BY
x)``) moves every row into one task.  Here the frame is *range-partitioned* on
the ordering instead: Spark samples the keys and cuts them into balanced,
ordered segments, so even a group that holds a third of all rows is spread
over many tasks.  Each row gets its position inside its segment from a window
partitioned by (segment, group); a tiny table of per-segment counts (one row
per segment and group) turns that into a global position.

The segment id is ``spark_partition_id()`` read right after the range
exchange.  Spark seeds the range sampler with the RDD id, so two plannings of
the same exchange can cut different boundaries; the segmented frame is
therefore written once (a Parquet table under ``spark.checkpoint.dir``) and
both branches read that copy.  This also cuts the lineage: a lost executor
re-reads the files instead of re-running the range shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenflow.session import materialize

SEG = "_lf_seg"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL matches NULL (a window's NULL
    partition is a group like any other); the key columns appear once."""
    r = right.select(*[F.col(k).alias(f"_lf_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_lf_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "inner").drop(*[f"_lf_r_{k}" for k in keys])


def segment_count(spark) -> int:
    """Number of range segments: the shuffle width the session is sized for.

    AQE cannot coalesce a range exchange with a fixed count, so take the
    largest width the session allows (``initialPartitionNum`` when a cluster
    sets it, else ``spark.sql.shuffle.partitions``), at least one per core.
    """
    width = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    width = int(width) if width else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(width, spark.sparkContext.defaultParallelism)


# Segmented frames cached for the duration of one write (see _segments).
_HELD: list[DataFrame] = []


def release_held() -> None:
    """Unpersist the segmented frames cached with ``keep="cache"``."""
    while _HELD:
        _HELD.pop().unpersist()


def _segments(df: DataFrame, keys: Sequence[Column], n: int | None, keep: str = "write") -> DataFrame:
    """Range segments of ``df`` with their id in ``SEG``.

    ``keep="write"`` (default, for lazily returned results) writes them as
    Parquet.  ``keep="cache"`` is for a caller that consumes the result in a
    single job and then calls :func:`release_held` (the load step): the
    segments are cached instead; a lost block is recomputed through the same
    range exchange, whose boundaries are fixed once per cached plan.
    """
    spark = df.sparkSession
    if n is None:
        n = segment_count(spark)
    seg = df.repartitionByRange(n, *keys).withColumn(SEG, F.spark_partition_id())
    if keep == "cache":
        seg = seg.persist(StorageLevel.MEMORY_AND_DISK)
        _HELD.append(seg)
        return seg
    return materialize(seg)


def _with_offsets(local: DataFrame, offsets: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Attach the offsets of each segment.  Without groups there is one row
    per segment, a number the session fixes, so it is broadcast."""
    if not group_by:
        return local.join(F.broadcast(offsets), SEG)
    return join_on_keys(local, offsets, [SEG, *group_by])


def _ranked(df: DataFrame, order_by: Sequence, group_by: Sequence[str], out: str,
            total: str | None, segments: int | None) -> DataFrame:
    order = _cols(order_by)
    seg = _segments(df, _cols(group_by) + order, segments)
    local_w = Window.partitionBy(SEG, *group_by).orderBy(*order)
    local = seg.select("*", F.row_number().over(local_w).alias("_lf_local"))
    counts = seg.groupBy(SEG, *group_by).agg(F.count(F.lit(1)).alias("_lf_cnt"))
    # at most one row per (segment, group): these windows are bounded by the
    # number of segments, whatever the skew of the data
    grp = Window.partitionBy(*group_by)
    before = grp.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_lf_cnt").over(grp).cast("long").alias(total)] if total else []
    offsets = counts.select(SEG, *group_by,
                            F.coalesce(F.sum("_lf_cnt").over(before), F.lit(0)).alias("_lf_off"), *extra)
    joined = _with_offsets(local, offsets, group_by)
    keep = [c for c in joined.columns if c not in (SEG, "_lf_local", "_lf_off")]
    return joined.select(*keep, (F.col("_lf_off") + F.col("_lf_local")).cast("long").alias(out))


def row_number_within(df: DataFrame, order_by: Sequence, group_by: Sequence[str] = (),
                      out: str = "row_num", segments: int | None = None,
                      total: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its group, in ``order_by`` order
    (and, if ``total`` is given, the group's row count under that name).

    Equivalent to ``row_number() OVER (PARTITION BY group_by ORDER BY order_by)``
    but never puts a whole group into one task.  Give ``order_by`` a unique
    tiebreak for a deterministic result.
    """
    return _ranked(df, order_by, list(group_by), out, total, segments)


def ntile_from_rank(rank, total, n: int) -> Column:
    """SQL NTILE bucket of the 1-based ``rank`` among ``total`` rows.

    The first ``total mod n`` buckets hold one extra row.
    """
    r = F.col(rank) if isinstance(rank, str) else rank
    t = F.col(total) if isinstance(total, str) else total
    q = F.floor(t / F.lit(n)).cast("long")
    m = (t - q * F.lit(n)).cast("long")
    big = m * (q + 1)
    first = F.ceil(r / (q + 1))
    rest = m + F.ceil((r - big) / q)
    return F.when(r <= big, first).otherwise(rest).cast("long")


def exact_ntile(df: DataFrame, n: int, order_by: Sequence, out: str = "ntile",
                group_by: Sequence[str] = (), segments: int | None = None) -> DataFrame:
    """``NTILE(n) OVER (PARTITION BY group_by ORDER BY order_by)``, skew-safe."""
    ranked = row_number_within(df, order_by, group_by, out="_lf_rank", segments=segments, total="_lf_total")
    keep = [c for c in ranked.columns if c not in ("_lf_rank", "_lf_total")]
    return ranked.select(*keep, ntile_from_rank("_lf_rank", "_lf_total", n).alias(out))


def running_counts(values: DataFrame, value: str, weights: Sequence[str], group_by: Sequence[str] = (),
                   segments: int | None = None) -> DataFrame:
    """Cumulative and total sums of ``weights`` per distinct value.

    ``values`` holds one row per (group, value).  Adds ``<weight>_upto`` (sum
    over the group's values up to this one) and ``<weight>_total``.  The rows
    are distinct, so range segments balance however many ties the data has.
    """
    group_by = list(group_by)
    seg = _segments(values, _cols(group_by) + [F.col(value)], segments)
    w = Window.partitionBy(SEG, *group_by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = seg.select("*", *[F.sum(c).over(w).alias(f"_lf_in_{c}") for c in weights])
    sums = seg.groupBy(SEG, *group_by).agg(*[F.sum(c).alias(c) for c in weights])
    grp = Window.partitionBy(*group_by)
    before = grp.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(SEG, *group_by, *[x for c in weights for x in (
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_lf_off_{c}"),
        F.sum(c).over(grp).alias(f"{c}_total"))])
    joined = _with_offsets(local, offsets, group_by)
    return joined.select(*values.columns, *[x for c in weights for x in (
        (F.col(f"_lf_in_{c}") + F.col(f"_lf_off_{c}")).alias(f"{c}_upto"), F.col(f"{c}_total"))])


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                      group_by: Sequence[str] = (), segments: int | None = None) -> DataFrame:
    """Linear-interpolated percentiles (``percentile_cont``) per group, exact.

    NULL values are ignored.  Rows are first reduced to one per (group, value)
    with its count, so neither ties nor a large group are gathered in one
    task; only the (at most two) values around each requested position leave
    the ranking step.  Returns one row per group that has a non-null value,
    with columns ``group_by + names``.
    """
    group_by = list(group_by)
    counts = (df.select(*group_by, F.col(value).cast("double").alias("_lf_v")).where(F.col("_lf_v").isNotNull())
              .groupBy(*group_by, "_lf_v").agg(F.count(F.lit(1)).alias("_lf_n")))
    ranked = running_counts(counts, "_lf_v", ["_lf_n"], group_by, segments)
    last = F.col("_lf_n_upto")
    first = last - F.col("_lf_n") + 1
    total = F.col("_lf_n_total")
    aggs, wanted = [], F.lit(False)
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (total - 1)
        low, high = (F.floor(pos) + 1).cast("long"), (F.ceil(pos) + 1).cast("long")
        at_low, at_high = low.between(first, last), high.between(first, last)
        wanted = wanted | at_low | at_high
        aggs += [F.max(F.when(at_low, F.col("_lf_v"))).alias(f"_lf_a{i}"),
                 F.max(F.when(at_high, F.col("_lf_v"))).alias(f"_lf_b{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_lf_f{i}")]
    out = ranked.where(wanted).groupBy(*group_by).agg(*aggs)
    return out.select(*group_by, *[
        (F.col(f"_lf_a{i}") + F.col(f"_lf_f{i}") * (F.col(f"_lf_b{i}") - F.col(f"_lf_a{i}"))).alias(name)
        for i, name in enumerate(names)])

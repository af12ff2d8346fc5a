"""Gap-based sessionization that survives a user holding a third of all events.

A new session starts at a user's first event and at every event more than
``gap`` after the previous one (ordered by timestamp, then event id); the
session number is the running count of starts.  The obvious
``Window.partitionBy(user)`` puts each user into a single task.  Instead the
events are range-partitioned on (user, ts, id) into ordered segments; lag and
running count are taken inside (segment, user), and a table with one row per
(segment, user) carries the last timestamp and the number of starts across
segment borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenflow.operators.ranking import SEG, _segments, join_on_keys


def sessionize(events: DataFrame, user: str, ts: str, order_id: str, gap_seconds: int,
               out: str = "session_seq", segments: int | None = None, keep: str = "write",
               first_id: str | None = None) -> DataFrame:
    """Add ``out`` = 1-based session number of each event within its user and,
    if ``first_id`` is given, the ``order_id`` of the session's first event.

    ``keep`` is passed to the segmenting step (see ``ranking._segments``).
    """
    gap = F.lit(int(gap_seconds) * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    base = events.withColumn("_lf_us", us)
    seg = _segments(base, [F.col(user), F.col("_lf_us"), F.col(order_id)], segments, keep=keep)
    w = Window.partitionBy(SEG, user).orderBy("_lf_us", order_id)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    prev = F.lag("_lf_us").over(w)
    start = F.when(prev.isNull() | ((F.col("_lf_us") - prev) > gap), 1).otherwise(0)
    # the first row of a user's segment opens a session or continues one, which
    # only the edges know; every other start is known here
    opened = F.when(prev.isNotNull() & ((F.col("_lf_us") - prev) > gap), F.col(order_id))
    local = seg.select("*", start.alias("_lf_start"), opened.alias("_lf_opened"))
    local = local.select("*", F.sum("_lf_start").over(upto).alias("_lf_cum"),
                         F.last("_lf_opened", ignorenulls=True).over(upto).alias("_lf_sid"))
    at = F.struct("_lf_us", F.col(order_id))
    edges = local.groupBy(SEG, user).agg(F.min("_lf_us").alias("_lf_first"),
                                         F.max("_lf_us").alias("_lf_last"),
                                         F.sum("_lf_start").alias("_lf_starts"),
                                         F.min_by(F.col(order_id), at).alias("_lf_head"),
                                         F.max_by(F.col("_lf_sid"), at).alias("_lf_tail"))
    # one row per (segment, user): bounded by the number of segments per user
    wu = Window.partitionBy(user).orderBy(SEG)
    earlier = wu.rowsBetween(Window.unboundedPreceding, -1)
    cont = (F.lag("_lf_last").over(wu).isNotNull()
            & ((F.col("_lf_first") - F.lag("_lf_last").over(wu)) <= gap)).cast("long")
    edges = edges.select(SEG, user, cont.alias("_lf_cont"), (F.col("_lf_starts") - cont).alias("_lf_adj"),
                         "_lf_head", "_lf_tail")
    # the session open at the end of a segment, null where the segment opens none
    edges = edges.withColumn("_lf_end", F.coalesce("_lf_tail", F.when(F.col("_lf_cont") == 0, F.col("_lf_head"))))
    edges = edges.select(
        SEG, user, "_lf_cont", F.coalesce(F.sum("_lf_adj").over(earlier), F.lit(0)).alias("_lf_off"),
        F.when(F.col("_lf_cont") == 0, F.col("_lf_head")).otherwise(
            F.last("_lf_end", ignorenulls=True).over(earlier)).alias("_lf_open"))
    joined = join_on_keys(local, edges, [SEG, user])
    drop = (SEG, "_lf_us", "_lf_start", "_lf_opened", "_lf_cum", "_lf_sid", "_lf_cont", "_lf_off", "_lf_open")
    keep = [c for c in joined.columns if c not in drop]
    ids = [F.coalesce("_lf_sid", "_lf_open").alias(first_id)] if first_id else []
    return joined.select(*keep, (F.col("_lf_off") + F.col("_lf_cum") - F.col("_lf_cont")).cast("long").alias(out), *ids)

"""Shared joins between user-grain and fact-grain frames.

Fact rows (sessions, events, plays) are joined to user attributes with the
fact on the *left/streamed* side, then aggregated per user with partial
(map-side) aggregation, and only then joined back to the user table 1:1.
That keeps the hot-user case splittable (AQE skew join may cut the fact side)
and never builds a users ⟕ facts left join whose right side cannot be split.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_user(fact: DataFrame, users: DataFrame, cols: Iterable[str],
                condition=None) -> DataFrame:
    """Inner-join user attributes onto fact rows (equi on user_id, optional residual)."""
    u = users.select("user_id", *cols)
    if condition is None:
        return fact.join(u, "user_id", "inner")
    f = fact.alias("f")
    j = f.join(u.alias("u"), (F.col("f.user_id") == F.col("u.user_id")) & condition(F.col), "inner")
    return j.select("f.*", *[F.col(f"u.{c}") for c in cols])


def back_to_users(users: DataFrame, per_user: DataFrame, zero_cols: Iterable[str] = ()) -> DataFrame:
    """users LEFT JOIN a one-row-per-user aggregate; counts of absent users become 0."""
    out = users.join(per_user, "user_id", "left")
    zero = set(zero_cols)
    if not zero:
        return out
    return out.select(*[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) if c in zero else F.col(c)
                        for c in out.columns])


def count_where(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END) as BIGINT."""
    return F.count(F.when(cond, F.lit(1))).cast("long")


def sum_flag(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) as BIGINT (NULL over no rows)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")

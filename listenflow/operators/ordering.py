"""Totally ordered results.

``ordered`` sorts by range exchange and a sort inside each range, so no task
holds the whole result.  Its keys end in a unique one: a group of ties as large
as a third of all rows is then cut at the unique key, and the order does not
change from run to run.  ``write_ordered`` keeps the order in files: the names
of the part files ascend with their ranges and every file is sorted.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenflow.operators.ranking import segment_count


def keys(names: Sequence[str]) -> list[Column]:
    """Sort keys from column names; ``-name`` sorts from high to low.  Missing
    values are last when ascending and first when descending."""
    return [F.col(n[1:]).desc_nulls_first() if n.startswith("-") else F.col(n).asc_nulls_last() for n in names]


def ordered(df: DataFrame, *names: str) -> DataFrame:
    """``df`` in the order of ``names``; if that leaves ties, their order is open."""
    return df.orderBy(*keys(names))


def write_ordered(df: DataFrame, path: str, *names: str, fmt: str = "parquet", ranges: int | None = None,
                  **options) -> None:
    """Part files whose concatenation by name is ``df`` in the order of ``names``."""
    by = keys(names)
    n = ranges or segment_count(df.sparkSession)
    (df.repartitionByRange(n, *by).sortWithinPartitions(*by)
     .write.mode("overwrite").options(**options).format(fmt).save(path))

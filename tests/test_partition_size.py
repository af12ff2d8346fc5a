"""What one task reads stays small, whatever the session came with."""

import pytest
from pyspark.sql import functions as F

from listenflow.session import PARTITION_BYTES, byte_count, configure

ADVISORY, SKEWED = PARTITION_BYTES


def test_sizes_as_spark_writes_them():
    assert [byte_count(s) for s in ("67108864b", "64MB", "8m", "16k", " 2 G ", "10")] == [
        64 << 20, 64 << 20, 8 << 20, 16 << 10, 2 << 30, 10]
    with pytest.raises(AttributeError):
        byte_count("-1")


def test_larger_sizes_are_lowered_and_smaller_ones_stay(spark):
    other = spark.newSession()
    for given, left in (("256MB", None), ("4m", 4 << 20)):
        for k, most in PARTITION_BYTES.items():
            other.conf.set(k, given)
            configure(other)
            assert byte_count(other.conf.get(k)) == (left or most)


def test_a_wide_shuffle_is_not_merged_into_one_task(spark):
    """Some 60 MB in 64 partitions: Spark's own 64 MB would give one or two tasks."""
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "64")
    configure(other)
    keys = other.range(900_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    counts = keys.groupBy("k").count().select(F.spark_partition_id().alias("p"))
    tasks = counts.groupBy("p").count().collect()
    assert sum(r["count"] for r in tasks) == 900_000
    assert len(tasks) > 3

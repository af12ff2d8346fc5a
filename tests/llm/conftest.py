import pytest


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The tables here are tiny: one shuffle partition each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)

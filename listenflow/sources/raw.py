"""Readers for the driver's parquet tables.

Only ``spark.read.parquet`` is used; Catalyst prunes the columns each analysis
touches and pushes its filters into the scan.  The inputs are read-only, so a
source is resolved (file listing, footer schema) once per application and the
same relation is reused by every analysis that reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_RESOLVED: dict[tuple[str, str], DataFrame] = {}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    df = _RESOLVED.get(key)
    if df is None or df.sparkSession is not spark:
        df = _RESOLVED[key] = spark.read.parquet(path)
    return df

"""Sinks: the materialized feature table and the CSV export."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from listenflow.operators.features import EXPORT_COLUMNS
from listenflow.sources.tables import create_if_absent


def save_feature_table(features: DataFrame, name: str = "user_day7_features",
                       path: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS: write once, leave an existing table alone.

    With ``path`` the table is Parquet files below that location and any number
    of writers may try at once: one of them makes the table, the others take it
    as it is, and one that dies half-way leaves none (see
    :mod:`listenflow.sources.tables`).  Without it, it is a managed table in
    the session catalog.
    """
    if not path:
        features.write.mode("ignore").format("parquet").saveAsTable(name)
        return
    spark = features.sparkSession
    folder, _ = create_if_absent(spark, path, lambda: features)
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=folder, source="parquet")


def export_features_csv(features: DataFrame, path: str, cols: Sequence[str] = EXPORT_COLUMNS,
                        mode: str = "overwrite") -> None:
    """The named columns with a header line; Spark writes one file per task
    into the folder ``path`` (no index column, no driver-side gather)."""
    features.select(*cols).write.mode(mode).option("header", True).csv(path)

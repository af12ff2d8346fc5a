"""Helpers shared by the training-data operators.

Every operator takes a DataFrame of documents plus the names of its id and
text columns, and first narrows it to ``(_id, _text)``: extra columns, also
ones whose names clash with an operator's own, never reach its joins.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenflow.session import discard, materialize

# Bounds of an Arrow batch sent to a Python worker, whichever is met first; a
# text beyond the bytes is a batch of its own.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20

SAMPLE_BYTES = 64 << 20     # bound of a labelled sample, besides its rows

SPACE = rb" \t\n\x0b\x0c\r"  # fixed: the white space that ends a word, [\x20\x09-\x0D]
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the Python-side operators rely on, and this package's
    folder on the Python workers' path (on a cluster, ship the package as usual)."""
    env = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # shuffle files go when the job that made them has ended; every frame read
    # twice is written to the shared folder instead
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           null_as_empty: bool = True) -> DataFrame:
    """``(_id, _text)``; a null text becomes empty unless told otherwise."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("_id"),
                       (F.coalesce(text, F.lit("")) if null_as_empty else text).alias("_text"))


def map_texts(docs: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over ``(_id, _text)`` batches.

    ``fn(ids, texts)`` gets a numpy id array (nulls as they are, see below)
    and an Arrow string array and returns an Arrow RecordBatch or table of
    ``schema``.  Rows with a null id are passed through as id null.
    """
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield fn(b.column(0), b.column(1))
    return docs.select("_id", "_text").mapInArrow(run, schema)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, without decoding them."""
    return texts.cast(pa.binary()).to_pylist()


def held_out(id_col: Column) -> Column:
    """The fixed evaluation fold: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, max_rows: int,
                    docs: DataFrame | None = None, max_bytes: int = SAMPLE_BYTES) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled training texts of at most ``max_bytes``
    together, never from the held-out fold.

    The rows are the ones with the smallest hash of their id, so the sample
    does not depend on partitioning; an id gives one text, the least of its
    rows, and a text that no longer fits ends the sample.  Ids are chosen from
    ``labels`` alone; the texts are then fetched with a broadcast of at most
    ``max_rows`` ids, so all texts are scanned once, and those of the chosen
    ids are reduced to one an id before they are shuffled.
    """
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    lab = (table(spark, sf_dir, "labels")
           .select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
           .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
           .groupBy("_id").agg(F.max("_y").alias("_y")))
    picked = lab.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    found = materialize(narrow(docs).join(F.broadcast(picked), "_id")
                        .groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_y").alias("_y"))
                        .select(F.xxhash64("_id").alias("h"), "_id", "_text", "_y", F.octet_length("_text").alias("size")))
    # at most max_rows narrow rows in the window
    fits = (found.select("_id", F.sum("size").over(Window.orderBy("h", "_id")).alias("upto"))
            .where(F.col("upto") <= max_bytes).select("_id"))
    rows = found.join(F.broadcast(fits), "_id").select("h", "_id", "_text", "_y").collect()
    discard(found)
    rows.sort(key=lambda r: (r.h, r._id))
    return [(r._text, int(r._y)) for r in rows]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; LISTENFLOW_TOKENIZERS overrides the folder."""
    root = os.environ.get("LISTENFLOW_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers
    return public_tokenizers.path(name)

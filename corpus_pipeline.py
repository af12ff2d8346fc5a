"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, secret scans, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the
result is written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.llm import exact_dedup, jaccard_join, packing, secret_scan, toxicity
from listenflow.llm.common import prepare, table
from listenflow.session import materialize


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier (fitted on ``labels``) rejects go."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.fit_from_labels(spark, sf_dir))


def remove_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    prepare(spark)
    return exact_dedup.drop_exact_duplicates(docs)


NEAR_SIMILARITY = 80    # percent
NEAR_SHINGLE = 5        # words


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str,
                       similarity: int = jaccard_join.SIMILARITY, shingle: int = jaccard_join.SHINGLE) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.
    The defaults are those of the query op7."""
    prepare(spark)
    return jaccard_join.keep_one_per_group(docs, similarity=similarity, shingle=shingle)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's near copies: shingles of ``NEAR_SHINGLE`` words, a Jaccard
    similarity of at least ``NEAR_SIMILARITY`` percent."""
    return remove_near_copies(spark, docs, sf_dir, NEAR_SIMILARITY, NEAR_SHINGLE)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked and ``n_chars`` follows; no document goes."""
    prepare(spark)
    masked = secret_scan.mask_secrets(docs)
    if "n_chars" not in masked.columns:
        return masked
    kind = masked.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text")).cast(kind))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_exact_copies),
    ("n-gram Jaccard join", near_copies_stage),
    ("secret scans", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs


# A fitted classifier and an LP-based packing have no SQL form; tests compare
# the stages with brute-force versions.
ORACLE_SQL = None

"""Exact duplicates by progressive refinement (native DataFrame operations only).

Level 1 groups documents by byte length, level 2 the surviving groups by a
hash of the first ``prefix_chars`` characters, level 3 the surviving groups
by the SHA-256 of the whole text.  A level counts its keys with partial
aggregates before the shuffle (a group that holds a third of all rows costs one
row per task), keeps the keys that occur more than once, and passes on only the
rows that hold one of them.  Lengths and prefixes are counted together, by
length and prefix hash, so that no join is keyed by the length alone, of which
one may be hot.  Texts are hashed after that join, so only the texts of
surviving groups are; adaptive execution splits the join where one key is hot,
and broadcasts the keys where they are few, so that texts stay where they are.

Defined cases: a null text counts as empty; empty texts are equal to each
other; of equal texts the largest id stays, and rows that repeat that id with
that text count in ``group_size`` and all carry ``kept``; an empty table gives
an empty result; a null id is never larger than another id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenflow.llm.common import narrow
from listenflow.session import materialize

PREFIX_CHARS = 256


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)


def _keys(text: str, prefix_chars: int) -> list:
    return [F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix")]


def _survivors(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``_id, _len, _prefix, _sha`` of the rows whose length and prefix occur again."""
    text = narrow(docs, id_col, text_col).select("_id", "_text", *_keys("_text", prefix_chars))
    again = _repeated(text.select("_len", "_prefix"), ["_len", "_prefix"])
    return (text.join(again, ["_len", "_prefix"], "left_semi")
            .select("_id", "_len", "_prefix", F.sha2("_text", 256).alias("_sha")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per text that occurs more than once: ``_len, _sha, keep_id, group_size``."""
    return (_survivors(docs, id_col, text_col, prefix_chars).groupBy("_len", "_sha")
            .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.
    The digest of every text belongs to the result; the groups do without it."""
    rows = narrow(docs, id_col, text_col).select(
        "_id", F.octet_length("_text").alias("_len"), F.sha2("_text", 256).alias("_sha"))
    groups = duplicate_groups(docs, id_col, text_col, prefix_chars)
    joined = rows.join(groups, ["_len", "_sha"], "left")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id repeats.

    The columns of ``docs`` are kept; rows that repeat both id and text
    collapse to one.
    """
    rows = materialize(_survivors(docs, id_col, text_col, PREFIX_CHARS))
    last = rows.groupBy("_len", "_sha").agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    each = rows.join(last, ["_len", "_sha"]).groupBy("_id", "_len", "_prefix", "_sha", "_last").agg(
        F.count(F.lit(1)).alias("_c"))
    # rows that go, and rows of which one of several equal ones stays
    named = materialize(each.where(~F.col("_id").eqNullSafe(F.col("_last")) | (F.col("_c") > 1)).select(
        F.coalesce("_id", F.lit(0)).alias("_lf_i"), F.col("_id").isNull().alias("_lf_u"), F.col("_len").alias("_lf_l"),
        F.col("_prefix").alias("_lf_p"), F.col("_sha").alias("_lf_s"),
        F.col("_id").eqNullSafe(F.col("_last")).alias("_lf_once")))
    key = F.col(id_col).cast("long")
    length, prefix = _keys("_lf_text", PREFIX_CHARS)
    full = docs.withColumn("_lf_text", F.coalesce(F.col(text_col), F.lit(""))).withColumns(
        {"_lf_id": F.coalesce(key, F.lit(0)), "_lf_null": key.isNull(), "_lf_len": length, "_lf_prefix": prefix})
    # the digest is a condition on rows whose id, length and prefix are those of a named row
    match = ((F.col("_lf_id") == F.col("_lf_i")) & (F.col("_lf_null") == F.col("_lf_u")) & (F.col("_lf_len") == F.col("_lf_l"))
             & (F.col("_lf_prefix") == F.col("_lf_p")) & (F.sha2("_lf_text", 256) == F.col("_lf_s")))
    out = full.join(named, match, "left_anti").select(*docs.columns)
    once = named.where("_lf_once")
    if once.limit(1).count():       # rows that repeat id and text
        back = full.join(once, match).dropDuplicates(["_lf_i", "_lf_u", "_lf_s"]).select(*docs.columns)
        out = out.union(back)
    return out


def op5_query(spark, sf_dir: str) -> DataFrame:
    from listenflow.llm.common import prepare, table
    prepare(spark)
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

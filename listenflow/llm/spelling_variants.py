"""Spelling variants by pivotal grams.

Words are grouped with the words at an edit distance of exactly one code point.

*Pivots and prefixes.*  The bigrams of the words are ordered by the number of
words that hold them, rarest first.  A word's prefix is its three rarest
bigrams (with their positions), and every further one as rare as the third.
One edit touches at most one of two disjoint bigrams, and any three bigrams
hold two disjoint ones; a dynamic program over the prefix picks the two
disjoint ones with the fewest words, the pivots.  If two words are near and
the prefix of the first ends no later in the order than that of the second, a
pivot of the first stands in the second, hence in its prefix.

*Position limits.*  Its position there is the same or moves with the length:
by +1 or 0 in a word longer by one, -1 or 0 in a shorter one, 0 in one of equal
length.  So the join key holds gram, position and length.  It also holds a half
of the word: near words share the first or the last ``k`` characters, ``k``
half of the shorter length, so that a common gram does not bring all
of its words together.  Every candidate is verified by its edit distance.

Only the bigram counts reach the driver: at most the square of the 90 letters,
whatever the input.

Defined cases: a null text has no word; a null id counts as an empty id in the
deletion rule; repeated rows count again; of forms with equal counts the
smallest in code-point order is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.llm.common import prepare, table
from listenflow.session import materialize

LETTERS = "a-zÀ-ÿ"    # after lower-casing A-Z
MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2                       # a form has at least this many times the count
GRAM = 2
EDITS = 1
PREFIX = GRAM * EDITS + 1
DAMAGED = 97                    # one run in so many loses a character


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, damaged: int | None = DAMAGED) -> DataFrame:
    """``word, n``: runs of letters, lower-cased (A-Z), of all whole texts.

    With ``damaged``, runs whose ``crc32(<id>:<run>)`` it divides lose the
    character at that hash modulo their length.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(ids.alias("i"), F.explode(F.regexp_extract_all(
        F.translate(F.col(text_col), upper, upper.lower()), F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("w"))
    w = F.col("w")
    if damaged:
        h = F.crc32(F.concat("i", F.lit(":"), "w").cast("binary"))
        at = (h % F.length(w)).cast("int")
        cut = F.concat(F.substr(w, F.lit(1), at), F.substr(w, at + 2))
        w = F.when(h % damaged == 0, cut).otherwise(w)
    return (runs.select(w.alias("word")).where(F.length("word") >= min_chars)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """bigram -> (place in the order, words that hold it)."""
    at = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.array_distinct(F.transform(at, lambda i: F.substr(F.col("word"), i, F.lit(GRAM))))).alias("g"))
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).collect()
    return {r.g: (i, r.df) for i, r in enumerate(sorted(counts, key=lambda r: (r.df, r.g)))}


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """Place of the prefix's last gram, the pivots and the prefix, as (gram place, position)."""
    grams = sorted((order[word[i:i + GRAM]][0], i) for i in range(len(word) - GRAM + 1))
    last = grams[PREFIX - 1][0]
    prefix = [g for g in grams if g[0] <= last]
    weight = {i: order[word[i:i + GRAM]][1] for _, i in prefix}
    # dynamic program over positions: least weight of k disjoint grams among the first ones
    by_place = sorted((i, place) for place, i in prefix)
    best: list[list[tuple[int, tuple] | None]] = [[(0, ())] + [None] * (EDITS + 1)]
    for j, (i, place) in enumerate(by_place):
        before = sum(1 for other, _ in by_place[:j] if other + GRAM <= i)
        row = list(best[-1])
        for k in range(1, EDITS + 2):
            rest = best[before][k - 1]
            if rest is not None:
                mine = (rest[0] + weight[i], (*rest[1], (place, i)))
                row[k] = mine if row[k] is None else min(row[k], mine)
        best.append(row)
    return last, list(best[-1][EDITS + 1][1]), prefix


def _signatures(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    sent = words.sparkSession.sparkContext.broadcast(order)
    grams = pa.list_(pa.struct([("g", pa.int32()), ("p", pa.int32())]))

    def run(batches):
        ranks = sent.value
        for b in batches:
            out = [signature(w, ranks) for w in b.column(0).to_pylist()]
            pairs = [[[{"g": g, "p": p} for g, p in s[k]] for s in out] for k in (1, 2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([s[0] for s in out], pa.int32()),
                                   pa.array(pairs[0], grams), pa.array(pairs[1], grams)],
                                  names=["word", "n", "last", "pivots", "prefix"])
    gram = "array<struct<g:int,p:int>>"
    return words.select("word", "n").mapInArrow(run, f"word string, n long, last int, pivots {gram}, prefix {gram}")


def _half(size: Column, other: Column) -> Column:
    return F.floor(F.least(size, other) / 2).cast("int")


def _keys(rows: DataFrame) -> DataFrame:
    """One row per half, from ``g, at, len, k`` (the place in the indexed word)."""
    k = F.col("k")
    ends = F.array(F.xxhash64("g", "at", "len", "k", F.lit(0), F.substr("word", F.lit(1), k)),
                   F.xxhash64("g", "at", "len", "k", F.lit(1), F.substr(F.col("word"), F.length("word") - k + 1, k)))
    return rows.select(F.explode(ends).alias("key"), "word", "n", "last")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, na, b, nb``: every two words (of at least four characters) at an edit
    distance of one, once; ``words`` holds ``word, n``."""
    signed = materialize(_signatures(words, gram_order(words)))
    size = F.length("word")
    moves = F.array(*[F.struct(F.lit(step).alias("step"), F.lit(longer).alias("longer"))
                      for step, longer in ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))])
    pivots = (signed.select("word", "n", "last", F.explode("pivots").alias("x"))
              .select("word", "n", "last", "x", F.explode(moves).alias("m"))
              .select("word", "n", "last", F.col("x.g").alias("g"), (F.col("x.p") + F.col("m.step")).alias("at"),
                      (size + F.col("m.longer")).alias("len"), _half(size, size + F.col("m.longer")).alias("k")))
    halves = F.array_distinct(F.array(_half(size, size), _half(size, size - 1)))
    prefix = (signed.select("word", "n", "last", F.explode("prefix").alias("x"))
              .select("word", "n", "last", "x", F.explode(halves).alias("k"))
              .select("word", "n", "last", F.col("x.g").alias("g"), F.col("x.p").alias("at"), size.alias("len"), "k"))
    a, b = _keys(pivots).alias("a"), _keys(prefix).alias("b")
    near = a.join(b, F.col("a.key") == F.col("b.key")).where(
        (F.col("a.last") <= F.col("b.last")) & (F.col("a.word") != F.col("b.word"))
        & (F.levenshtein("a.word", "b.word", EDITS) == EDITS))
    first = F.col("a.word") < F.col("b.word")

    def one(c: str, d: str) -> Column:
        return F.when(first, F.col(c)).otherwise(F.col(d))
    return (near.select(one("a.word", "b.word").alias("a"), one("a.n", "b.n").alias("na"),
                        one("b.word", "a.word").alias("b"), one("b.n", "a.n").alias("nb")).distinct())


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, n, n_near, form_n`` of every word."""
    def side(word: str, other: str, n: str) -> Column:
        return F.struct(F.col(word).alias("word"), F.col(other).alias("w"), F.col(n).alias("c"))
    sides = pairs.select(F.inline(F.array(side("a", "b", "nb"), side("b", "a", "na"))))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("c"), "w")).alias("best"))
    known = -F.col("best.col1") >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", F.when(known, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, -F.col("best.col1")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """Adds ``root``: the last of a word's forms.  Counts at least double from
    word to form, so pointer jumping ends after few rounds."""
    to = materialize(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("up"))
        to = materialize(to.join(step, "root", "left").select("word", F.coalesce("up", "root").alias("root"),
                                                              F.col("up").isNotNull().alias("moved")))
        if to.where("moved").limit(1).count() == 0:
            break
        to = to.select("word", "root")
    return (found.join(to.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, damaged: int | None = DAMAGED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts."""
    if min_chars < PREFIX + GRAM - 1:
        raise ValueError(f"words need at least {PREFIX + GRAM - 1} characters")
    words = materialize(word_counts(docs, id_col, text_col, min_chars, min_count, damaged))
    return roots(materialize(forms(words, near_pairs(words), ratio)))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spelling_variants(table(spark, sf_dir, "documents"))


# crc32 by its table over the bytes; words are near if one is the other without
# a character, or if both are equal without the character at one position
OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i] || [x::BIGINT for x in range(8)],
                          lambda y, x: xor(y >> 1, 3988292384 * (y & 1))) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
runs AS (
  SELECT doc_id, w, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-zÀ-ÿ]+')) AS w FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT w, c, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs),
summed AS (
  SELECT w, c, xor(4294967295, list_reduce([4294967295::BIGINT] || [('0x' || substr(x, 2 * i + 1, 2))::BIGINT for i in range(length(x) // 2)],
                                           lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1]))) AS h
  FROM hashed, crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
without AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT d.word AS a, d.n AS na, w.word AS b, w.n AS nb FROM without d JOIN words w ON w.word = d.v),
near AS (
  SELECT a, na, b, nb FROM shorter UNION SELECT b, nb, a, na FROM shorter
  UNION SELECT x.word, x.n, y.word, y.n FROM without x JOIN without y ON x.v = y.v AND x.i = y.i AND x.word <> y.word),
best AS (
  SELECT a AS word, count(*) AS n_near, first(b ORDER BY nb DESC, b) AS b, max(nb) AS nb, first(na) AS na FROM near GROUP BY a),
found AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN nb >= 2 * na THEN b END AS form,
         CASE WHEN nb >= 2 * na THEN nb END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
follow(word, root, form) AS (
  SELECT word, word, form FROM found
  UNION ALL
  SELECT follow.word, found.word, found.form FROM follow JOIN found ON found.word = follow.form)
SELECT found.word, found.form, follow.root, found.n, found.n_near, found.form_n
FROM found JOIN follow ON follow.word = found.word AND follow.form IS NULL
"""

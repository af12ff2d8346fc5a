"""Language identification in two steps: family first, then one-versus-one
linear support vector machines between the languages of that family.

*Features.*  A text becomes its letters in lower case, every run of anything
else one blank; 1- to 3-grams of that string, over the *whole* text, are hashed
into ``2**BITS`` counts, whose square roots are scaled to unit length.

*Families* are learned: the languages' mean vectors are merged, the two most
alike (average linkage) first, until about the square root of their number is
left.  One linear machine per family, against the rest, picks the family; in it
every pair of languages has a machine of its own, and the language with most
wins is predicted (ties: larger sum of margins, then name).  The machines are
fitted by dual coordinate descent on the squared hinge loss.

*Bounds.*  The fit uses at most ``TRAIN_ROWS`` rows and ``TRAIN_BYTES`` bytes of
text, shared evenly by the at most ``LANGUAGES`` languages with most rows (the
rows with the smallest hash of their id, one per id, never from the held-out
fold); the model has at most ``LANGUAGES`` times the root of it weight vectors
whatever the input, and is broadcast to the scoring tasks.

Defined cases: null texts and texts without a letter are ``und`` with score
0; with no training row every text is ``und``; with one language every text
with a letter is of that language, with score 1; a null id is in no fold; an id
that is repeated gives one training row, the least by language and text;
repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenflow.llm.common import held_out, map_texts, narrow, prepare, sigmoid, table
from listenflow.session import materialize

BITS = 12
SIZES = 3                   # n-grams of 1 to 3 symbols
TRAIN_ROWS = 3000
TRAIN_BYTES = 48 << 20
LANGUAGES = 256
COST = 4.0
EPOCHS = 60
SHARPNESS = 3.0             # of margins in scores
BLOCK = 1 << 20             # characters featurised at a time
UNKNOWN = "und"
BLANK = 32


def _fold(c: int) -> int:
    """Lower-case letter, or a blank."""
    s = chr(c)
    if not s.isalpha():
        return BLANK
    low = s.lower()
    return ord(low) if len(low) == 1 else c


_TABLE: np.ndarray | None = None


def _folded(a: np.ndarray) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = np.array([_fold(c) for c in range(1 << 16)], np.uint32)
    high = a >= 1 << 16
    out = _TABLE[np.where(high, 0, a)]
    for c in np.unique(a[high]):
        out[a == c] = _fold(int(c))
    return out


def ngram_counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None without a letter."""
    counts = np.zeros(1 << BITS, np.int64)
    kept = np.array([BLANK], np.uint32)         # the text starts behind a blank
    letters = False
    for i in range(0, len(text), BLOCK):
        t = _folded(np.frombuffer(text[i:i + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32))
        new = t[(t != BLANK) | (np.concatenate([kept[-1:], t[:-1]]) != BLANK)]
        if not len(new):
            continue
        letters = letters or bool((new != BLANK).any())
        s = np.concatenate([kept, new])
        h = s * np.uint32(0x9E3779B1)
        for n in range(1, SIZES + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + s[n - 1:]
            ends = h[-len(new):] if len(h) > len(new) else h    # n-grams that end in this block
            counts += np.bincount((ends * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS), minlength=1 << BITS)
        kept = s[-(SIZES - 1):]
    return counts if letters else None


def features(text: str) -> np.ndarray | None:
    counts = ngram_counts(text)
    if counts is None:
        return None
    x = np.sqrt(counts).astype(np.float32)
    return x / np.float32(np.sqrt(counts.sum()))


def families_of(means: np.ndarray, count: int) -> list[list[int]]:
    """The rows of ``means`` in ``count`` groups, by average linkage of their cosines."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > count:
        a, b = max(combinations(range(len(groups)), 2),
                   key=lambda p: (alike[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
    return sorted(groups)


def linear_svm(gram: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``alpha * y`` of the squared-hinge machine over a Gram matrix; both
    classes weigh alike."""
    n = len(y)
    cost = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))) * COST
    q = gram * np.outer(y, y)
    ridge = 1 / (2 * cost)
    alpha, grad = np.zeros(n), -np.ones(n)      # grad: Q alpha - 1
    for _ in range(EPOCHS):
        moved = 0.0
        for i in range(n):
            new = max(0.0, alpha[i] - (grad[i] + ridge[i] * alpha[i]) / (q[i, i] + ridge[i]))
            step = new - alpha[i]
            if step:
                grad += step * q[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return alpha * y


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    family_w: np.ndarray        # a row per family, bias last; empty for one family
    pairs: list[tuple[int, int]]
    pair_w: np.ndarray          # a row per pair of languages of a family: above 0 for the first

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each text (None: null)."""
        names, scores = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            x = features(text) if text is not None and self.languages else None
            if x is None:
                names.append(UNKNOWN)
                continue
            x = np.append(x, np.float32(1))
            names.append(None)
            names[-1], scores[i] = self.decide(x)
        return names, scores

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        if len(self.families) == 1:
            family, score = 0, 1.0
        else:
            z = SHARPNESS * (self.family_w @ x).astype(np.float64)
            family = int(np.argmax(z))
            score = 1 / float(np.exp(z - z[family]).sum())
        members = self.families[family]
        if len(members) == 1:
            return self.languages[members[0]], round(score, 6)
        wins, margin = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        own = [k for k, (a, _) in enumerate(self.pairs) if a in wins]
        for k, d in zip(own, (self.pair_w[own] @ x).astype(np.float64)):
            a, b = self.pairs[k]
            wins[a if d >= 0 else b] += 1
            margin[a] += d
            margin[b] -= d
        best = min(members, key=lambda m: (-wins[m], -round(margin[m], 6), self.languages[m]))
        return self.languages[best], round(score * float(sigmoid(SHARPNESS * margin[best] / (len(members) - 1))), 6)


def fit_languages(rows: list[tuple[str, str]]) -> LanguageModel:
    """Fits on (text, language) rows; texts without a letter are left out."""
    pairs_ = [(x, lang) for t, lang in rows if (x := features(t)) is not None]
    languages = sorted({lang for _, lang in pairs_})
    width = (1 << BITS) + 1
    empty = np.zeros((0, width), np.float32)
    if not languages:
        return LanguageModel([], [], empty, [], empty)
    x = np.append(np.array([f for f, _ in pairs_], np.float32), np.ones((len(pairs_), 1), np.float32), axis=1)
    y = np.array([languages.index(lang) for _, lang in pairs_])
    means = np.array([x[y == k, :-1].mean(axis=0) for k in range(len(languages))])
    families = families_of(means, max(1, round(len(languages) ** 0.5)))
    gram = (x @ x.T).astype(np.float64)

    def machine(rows_: np.ndarray, first: np.ndarray) -> np.ndarray:
        weight = linear_svm(gram[np.ix_(rows_, rows_)], np.where(first, 1.0, -1.0))
        return (weight @ x[rows_]).astype(np.float32)
    everything = np.arange(len(y))
    family_w = [machine(everything, np.isin(y, f)) for f in families] if len(families) > 1 else []
    pairs = [p for f in families for p in combinations(f, 2)]
    pair_w = [machine(np.flatnonzero((y == a) | (y == b)), y[(y == a) | (y == b)] == a) for a, b in pairs]
    return LanguageModel(languages, families, np.array(family_w) if family_w else empty, pairs,
                         np.array(pair_w) if pair_w else empty)


def training_sample(docs: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES,
                    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most ``max_rows`` (text, language) rows and ``max_bytes`` of text."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).cast("string").alias("_lang"),
                       F.col(text_col).alias("_text"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull()
                      & ~held_out(F.col("_id")))
    counts = (rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("c"))
              .orderBy(F.desc("c"), "_lang").limit(min(LANGUAGES, max_rows)).collect())
    if not counts:
        return []
    quota, quota_bytes = max_rows // len(counts), max_bytes // len(counts)
    spark = docs.sparkSession
    # a few times the quota by a threshold on the hash, so that no window gets a whole language
    share = F.broadcast(spark.createDataFrame([(r._lang, min(1.0, 3 * quota / r.c)) for r in counts],
                                              "_lang string, share double"))
    u = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = materialize(rows.join(share, "_lang").where(u < F.col("share"))
                         .groupBy("_id").agg(F.min(F.struct("_lang", "_text")).alias("x"))
                         .select("_id", "x._lang", "x._text", F.octet_length("x._text").alias("size")))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    kept = (picked.select("_id", "_lang", "size")
            .select("_id", F.row_number().over(order).alias("k"), F.sum("size").over(order).alias("upto"))
            .where((F.col("k") <= quota) & (F.col("upto") <= quota_bytes)).select("_id"))
    found = picked.join(F.broadcast(kept), "_id").collect()
    return [(r._text, r._lang) for r in sorted(found, key=lambda r: r._id)]


SCHEMA = "doc_id long, lang_pred string, score double"


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        names, scores = sent.value.predict(texts.to_pylist())
        return pa.record_batch([ids, pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])
    found = map_texts(narrow(docs, id_col, text_col, null_as_empty=False), run, SCHEMA)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def fit_from_documents(docs: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> LanguageModel:
    return fit_languages(training_sample(docs, max_rows, max_bytes))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_from_documents(docs))

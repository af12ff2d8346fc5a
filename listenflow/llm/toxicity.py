"""Toxicity: linear classifier over character n-grams scaled by naive-Bayes
log-count ratios.

A text is lower-cased and every n-gram of 3 to 5 characters of the *whole*
text is hashed into ``2**BITS`` features; a feature counts once per text.
Each feature is scaled by its naive-Bayes log-count ratio
``r = log((p_t + a) / (n_t + 2 a)) - log((p_c + a) / (n_c + 2 a))``, where ``p_t``
of ``n_t`` toxic and ``p_c`` of ``n_c`` clean training texts hold it, and a
logistic regression is fitted on the scaled features.

The fit uses at most ``TRAIN_ROWS`` labelled rows (the ones with the smallest
hash of their id, never from the held-out fold); the model is a vector of
``2**BITS`` floats whatever the input size, and is broadcast to the scoring
tasks.  Labels, lang, source and id are no inputs of a score.

Defined cases: null and empty texts, and texts of fewer than three
characters, have no feature and get the score of the intercept; with no
labelled row, or labels of one class only, every score is the share of toxic
training rows (0.0 without any); an empty table gives an empty result;
repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.llm.common import held_out, labelled_sample, map_texts, narrow, prepare, sigmoid, table

BITS = 18
SIZES = (3, 4, 5)
TRAIN_ROWS = 6000       # bound of the labelled sample
SMOOTH = 1.0
MIN_TEXTS = 3           # training texts a feature must occur in
FEATURES = 1 << 13      # features kept: the ones whose ratio is furthest from 0 in standard errors
L2 = 1.0
STEPS = 150
THRESHOLD = 0.5


def ngram_features(text: str) -> np.ndarray:
    """Distinct hashed n-grams of the whole text (feature numbers, unordered)."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(a) < SIZES[0]:
        return np.empty(0, np.int32)
    h = a * np.uint32(0x9E3779B1)
    parts = []
    for n in range(2, SIZES[-1] + 1):
        if len(a) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + a[n - 1:]
        if n in SIZES:
            parts.append(((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)).astype(np.int32))
    return np.concatenate(parts)


class _Distinct:
    """Distinct values of a feature array without sorting it: the last
    position of each value wins."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int32)

    def __call__(self, f: np.ndarray) -> np.ndarray:
        at = np.arange(len(f), dtype=np.int32)
        self.last[f] = at
        return f[self.last[f] == at]


@dataclass
class ToxicityModel:
    weights: np.ndarray     # ratio times coefficient, per feature
    bias: float

    def score(self, texts) -> np.ndarray:
        distinct = _Distinct()
        z = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = ngram_features(t or "")
            # float64 sum over features in ascending order would need a sort;
            # rounding keeps the result independent of their order
            z[i] = round(float(self.weights[distinct(f)].sum(dtype=np.float64)), 9) if len(f) else 0.0
        return sigmoid(z + self.bias)


def fit_toxicity(rows: list[tuple[str, int]]) -> ToxicityModel:
    size = 1 << BITS
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 0.0, 1.0))
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))))
    distinct = _Distinct()
    feats = [np.sort(distinct(f)) if len(f := ngram_features(t or "")) else f for t, _ in rows]
    toxic, clean = np.zeros(size), np.zeros(size)
    for f, label in zip(feats, y):
        (toxic if label else clean)[f] += 1
    keep = toxic + clean >= MIN_TEXTS
    t, c = toxic + SMOOTH, clean + SMOOTH
    # documents, not n-grams, are counted: each ratio compares shares of texts
    ratio = np.where(keep, np.log(t / (y.sum() + 2 * SMOOTH)) - np.log(c / (len(y) - y.sum() + 2 * SMOOTH)), 0.0)
    strength = np.abs(ratio) / np.sqrt(1 / t + 1 / c)
    if keep.sum() > FEATURES:
        keep &= strength >= np.partition(strength, size - FEATURES)[size - FEATURES]
        ratio[~keep] = 0.0
    feats = [f[keep[f]] for f in feats]
    lens = np.array([len(f) for f in feats])
    flat = np.concatenate(feats)
    row_of = np.repeat(np.arange(len(feats)), lens)
    x = ratio[flat].astype(np.float32)
    # logistic regression on the scaled features, classes weighted alike,
    # by gradient descent with momentum; one factor brings the median row to unit length
    norm = np.sqrt(np.maximum(np.bincount(row_of, x.astype(np.float64) ** 2, len(feats)), 1e-12))
    scale = 1.0 / np.median(norm)
    x *= np.float32(scale)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(size, np.float32), 0.0
    vw, vb, rate = np.zeros(size, np.float32), 0.0, 4.0
    for _ in range(STEPS):
        z = np.bincount(row_of, w[flat] * x, len(feats)) + b
        g = (sigmoid(z) - y) * weight
        gw = np.bincount(flat, g[row_of] * x, size).astype(np.float32) + np.float32(L2 * 1e-3) * w
        vw = np.float32(0.9) * vw + gw
        vb = 0.9 * vb + g.sum()
        w -= np.float32(rate * 0.1) * vw
        b -= rate * 0.1 * vb
    return ToxicityModel((w * ratio * scale).astype(np.float32), float(b))


SCHEMA = "doc_id long, score double"


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(ids, texts):
        weights, bias = sent.value
        return pa.record_batch([ids, pa.array(ToxicityModel(weights, bias).score(texts.to_pylist()))],
                               names=["doc_id", "score"])

    scored = map_texts(narrow(docs, id_col, text_col), run, SCHEMA)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` the model does not call toxic, all columns, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    schema = docs.schema

    def run(batches):
        weights, bias = sent.value
        m = ToxicityModel(weights, bias)
        at = schema.names.index(text_col)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(m.score(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, schema)


def fit_from_labels(spark: SparkSession, sf_dir: str, max_rows: int = TRAIN_ROWS) -> ToxicityModel:
    return fit_toxicity(labelled_sample(spark, sf_dir, "toxic", max_rows))


def op10_query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_toxicity(table(spark, sf_dir, "documents"), fit_from_labels(spark, sf_dir))

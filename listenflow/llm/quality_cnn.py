"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes are applied at every ``STRIDE``-th byte of the whole
text.  Their rectified responses are max-pooled over overlapping chunks
(``CHUNK`` positions, moving by half a chunk) that together cover the text;
the mean and the maximum of the chunk vectors over the text feed a small dense
layer and one logistic output.  Gradients flow through the pooling to the
winning positions only.  The filters are held as one table of responses per
byte pair, so a convolution is ``WIDTH / 2`` table look-ups per position.

The network is fitted on at most ``TRAIN_ROWS`` labelled rows (the ones with
the smallest hash of their id, never from the held-out fold) by Adam with a
fixed seed; its size does not depend on the input, and it is broadcast to the
scoring tasks.  Labels, lang, source and id are no inputs of a score.

Defined cases: null and empty texts are one chunk of zero bytes; very long
texts are convolved in blocks of bounded size with the pooled chunks kept;
with no labelled row, or labels of one class only, every score is the share of
good training rows (1.0 without any); repeated rows are scored alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.llm.common import held_out, labelled_sample, map_texts, narrow, prepare, sigmoid, table, utf8

FILTERS = 16
WIDTH = 6               # bytes of a filter
STRIDE = 2              # bytes between positions
CHUNK = 128             # positions of a chunk; chunks overlap by half
HIDDEN = 16
TRAIN_ROWS = 2500       # bound of the labelled sample
EPOCHS = 14
BATCH = 32
RATE = 0.01
THRESHOLD = 0.3
BLOCK = 1 << 19         # positions convolved at once
HALF = CHUNK // 2


def byte_rows(raw: bytes) -> np.ndarray:
    """Byte pairs of a text padded to whole half chunks (at least one chunk)."""
    halves = max(2, -(-(len(raw) + WIDTH) // (HALF * STRIDE)))
    need = halves * HALF * STRIDE + WIDTH - STRIDE
    return np.frombuffer(raw.ljust(need, b"\0"), np.uint8, count=need).reshape(-1, 2)


@dataclass
class Net:
    filters: np.ndarray     # (WIDTH, 256, FILTERS): response of each byte at each place
    bias: np.ndarray        # (FILTERS,)
    w1: np.ndarray          # (2 * FILTERS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray          # (HIDDEN,)
    b2: np.ndarray          # (1,)

    def params(self):
        return [self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pair_tables(self) -> list[np.ndarray]:
        """One (65536, FILTERS) table per byte pair of the filter."""
        return [(self.filters[i][None, :, :] + self.filters[i + 1][:, None, :]).reshape(65536, FILTERS)
                for i in range(0, WIDTH, 2)]

    def half_chunks(self, pairs: np.ndarray, tables) -> np.ndarray:
        """Maximal response of every filter in each half chunk."""
        n = len(pairs) - len(tables) + 1
        out = tables[0][pairs[:n]]
        for k in range(1, len(tables)):
            out += tables[k][pairs[k:n + k]]
        return out.reshape(-1, HALF, FILTERS).max(axis=1)

    def pooled(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chunks = np.maximum(np.maximum(halves[:-1], halves[1:]) + self.bias, 0)
        return chunks.mean(axis=0), chunks.max(axis=0)

    def output(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, texts: list[bytes]) -> np.ndarray:
        tables = self.pair_tables()
        x = np.empty((len(texts), 2 * FILTERS), np.float32)
        waiting, held = [], 0

        def flush():
            nonlocal waiting, held
            if waiting:
                # texts are laid end to end with their padding; positions that
                # straddle two texts are skipped
                for i, halves in zip([i for i, _ in waiting], self._many([p for _, p in waiting], tables)):
                    x[i] = np.concatenate(self.pooled(halves))
            waiting, held = [], 0

        for i, raw in enumerate(texts):
            rows = byte_rows(raw)
            pairs = rows[:, 0].astype(np.int32) | rows[:, 1].astype(np.int32) << 8
            if len(pairs) > BLOCK:
                tail, parts = len(tables) - 1, []
                for at in range(0, len(pairs) - tail, BLOCK):
                    parts.append(self.half_chunks(pairs[at:at + BLOCK + tail], tables))
                x[i] = np.concatenate(self.pooled(np.concatenate(parts)))
                continue
            waiting.append((i, pairs))
            held += len(pairs)
            if held >= BLOCK // 4:
                flush()
        flush()
        return sigmoid(self.output(x).astype(np.float64))

    def _many(self, texts: list[np.ndarray], tables) -> list[np.ndarray]:
        tail = len(tables) - 1
        sizes = [len(p) - tail for p in texts]
        out = tables[0][np.concatenate([p[:n] for p, n in zip(texts, sizes)])]
        for k in range(1, len(tables)):
            out += tables[k][np.concatenate([p[k:n + k] for p, n in zip(texts, sizes)])]
        halves = out.reshape(-1, HALF, FILTERS).max(axis=1)
        return np.split(halves, np.cumsum([n // HALF for n in sizes])[:-1])


def _forward(net: Net, pairs: list[np.ndarray], tables):
    """Pooled features of a batch and the winning positions."""
    tail = len(tables) - 1
    xs, wins = [], []
    for p in pairs:
        n = len(p) - tail
        r = tables[0][p[:n]] + tables[1][p[1:n + 1]] + tables[2][p[2:n + 2]]
        block = r.reshape(-1, HALF, FILTERS)
        at = block.argmax(axis=1)
        top = np.take_along_axis(block, at[:, None, :], 1)[:, 0, :]
        at += (np.arange(len(top)) * HALF)[:, None]
        left = top[:-1] >= top[1:]
        chunk = np.where(left, top[:-1], top[1:]) + net.bias
        where = np.where(left, at[:-1], at[1:])
        live = chunk > 0
        chunk = np.where(live, chunk, 0)
        best = chunk.argmax(axis=0)
        xs.append(np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)]))
        wins.append((where, live, best))
    return np.array(xs), wins


def fit_quality(rows: list[tuple[str, int]], seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Net(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(f32), np.zeros(FILTERS, f32),
              rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f32), np.zeros(HIDDEN, f32),
              rng.normal(0, 0.3, HIDDEN).astype(f32), np.zeros(1, f32))
    y = np.array([r[1] for r in rows], np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 1.0
        net.w2[:] = 0
        net.b2[:] = np.log(max(p, 1e-9) / max(1 - p, 1e-9))
        return net
    pairs = []
    for text, _ in rows:
        b = byte_rows((text or "").encode("utf-8", "surrogatepass"))
        pairs.append(b[:, 0].astype(np.int32) | b[:, 1].astype(np.int32) << 8)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        shuffled = rng.permutation(len(pairs))
        for at in range(0, len(pairs), BATCH):
            batch = shuffled[at:at + BATCH]
            tables = net.pair_tables()
            x, wins = _forward(net, [pairs[i] for i in batch], tables)
            h = np.maximum(x @ net.w1 + net.b1, 0)
            dz = ((sigmoid(h @ net.w2 + net.b2) - y[batch]) / len(batch)).astype(f32)
            dh = np.outer(dz, net.w2) * (h > 0)
            dx = dh @ net.w1.T
            g_filters, g_bias = np.zeros_like(net.filters), np.zeros_like(net.bias)
            flat, amount = [], []
            cols = np.arange(FILTERS)
            for i, (where, live, best), d in zip(batch, wins, dx):
                g = np.broadcast_to(d[:FILTERS] / len(where), where.shape).copy()
                g[best, cols] += d[FILTERS:]
                g = np.where(live, g, 0)
                g_bias += g.sum(axis=0)
                p = pairs[i]
                for k in range(WIDTH // 2):
                    pair = p[where + k]
                    flat.append((((2 * k) * 256 + (pair & 255)) * FILTERS + cols).ravel())
                    flat.append((((2 * k + 1) * 256 + (pair >> 8)) * FILTERS + cols).ravel())
                    amount += [g.ravel(), g.ravel()]
            g_filters = np.bincount(np.concatenate(flat), np.concatenate(amount), net.filters.size
                                    ).reshape(net.filters.shape)
            grads = [g_filters, g_bias, x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]
            step += 1
            for p, g, (m, v) in zip(net.params(), grads, moments):
                g = g.astype(f32) + f32(1e-4) * p
                m += f32(0.1) * (g - m)
                v += f32(0.001) * (g * g - v)
                p -= f32(rate) * (m / (1 - f32(0.9) ** step)) / (np.sqrt(v / (1 - f32(0.999) ** step)) + f32(1e-8))
    return net


SCHEMA = "doc_id long, score double"


def score_quality(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(net.params())

    def run(ids, texts):
        return pa.record_batch([ids, pa.array(Net(*sent.value).score(utf8(texts)))], names=["doc_id", "score"])

    scored = map_texts(narrow(docs, id_col, text_col), run, SCHEMA)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def fit_from_labels(spark: SparkSession, sf_dir: str, max_rows: int = TRAIN_ROWS) -> Net:
    return fit_quality(labelled_sample(spark, sf_dir, "quality", max_rows))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return score_quality(table(spark, sf_dir, "documents"), fit_from_labels(spark, sf_dir))

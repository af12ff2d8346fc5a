"""Packing into sequences by cutting-stock column generation.

*Pieces.*  A document's ids are cut into pieces of ``CAPACITY`` tokens and a
remainder.  One pass over the texts tokenizes them and keeps the pieces'
lengths and checksums only.

*Patterns.*  Lengths are counted in classes of ``WIDTH`` tokens (rounded up), a
histogram of at most ``CAPACITY / WIDTH`` rows, which is all the driver gets.
The linear program over patterns (how many pieces of each class share a
sequence) starts from a triangular basis of greedy patterns; a knapsack
dynamic program over the capacity prices new columns with the duals until
none improves, or until the dual bound proves the solution within ``GAP``.  The revised simplex
keeps at most one pattern per class.

*Assignment.*  Pattern counts are rounded down.  Pieces are ranked within
their class by a distributed ranking, and each pattern takes a range of the
ranks of each of its classes, so a join with the table of ranges (at most a
few thousand rows, whatever the input) places every piece.

*Rest.*  What rounding leaves over fills less than one sequence per pattern,
``CAPACITY ** 2 / WIDTH`` tokens at most.  These pieces are laid end to end
and cut where a sequence is full; the last, partial sequence is cut at powers
of two, which need no padding.  Only the documents that are cut there are
tokenized once more, for the checksums of the parts.

Defined cases: null and empty texts are the end token alone; rows that repeat
an id are packed like any other rows; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenflow.llm.common import map_texts, narrow, prepare, table, tokenizer_path, utf8
from listenflow.operators.ranking import row_number_within
from listenflow.session import materialize

CAPACITY = 4096
WIDTH = 4
END_ID = 2              # fixed value: the id that ends a document
GAP = 0.0005            # relative distance to the dual bound at which pricing stops
MAX_WORDS = 1 << 19     # words remembered per worker, and as many of the generation before
VOCABULARY = "word_bpe_49k.json"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: bytes that are no visible character stand for
    the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins text across it, so ids
    are looked up per word; words not met before are tokenized in one batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encode_many(self, texts: list[bytes], end: bytes) -> list[bytes]:
        if len(self.known) > MAX_WORDS:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        split = [t.split() for t in texts]          # bytes: splits at [\x20\x09-\x0D]
        new = []
        for words in split:
            for w in set(words):
                if w not in known:
                    ids = before.get(w)
                    if ids is None:
                        new.append(w)
                        ids = b""
                    known[w] = ids
        self._learn(new)
        return [b"".join([known[w] for w in words]) + end for words in split]


    def _learn(self, new: list[bytes]) -> None:
        """Tokenize words.  A word of letters and the punctuation behind it are
        separate pre-tokens, so both are looked up on their own; the tokenizer
        lower-cases, so A-Z are a-z."""
        known, plain, other, tails = self.known, set(), [], []
        bpe = self.model.tokenize

        def pack(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)
        for w in new:
            core = w.rstrip(b".,;:!?")
            if core.isalpha() or core.decode("utf-8").isalpha():
                low = core.lower()      # bytes: A-Z only
                if low != w:
                    tails.append((w, low, w[len(core):]))
                if low != w and known.get(low):
                    continue
                text = low.decode("utf-8")
                # below U+0250 every letter is normalised as it is: one pre-token of its bytes' letters
                if max(text, default="") < "\u0250" and text == text.lower():
                    known[low] = pack([t.id for t in bpe(low.decode("latin-1").translate(BYTE_LETTERS))])
                else:
                    plain.add(low)
            else:
                other.append(w)
        known[b""] = b""
        points = {t for _, _, t in tails if t}
        other += [t for t in points if not known.get(t)]
        plain = list(plain)
        for at in range(0, len(plain), 4096):
            part = plain[at:at + 4096]
            e = self.tokenizer.encode(b" ".join(part).decode("utf-8"), add_special_tokens=False)
            if e.word_ids[-1] != len(part) - 1:     # a letter that lower case or NFC takes apart
                other += part
                continue
            cuts = np.searchsorted(np.array(e.word_ids), np.arange(len(part) + 1))
            raw = np.array(e.ids, "<u4").tobytes()
            known.update(zip(part, [raw[4 * a:4 * b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]))
        for at in range(0, len(other), 4096):
            part = other[at:at + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch([w.decode("utf-8") for w in part],
                                                              add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()
        for w, core, tail in tails:
            known[w] = known[core] + known[tail]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def worker_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs one task per core
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenized(docs: DataFrame, make, schema: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Apply ``make(id, ids)`` (yielding rows) to the ids of every text."""
    end = end_id.to_bytes(4, "little")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(ids, texts):
        rows = [r for i, e in zip(ids.to_pylist(), worker_tokenizer(path or tokenizer_path(VOCABULARY))
                                  .encode_many(utf8(texts), end)) for r in make(i, e)]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows
                               else [pa.array([], k) for k in kinds], names=names)
    return map_texts(docs, run, schema)


PIECES = "doc_id long, doc_tokens long, start long, length long, crc long"


def _cut(capacity: int):
    def make(doc, ids):
        n = len(ids) // 4
        for start in range(0, n, capacity):
            part = ids[4 * start:4 * (start + capacity)]
            yield doc, n, start, len(part) // 4, zlib.crc32(part)
    return make


# --- the linear program (numpy, on the histogram) -------------------------

def _price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack: the pattern worth most under the duals (any number of each class)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    small, worth = sizes[order], duals[order]
    upto = np.searchsorted(small, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = upto[c]
        if n:
            value = best[c - small[:n]] + worth[:n]
            k = value.argmax()
            if value[k] > best[c] + 1e-12:
                best[c], choice[c] = value[k], order[k]
    pattern = np.zeros(len(sizes), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(best[capacity]), pattern


def _through(inverse: np.ndarray, column: np.ndarray) -> np.ndarray:
    held = np.flatnonzero(column)
    return (inverse[:, held] * column[held]).sum(axis=1)


def _replace(inverse: np.ndarray, d: np.ndarray, out: int) -> None:
    """The basis inverse after column ``out`` was replaced (``d``: inverse times the new one)."""
    pivot = inverse[out] / d[out]
    inverse -= np.outer(d, pivot)
    inverse[out] = pivot


def _start(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first basis, its inverse and its counts: fill a sequence with the largest classes that still have
    pieces, use that pattern until one class is used up, and go on.  A class
    that is used up occurs in no later pattern, so the patterns are a
    triangular basis, column ``c`` being the one that used up class ``c``."""
    m = len(sizes)
    left, done = demand.copy(), np.zeros(m, bool)
    basis, x = np.diag((capacity // sizes).astype(float)), np.zeros(m)
    inverse = np.diag(1.0 / (capacity // sizes))
    for _ in range(m):
        column, room = np.zeros(m), capacity
        for c in np.flatnonzero(~done & (left > 1e-9))[::-1]:
            if sizes[c] <= room:
                column[c] = min(room // sizes[c], max(1, int(left[c])))
                room -= column[c] * sizes[c]
        held = np.flatnonzero(column)
        if not len(held):
            break
        out = held[(left[held] / column[held]).argmin()]
        x[out] = left[out] / column[out]
        left = np.maximum(left - x[out] * column, 0)
        left[out], done[out] = 0, True
        _replace(inverse, _through(inverse, column), out)
        basis[:, out] = column
    return basis, inverse, x


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts that cover ``demand``
    pieces of each size with the fewest sequences.  Pricing stops at the
    relative ``gap`` to the dual bound, or one sequence from it, or after as
    many rounds as there are classes."""
    m = len(sizes)
    # tiny differences keep the simplex from standing still on ties
    demand = demand + 1e-3 * (1 + np.arange(m) % 97 / 97 + np.arange(m) / m)
    patterns, inverse, x = _start(sizes, demand, capacity)
    bound = float(demand @ sizes) / capacity
    for _ in range(m):
        duals = np.maximum(inverse.sum(axis=0), 0)      # every pattern costs one sequence
        value, column = _price(duals, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        bound = max(bound, float(duals @ demand) / value)
        if x.sum() - bound <= max(gap * x.sum(), 1.0):
            break
        d = _through(inverse, column)
        rows = np.flatnonzero(d > 1e-9)
        ratio = x[rows] / d[rows]
        step = ratio.min()
        out = rows[ratio.argmin()]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        _replace(inverse, d, out)
        patterns[:, out] = column
    return patterns, x


def pattern_ranges(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple], int]:
    """``(class, first rank, end rank, first sequence, count)`` of each pattern
    and class, ranks from 0, and the number of sequences used."""
    if not histogram:
        return [], 0
    sizes = np.array([c for c, _ in histogram], np.int64)
    demand = np.array([n for _, n in histogram], np.float64)
    patterns, x = solve_patterns(sizes, demand, capacity)
    patterns = [p.astype(np.int64) for p in patterns.T]
    taken = np.zeros(len(sizes), np.int64)
    ranges, sequences = [], 0
    # nearly full patterns first: what is over then comes from the worst ones
    for p in sorted(range(len(patterns)), key=lambda p: (-int(patterns[p] @ sizes), p)):
        count = int(x[p] + 1e-6)
        held = np.flatnonzero(patterns[p])
        # whole sequences only: no more than the pieces that are left
        count = min([count, *((int(demand[c]) - int(taken[c])) // int(patterns[p][c]) for c in held)])
        if count <= 0:
            continue
        for c in held:
            first = int(taken[c])
            taken[c] += int(patterns[p][c]) * count
            ranges.append((int(sizes[c]), first, int(taken[c]), sequences, count))
        sequences += count
    return ranges, sequences


def _bounds(total: int, capacity: int) -> list[int]:
    """Ends of the sequences of the rest: full ones, then powers of two."""
    ends = list(range(capacity, total + 1, capacity))
    at, left = total - total % capacity, total % capacity
    bit = capacity
    while left:
        if left >= bit:
            at, left = at + bit, left - bit
            ends.append(at)
        else:
            bit //= 2
    return ends


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         width: int = WIDTH, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    docs = narrow(docs, id_col, text_col)
    # written once: a range exchange reads its input twice, the first time for a sample
    pieces = materialize(tokenized(docs, _cut(capacity), PIECES, path).withColumn(
        "class", F.ceil(F.col("length") / width).cast("long")))
    # the position of equal rows does not matter: they are interchangeable
    ranked = materialize(row_number_within(pieces, ["doc_id", "start", "length", "crc"], ["class"], out="rank"))
    histogram = [(r["class"], r["n"]) for r in
                 ranked.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy("class").collect()]
    ranges, sequences = pattern_ranges(histogram, capacity // width)
    placed_schema = "class long, lo long, hi long, base long, count long"
    places = F.broadcast(spark.createDataFrame(ranges, placed_schema))     # bounded by the classes, not by the input
    inside = ((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")))
    found = ranked.alias("p").join(places.alias("q"), (F.col("p.class") == F.col("q.class")) & inside, "left")
    found = found.select("doc_id", "doc_tokens", "start", "length", "crc", "rank", F.col("p.class").alias("class"),
                         (F.col("base") + (F.col("rank") - 1 - F.col("lo")) % F.col("count")).alias("sequence_id"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    packed = (found.where("sequence_id is not null")
              .withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)))
              .select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))
    rest = _pack_rest(docs, found.where("sequence_id is null"), sequences, capacity, path)
    return packed.unionByName(rest)


def _pack_rest(docs: DataFrame, rest: DataFrame, sequences: int, capacity: int, path: str | None) -> DataFrame:
    """Lay the pieces left over end to end, cut at full sequences and, at the
    end, at powers of two.  Less than one sequence per pattern is left, so
    this part does not grow with the input."""
    spark = docs.sparkSession
    rest = materialize(rest.select("doc_id", "doc_tokens", "start", "length", "crc",
                                   F.row_number().over(Window.orderBy("class", "rank")).alias("at")))
    line = rest.withColumn("end", F.sum("length").over(Window.orderBy("at")).cast("long"))
    line = line.withColumn("begin", F.col("end") - F.col("length"))
    total = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("t")).collect()[0].t
    ends = _bounds(int(total), capacity)
    bounds = [(a, b, sequences + i) for i, (a, b) in enumerate(zip([0, *ends], ends))]
    seqs = spark.createDataFrame(bounds, "first long, last long, sequence_id long")
    # sequences and pieces meet per block of one capacity, so few pairs are tried
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / capacity), F.floor((b - 1) / capacity)))
    parts = (line.withColumn("block", blocks(F.col("begin"), F.col("end")))
             .join(F.broadcast(seqs.withColumn("block", blocks(F.col("first"), F.col("last")))), "block")
             .where("begin < last and first < end").drop("block").distinct())
    parts = materialize(parts.select(
        "doc_id", "doc_tokens", "at", "crc", F.col("start").alias("piece"), F.col("length").alias("whole"),
        (F.col("start") + F.greatest("begin", "first") - F.col("begin")).alias("start"),
        (F.least("end", "last") - F.greatest("begin", "first")).alias("length"), "sequence_id",
        (F.greatest("begin", "first") - F.col("first")).alias("offset")))
    uncut = parts.where("length = whole").select("doc_id", "start", "length", F.col("crc").alias("ids_crc32"),
                                                 "doc_tokens", "sequence_id", "offset")
    cut = parts.where("length < whole")
    ids = F.broadcast(cut.select(F.col("doc_id").alias("_id")).distinct())      # at most one per sequence of the rest

    def make(doc, raw):
        n = len(raw) // 4
        start = n - 1 - (n - 1) % capacity
        yield doc, n, zlib.crc32(raw[4 * start:]), raw[4 * start:]

    again = (tokenized(docs.join(ids, docs["_id"].eqNullSafe(ids["_id"]), "left_semi"), make,
                       "doc_id long, doc_tokens long, crc long, raw binary", path)
             .dropDuplicates(["doc_id", "doc_tokens", "crc"])
             .select(F.col("doc_id").alias("d"), F.col("doc_tokens").alias("t"), F.col("crc").alias("c"), "raw"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_tokens") == F.col("t")) & (F.col("crc") == F.col("c"))
    checked = cut.join(again, same).select(
        "doc_id", "start", "length",
        F.crc32(F.substring(F.col("raw"), (4 * (F.col("start") - F.col("piece")) + 1).cast("int"),
                            (4 * F.col("length")).cast("int"))).alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")
    return uncut.unionByName(checked)


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(table(spark, sf_dir, "documents"))

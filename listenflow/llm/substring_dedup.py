"""Substring dedup with an FM-index per shard.

A window is ``WINDOW`` consecutive words of one document; a word goes when it
lies in a window that also starts in a document with a smaller id.

*Routing by content.*  Every window has an anchor, the run of ``ANCHOR`` words
with the smallest hash in it, so equal windows have equal anchors.  Neighbouring
windows with the same anchor form a *segment* of at most
``2 * WINDOW - ANCHOR`` words.  Only anchors that occur in two documents or more
go on; the segments around them are sent to the shard of their anchor.  Shards
thus hold pieces of text that can match, whatever documents they come from,
and never need to see each other.

*Per shard.*  Equal segments are folded into one with the smallest id before
the shuffle.  A shard builds a compressed FM-index (bounded-depth BWT in a
wavelet matrix) over its segments and streams them against it: backward
searches, in step, give the matching statistics of every position, as far as the
threshold; where they reach it, the suffix range gives the smallest id that
holds the window.  The smallest ids go back to all occurrences by
an equi-join.

*Hot cases.*  Copies of a whole text are folded first.  A passage in a third of
all documents is one folded segment per anchor.  An anchor with more than
``HEAVY`` different segments is not sent as a whole: its segments are cut into
single windows, which are routed by their own hash.

Defined cases: null and empty texts have no word; fewer than ``WINDOW`` words
have no window; rows that repeat an id count as the same document, so a window
is not removed for its own id; a null id is no source and loses nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.llm.common import map_texts, narrow, prepare, table, utf8
from listenflow.llm.fm_index import FMIndex, range_minimum
from listenflow.llm.words import WordHashes, mix, window_hashes
from listenflow.session import discard, materialize

WINDOW = 13
ANCHOR = 6
HEAVY = 20000           # different segments of one anchor
SHARD_WORDS = 1_000_000


def window_anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor (the leftmost smallest hash)
    and the hashes of all runs of ``anchor`` words."""
    g = window_hashes(words, anchor)
    width = window - anchor + 1
    runs = np.lib.stride_tricks.sliding_window_view(g, width)
    return runs.argmin(axis=1) + np.arange(len(runs)), g


def anchor_hashes(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Distinct anchors of all windows: minima of the run hashes by doubling."""
    low = window_hashes(words, anchor)
    width, have = window - anchor + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return np.unique(low[np.concatenate([[True], low[1:] != low[:-1]])])


def _hashes(store: dict) -> WordHashes:
    return store.setdefault("h", WordHashes())


def document_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``doc_id, n_words, words_sha, anchors`` per row (distinct anchors, 64-bit)."""
    store: dict = {}

    def run(ids, texts):
        n, sha, found = [], [], []
        for t in utf8(texts):
            words = t.split()           # bytes: splits at [\x20\x09-\x0D]
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if len(words) < window:
                found.append(b"")
            else:
                found.append(anchor_hashes(_hashes(store).of(words), window, anchor).astype("<u8").tobytes())
        return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(sha), pa.array(found, pa.binary())],
                               names=["doc_id", "n_words", "words_sha", "anchors"])
    return map_texts(docs, run, "doc_id long, n_words long, words_sha string, anchors binary")


def _explode(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            parts = [np.frombuffer(p, "<i8") for p in b.column(1).to_pylist()]
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(parts)),
                                       pa.array(np.repeat(ids, [len(p) for p in parts]))], names=["anchor", "doc_id"])
    return rows.select("doc_id", "anchors").mapInArrow(run, "anchor long, doc_id long")


SEGMENTS = "anchor long, k1 long, k2 long, seg binary, doc_id long, row long, start long"
SEGMENT_NAMES = ["anchor", "k1", "k2", "seg", "doc_id", "row", "start"]


def _key(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def segments(candidates: DataFrame, window: int, anchor: int) -> DataFrame:
    """Segments of ``doc_id, row, text, wanted`` around the wanted anchors."""
    store: dict = {}

    def run(batches):
        for b in batches:
            anchors, starts, segs, digests, counts = [], [], [], [], []
            for text, wanted in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist()):
                counts.append(0)
                words = _hashes(store).of(text.split())
                if len(words) < window:
                    continue
                at, g = window_anchors(words, window, anchor)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                last = np.append(first[1:], len(at)) - 1
                keys = g[at[first]].view(np.int64)
                hit = np.isin(keys, np.array(wanted, np.int64))
                raw = words.astype("<u8").tobytes()
                anchors.append(keys[hit])
                starts.append(first[hit])
                mine = [raw[8 * s:8 * (e + window)] for s, e in zip(first[hit].tolist(), last[hit].tolist())]
                counts[-1] = len(mine)
                segs += mine
                digests += map(xxhash.xxh3_128_digest, mine)
            k = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            of = np.repeat(np.arange(len(counts)), counts)
            empty = [np.empty(0, np.int64)]
            yield pa.record_batch([
                pa.array(np.concatenate(anchors or empty)), pa.array(np.ascontiguousarray(k[:, 0])),
                pa.array(np.ascontiguousarray(k[:, 1])), pa.array(segs, pa.binary()), b.column(0).take(pa.array(of)),
                b.column(1).take(pa.array(of)), pa.array(np.concatenate(starts or empty))], names=SEGMENT_NAMES)
    return candidates.mapInArrow(run, SEGMENTS)


def _segment_batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                           names=SEGMENT_NAMES)


def _cut_heavy(segs: DataFrame, heavy: DataFrame, window: int) -> DataFrame:
    """Segments of heavy anchors as single windows, routed by their own hash."""
    def run(batches):
        for b in batches:
            rows = []
            for seg, doc, row, start in zip(*(b.column(i).to_pylist() for i in (3, 4, 5, 6))):
                for k in range(len(seg) // 8 - window + 1):
                    one = seg[8 * k:8 * (k + window)]
                    k1, k2 = _key(one)
                    rows.append((k1, k1, k2, one, doc, row, start + k))
            yield _segment_batch(rows)
    light = segs.join(heavy, "anchor", "left_anti").select(*SEGMENT_NAMES)
    return light.union(segs.join(heavy, "anchor", "left_semi").select(*SEGMENT_NAMES).mapInArrow(run, SEGMENTS))


def _search_shard(window: int):
    def run(shard: pa.Table) -> pa.Table:
        raw = shard.column("seg").to_pylist()
        first = shard.column("first").to_numpy()
        sizes = np.array([len(r) // 8 for r in raw])
        words = np.frombuffer(b"".join(raw), "<u8")
        vocabulary, symbols = np.unique(words, return_inverse=True)
        # segment, separator, segment, separator, ...
        ends = np.cumsum(sizes + 1)
        begins = ends - sizes - 1
        text = np.zeros(int(ends[-1]), np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(raw)), sizes)] = symbols + 1
        index = FMIndex(text, len(vocabulary) + 1, window)
        counts = sizes - window + 1
        owner = np.repeat(np.arange(len(raw)), counts)
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
        matched, lo, hi = index.matching_statistics(text, at, window)
        smallest = first[owner]
        many = np.flatnonzero(matched >= window)
        if len(many):
            doc_of = np.repeat(first, sizes + 1)[index.suffixes]
            smallest[many] = range_minimum(doc_of, lo[many], hi[many])
        flat = smallest.astype("<i8").tobytes()
        stops = (8 * np.cumsum(counts)).tolist()
        minima = [flat[a:b] for a, b in zip([0, *stops], stops)]
        return pa.table([shard.column("k1"), shard.column("k2"), pa.array(minima, pa.binary())],
                        names=["k1", "k2", "minima"])
    return run


def _covered(found: DataFrame, window: int) -> DataFrame:
    """``row, s, e``: runs of words covered by windows of a smaller id."""
    def run(batches):
        for b in batches:
            doc, row, start = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            raw = b.column(3).to_pylist()
            minima = np.frombuffer(b"".join(raw), "<i8")
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 8
            owner = np.repeat(np.arange(len(raw)), sizes)
            hit = np.flatnonzero(minima < doc[owner])       # windows with a smaller id, by segment
            of = owner[hit]
            at = hit - (np.cumsum(sizes) - sizes)[of]
            # a run ends with its segment, or where the next window leaves a word out
            ends = (of[1:] != of[:-1]) | (at[1:] - at[:-1] > window)
            first = np.concatenate([[True], ends]) if len(hit) else np.empty(0, bool)
            last = np.concatenate([ends, [True]]) if len(hit) else np.empty(0, bool)
            of, s, e = of[first], at[first], at[last]
            yield pa.record_batch([pa.array(row[of]), pa.array(start[of] + s), pa.array(start[of] + e + window)],
                                  names=["row", "s", "e"])
    return found.select("doc_id", "row", "start", "minima").mapInArrow(run, "row long, s long, e long")


KEPT = "doc_id long, words_sha string, n_removed long, kept_sha256 string, kept string"


def _remove(rows: DataFrame, keep_text: bool) -> DataFrame:
    """Take the covered words out of ``doc_id, text, runs``."""
    def run(batches):
        for b in batches:
            out = []
            for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(),
                                       b.column(2).to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                for r in runs:
                    if r["e"] <= len(words):
                        gone[r["s"]] += 1
                        gone[r["e"]] -= 1
                stay = np.cumsum(gone[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, stay.tolist()) if k])
                out.append((doc, hashlib.sha256(b" ".join(words)).hexdigest(), int(len(words) - stay.sum()),
                            hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if keep_text else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                                  names=["doc_id", "words_sha", "n_removed", "kept_sha256", "kept"])
    return rows.select("doc_id", "_text", "runs").mapInArrow(run, KEPT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, keep_text: bool = False, heavy: int = HEAVY,
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``,
    the kept words of documents that lose some, if ``keep_text``)."""
    docs = narrow(docs, id_col, text_col)
    made = materialize(document_anchors(docs, window, anchor))
    rows = materialize(made.select("doc_id", "n_words", "words_sha"))
    usable = made.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # copies of a whole text: the smallest id stands for all
    copies = materialize(usable.groupBy("words_sha").agg(F.min("doc_id").alias("rep")))
    sources = usable.join(copies.withColumnRenamed("rep", "doc_id"), ["words_sha", "doc_id"], "left_semi")
    # a row holds an anchor once, so one that occurs twice is in two rows
    entries = _explode(sources)
    shared = materialize(entries.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    wanted = (entries.join(shared, "anchor").groupBy(F.col("doc_id"))
              .agg(F.collect_list("anchor").alias("wanted")))     # at most the anchors of one document
    candidates = materialize(docs.join(wanted, docs["_id"] == wanted["doc_id"])
                             .select("doc_id", F.monotonically_increasing_id().alias("row"), "_text", "wanted"))
    discard(made, shared)
    segs = materialize(segments(candidates, window, anchor))

    def folded(s: DataFrame) -> DataFrame:
        return s.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.first("seg").alias("seg"),
                                         F.first("anchor").alias("anchor"))

    distinct = materialize(folded(segs))
    over = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy)
                       .select("anchor"))
    if over.limit(1).count():
        whole = (segs, distinct)
        segs = materialize(_cut_heavy(segs, over, window))
        discard(*whole)
        distinct = materialize(folded(segs))
    places = materialize(segs.select("k1", "k2", "doc_id", "row", "start"))
    discard(segs)
    total = distinct.agg(F.coalesce(F.sum(F.length("seg")), F.lit(0)).alias("t")).collect()[0].t // 8
    shards = max(1, -(-int(total) // shard_words))
    minima = materialize(distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
              .groupBy("shard").applyInArrow(_search_shard(window), "k1 long, k2 long, minima binary"))
    discard(distinct)
    # only segments that hold a smaller id somewhere are sent back
    runs = (_covered(places.join(minima, ["k1", "k2"]), window)
            .groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("runs")))
    texts = candidates.select("doc_id", "row", "_text").join(runs, "row")
    changed = _remove(texts, keep_text).dropDuplicates(["doc_id", "words_sha"])
    of_copy = F.col("rep") < F.col("doc_id")        # every word of a copy lies in a window of the first
    every = rows.join(copies, "words_sha", "left").join(changed, ["doc_id", "words_sha"], "left")
    empty = F.sha2(F.lit(""), 256)
    return every.select(
        "doc_id", "n_words",
        F.when(of_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(of_copy, empty).otherwise(F.coalesce("kept_sha256", "words_sha")).alias("kept_sha256"),
        *([F.when(of_copy, F.lit("")).otherwise(F.col("kept")).alias("kept")] if keep_text else []))


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return remove_repeats(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
sources AS (SELECT s, min(doc_id) AS source FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN sources USING (s) WHERE source < doc_id),
positions AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM positions ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

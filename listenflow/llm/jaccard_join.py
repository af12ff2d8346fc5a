"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct ``n``-word shingles (64-bit hashes).  Two
documents link when ``100 * intersection >= similarity * union``.  The result
gives each document its component of links.

*Equal sets* are folded first (by a 128-bit hash of the set): one node each.

*Extended prefixes.*  Shingles are ordered by their hash.  Sets of sizes
``x <= y`` that link share at least ``t(x) = ceil(similarity * x)`` shingles,
so the first ``x - t(x) + k(x)`` shingles of one and the first
``y - t(y) + k(y)`` of the other share at least ``k(x)``, for any ``k`` that
does not fall with the size.  Only these prefixes are indexed.

*Rare and frequent tokens.*  A prefix token in more than ``RARE`` prefixes is
frequent.  Rare tokens are indexed one by one, and all nodes of one are
compared.  A node with fewer frequent tokens in its prefix than ``k`` asks for
must share a rare one with any partner, so frequent tokens matter only between
nodes with many of them.  For these the combinations of many tokens are the
index entries: linked sets of sizes ``x`` and ``y`` differ in at most
``m = (x + y) * (100 - similarity) / (100 + similarity)`` tokens, so if the
tokens are dealt into ``m + 1`` classes by their hash, all tokens of one class
are equal.  A class holds about ``similarity / (100 - similarity)`` / 2 tokens
or more; sets are indexed for their own range of sizes and the next one, so
that both sides of a link deal alike.

*Groups without all pairs.*  Copies of one text may form groups of any size.
Every entry is compared with the centre of its group (the node whose index
groups are the largest together, such as the original of edited copies); what
links with the centre is connected.  For the others, a set is its difference ``D`` to
the centre: ``|x ^ y| = |D(x) ^ D(y)|``.  If ``x`` and ``y`` link, few tokens of
``D(x)`` are missing in ``D(y)``, so a short prefix of each, in one order of the
tokens, holds the first token they share.  Tokens that few nodes around centres hold
come first, those of the centre itself last (most nodes far from it lack them), so
only prefixes leave the task that compares a set with its centre.  Tokens that one
node alone holds count but need no entry.  If ``x`` does not link with the
centre, it holds more than ``(1 - b) / 2`` of ``D(y)``, where
``b = (100 - similarity) / (100 + similarity)``, which shortens ``y``'s prefix.
Pairs inside one component add nothing and are not made; sizes, distances to the
centre and the places of the shared token rule pairs out before they are made; the
sets decide.

*Disk.*  What moves all prefixes, all of their tokens or all texts is done for
``SLICES`` parts of the keys, tokens or ids one after the other; the shuffle files
of a part go before the next one is made.  Every part is whole: rows that meet
have the same key, token or id.

Defined cases: null, empty and white-space texts have an empty set, link with
nothing and are their own component; fewer words than ``n`` make one shingle
of the whole sequence; repeated rows (also of one id) fold into one node; rows
with a null id link like others, but lend no id to their component (it is null
if all of its ids are); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenflow.llm.common import map_texts, narrow, prepare, table, utf8
from listenflow.llm.components import connected_components
from listenflow.llm.words import WordHashes, mix, window_hashes
from listenflow.session import discard, materialize

SIMILARITY = 90         # percent
SHINGLE = 3             # words
RARE = 8                # prefixes that may hold a rare token
EXTRA = 16              # a prefix is extended by this many tokens ...
EXTRA_PER = 20          # ... and by one more per this many shingles
SLICES = 4              # parts of a large shuffle that are made one after the other


def shingle_sets(texts: list[bytes], hashes: WordHashes, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for t in texts:
        words = t.lower().split()       # bytes: lowers A-Z only, splits at [\x20\x09-\x0D]
        if not words:
            out.append(np.empty(0, np.uint64))
        elif len(words) < n:
            out.append(np.array([int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little")],
                                np.uint64))
        else:
            out.append(np.unique(window_hashes(hashes.of(words), n)))
    return out


def _need(n, similarity: int):
    """Shingles that a set of ``n`` shares with any partner (ints or Columns)."""
    if isinstance(n, Column):
        return F.floor((n * similarity + 99) / 100).cast("long")
    return (n * similarity + 99) // 100


def _shared(n, similarity: int):
    """``k(n)``: shared prefix tokens asked for."""
    need = _need(n, similarity)
    if isinstance(n, Column):
        return F.least(need, EXTRA + F.floor(n / EXTRA_PER)).cast("long")
    return min(need, EXTRA + n // EXTRA_PER)


def _apart(total: int, similarity: int) -> int:
    """Tokens in which linked sets of ``total`` tokens together differ at most."""
    return total * (100 - similarity) // (100 + similarity)


def size_ranges(largest: int, similarity: int) -> list[int]:
    """First sizes of the ranges; a partner's size is in the same or a neighbouring range."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // similarity + 1)
    return out + [out[-1] * 100 // similarity + 1, (out[-1] * 100 // similarity + 1) * 100 // similarity + 1]


def class_signatures(s: np.ndarray, ranges: list[int], similarity: int) -> np.ndarray:
    """Index entries of a set: for its range of sizes and the next one, a hash
    of the tokens of each class."""
    own = int(np.searchsorted(ranges, len(s), side="right")) - 1
    out = []
    for level in (own, own + 1):
        classes = _apart(2 * (ranges[level + 1] - 1), similarity) + 1
        which = ((s >> np.uint64(13)) % np.uint64(classes)).astype(np.int64)
        sums = np.zeros(classes, np.uint64)
        np.add.at(sums, which, mix(s, 5))       # an order-free hash of the class
        out.append(mix(sums + mix(np.uint64(level << 32) + np.arange(classes, dtype=np.uint64), 7), 9))
    return np.concatenate(out)


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefixes(docs: DataFrame, similarity: int, n: int) -> DataFrame:
    """``doc_id, n, key, prefix`` per row; the prefix as little-endian 64-bit integers."""
    def run(ids, texts):
        hashes = run_hashes.setdefault("h", WordHashes())
        sets = shingle_sets(utf8(texts), hashes, n)
        cut = []
        for s in sets:
            size = len(s)
            # a set that cannot differ from a partner by one shingle links with equal sets only
            alone = 100 * size < similarity * (size + 1)
            longest = size - _need(size, similarity) + _shared(size, similarity)
            cut.append(b"" if alone else s[:longest].astype("<u8").tobytes())
        return pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()),
                                pa.array([_key(s) for s in sets], pa.binary()), pa.array(cut, pa.binary())],
                               names=["doc_id", "n", "key", "prefix"])
    run_hashes: dict = {}
    return map_texts(docs, run, "doc_id long, n long, key binary, prefix binary")


def _together(parts: list[DataFrame]) -> DataFrame:
    """The rows of all of these written frames."""
    return parts[0].sparkSession.read.parquet(*(p._lf_path for p in parts))


def _in_slice(key: str, i: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLICES)) == i


def _fold(made: DataFrame) -> list[DataFrame]:
    """``key, rep, n, prefix, node``, one row per set, as written parts."""
    one = lambda i: (made.where((F.col("n") > 0) & _in_slice("key", i)).groupBy("key")
                     .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
                     .withColumn("node", F.monotonically_increasing_id() * SLICES + i))
    return [materialize(one(i)) for i in range(SLICES)]


def _shared_entries(full: DataFrame) -> list[DataFrame]:
    """``token, node, df`` of the tokens that several prefixes hold, as written parts."""
    parts = []
    for i in range(SLICES):
        entries = _entries(full, i)
        tokens = materialize(entries.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
        parts.append(materialize(entries.join(tokens, "token")))
        discard(tokens)
    return parts


def _entries(groups: DataFrame, i: int | None = None) -> DataFrame:
    """``token, node`` rows of the prefixes; those of slice ``i`` of the tokens, if given."""
    slices = SLICES

    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            parts = [np.frombuffer(p, "<i8") for p in b.column(1).to_pylist()]
            if i is not None:
                parts = [p[p % slices == i] for p in parts]
            if parts:
                yield pa.record_batch([pa.array(np.concatenate(parts)), pa.array(np.repeat(node, [len(p) for p in parts]))],
                                      names=["token", "node"])
    return groups.where("length(prefix) > 0").select("node", "prefix").mapInArrow(run, "token long, node long")


def _combinations(sets: DataFrame, similarity: int) -> DataFrame:
    """``bucket, node`` rows: the class signatures of ``node, s``."""
    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy(zero_copy_only=False)
            found = [np.frombuffer(x, "<u8") for x in b.column(1).to_pylist()]
            if found:
                ranges = size_ranges(max(map(len, found)), similarity)
                keys = [class_signatures(x, ranges, similarity).view(np.int64) for x in found]
                yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.repeat(node, [len(k) for k in keys]))],
                                      names=["bucket", "node"])
    return sets.select("node", "s").mapInArrow(run, "bucket long, node long")


def _fits(a: Column, b: Column, similarity: int) -> Column:
    return 100 * F.least(a, b) >= similarity * F.greatest(a, b)


def _sets(ids: DataFrame, groups: DataFrame, docs: DataFrame, n: int) -> list[DataFrame]:
    """``node, s, many`` of the ``node, many`` in ``ids``, built again from the text
    of one row each, as written parts."""
    wanted = materialize(groups.join(ids.groupBy("node").agg(F.max("many").alias("many")), "node")
                         .select("node", "key", F.col("rep").alias("_rep"), "many"))

    def run(ids_, texts_):
        sets = shingle_sets(utf8(texts_), run_hashes.setdefault("h", WordHashes()), n)
        return pa.record_batch([pa.array([_key(s) for s in sets], pa.binary()),
                                pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["key", "s"])
    run_hashes: dict = {}
    parts = []
    for i in range(SLICES):
        some = wanted.where(_in_slice("_rep", i))
        # a null id is looked up among the rows without an id
        texts = docs.where(_in_slice("_id", i)).join(some.select("_rep").distinct().hint("shuffle_hash"),
                                                     F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
        # rows that repeat an id with another text give keys nobody asked for, repeated rows the same key twice
        parts.append(materialize(map_texts(texts, run, "key binary, s binary").dropDuplicates(["key"])
                                 .join(some.select("node", "key", "many"), "key").select("node", "s", "many")))
    discard(wanted)
    return parts


def _linked(apart: int, total: int, similarity: int) -> bool:
    return apart * (100 + similarity) <= total * (100 - similarity)


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose sets link."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb"))

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                either = len(np.unique(np.concatenate([x, y])))
                keep.append(_linked(2 * either - len(x) - len(y), len(x) + len(y), similarity))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
    return both.mapInArrow(compare, "a long, b long")


LEVELS = 16         # steps a doubling of a token's count, as ``_counted_sets`` stores it


def _counted_sets(star: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, s, often`` of the nodes in ``star``: for each token of the set, how
    many of these nodes hold it, as a byte on a logarithmic scale (0: this one alone)."""
    nodes = star.select("node").union(star.select("pivot")).distinct()
    # filtered as `_entries` does (no set is empty), so that both reads share one shuffle
    some = sets.where("length(s) > 0").join(nodes, "node", "left_semi")
    each = _entries(some.select("node", F.col("s").alias("prefix")))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    level = F.least(F.round(LEVELS * F.log2("df")), F.lit(255)).cast("short").alias("level")
    # at most the tokens of one set
    held = each.join(counts, "token").groupBy("node").agg(F.collect_list(F.struct("token", level)).alias("held"))

    def run(batches):
        for b in batches:
            often = []
            for x, held_ in zip(b.column(1).to_pylist(), b.column(2)):
                x = np.frombuffer(x, "<u8")
                of = np.zeros(len(x), np.uint8)
                if held_.is_valid:
                    token, level_ = (c.to_numpy(zero_copy_only=False) for c in held_.values.flatten())
                    of[np.searchsorted(x, token.view(np.uint64))] = level_
                often.append(of.tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(often, pa.binary())], names=["node", "s", "often"])
    return materialize(some.join(held, "node", "left").select("node", "s", "held")
                       .mapInArrow(run, "node long, s binary, often binary"))


def index_prefix(p: np.ndarray, often_p: np.ndarray, x: np.ndarray, often_x: np.ndarray, similarity: int):
    """``apart, linked, tokens, places`` of a set and its centre ``p``: the prefix of
    their difference, with each token's place in it (from 1)."""
    own = p[np.minimum(np.searchsorted(p, x), len(p) - 1)] != x
    lack = x[np.minimum(np.searchsorted(x, p), len(x) - 1)] != p
    diff = np.concatenate([x[own], p[lack]])
    apart = len(diff)
    linked = _linked(apart, len(p) + len(x), similarity)
    # the centre's tokens last, first those that many nodes hold
    rate = np.concatenate([often_x[own].astype(np.int64), 511 - often_p[lack].astype(np.int64)])
    if linked:
        limit = apart - (apart * similarity // (100 + similarity) + 1) + 1
    else:
        limit = _apart(len(x) + len(x) * 100 // similarity, similarity) + 1
    order = np.lexsort((diff, rate))[:limit]
    alone = np.concatenate([often_x[own] == 0, np.zeros(apart - own.sum(), bool)])[order]
    return apart, linked, diff[order][~alone], np.flatnonzero(~alone) + 1


STAR = "pivot long, node long, n long, apart long, linked boolean, tokens binary, places binary"


def _stars(star: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """``STAR`` rows of ``pivot, node``: how each node differs from its centre."""
    counted = _counted_sets(star, sets)
    centres = counted.withColumnsRenamed({"node": "pivot", "s": "sp", "often": "op"})
    both = star.join(centres, "pivot").join(counted, "node").select("pivot", "node", "sp", "op", "s", "often")

    def run(batches):
        for b in batches:
            out = []
            for pivot, node, p, op, x, ox in zip(*(c.to_pylist() for c in b.columns)):
                p, x = np.frombuffer(p, "<u8"), np.frombuffer(x, "<u8")
                apart, linked, tokens, places = index_prefix(p, np.frombuffer(op, np.uint8), x, np.frombuffer(ox, np.uint8),
                                                             similarity)
                out.append((pivot, node, len(x), apart, linked, tokens.astype("<u8").tobytes(), places.astype("<i4").tobytes()))
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)],
                                  names=["pivot", "node", "n", "apart", "linked", "tokens", "places"])
    stars = materialize(both.mapInArrow(run, STAR))
    discard(counted)
    return stars


def _prefix_tokens(rows: DataFrame) -> DataFrame:
    """One row per prefix token, with the other columns of its ``STAR`` row."""
    names = ["pivot", "node", "n", "apart", "linked", "comp"]

    def run(batches):
        for b in batches:
            tokens = [np.frombuffer(x, "<i8") for x in b.column(6).to_pylist()]
            if tokens:
                places = np.concatenate([np.frombuffer(x, "<i4") for x in b.column(7).to_pylist()])
                at = pa.array(np.repeat(np.arange(len(tokens)), [len(x) for x in tokens]))
                yield pa.record_batch([*(b.column(i).take(at) for i in range(6)), pa.array(np.concatenate(tokens)),
                                       pa.array(places)], names=[*names, "token", "place"])
    return rows.select(*names, "tokens", "places").mapInArrow(
        run, "pivot long, node long, n long, apart long, linked boolean, comp long, token long, place int")


def _around_centres(stars: DataFrame, comps: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links ``a, b`` between nodes around one centre, one of which does not
    link with the centre."""
    some = stars.where("not linked").select("pivot").distinct()
    rows = (stars.where("length(tokens) > 0").join(some, "pivot", "left_semi").join(comps.select("node", "comp"), "node", "left")
            .withColumn("comp", F.coalesce("comp", "node")))
    each = materialize(_prefix_tokens(rows))
    discard(stars)
    shared = F.floor(F.col("apart") * similarity / (100 + similarity)) + 1      # more than (1 - b) / 2 of them
    x = each.where("not linked").alias("x")
    y = each.where(F.col("place") <= F.col("apart") - shared + 1).alias("y")
    most = F.floor((F.col("x.n") + F.col("y.n")) * (100 - similarity) / (100 + similarity))
    # the first token both have: at most so many come before it
    first_x = 2 * (F.col("x.place") - 1) <= most + F.col("x.apart") - F.col("y.apart")
    first_y = 2 * (F.col("y.place") - 1) <= most + F.col("y.apart") - F.col("x.apart")
    able = ((F.col("x.comp") != F.col("y.comp")) & first_x & first_y & _fits(F.col("x.n"), F.col("y.n"), similarity)
            & (F.col("y.linked") | (F.col("x.node") < F.col("y.node"))))
    met = materialize(x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token"))).where(able)
                      .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    discard(each)
    more = materialize(_verify(met, sets, similarity))
    discard(met)
    return more


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    similarity: int = SIMILARITY, shingle: int = SHINGLE, rare: int = RARE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``."""
    if not 75 <= similarity <= 100:     # below, a class of tokens is hardly a combination
        raise ValueError("similarity must be at least 75 percent")
    docs = narrow(docs, id_col, text_col)
    made = materialize(prefixes(docs, similarity, shingle))
    folded = _fold(made)
    full = _together(folded)
    rows, groups = materialize(made.select("doc_id", "n", "key")), materialize(full.select("node", "key", "rep", "n"))
    discard(made)

    several = _shared_entries(full)
    shared = _together(several)
    discard(*folded)
    f_count = shared.groupBy("node").agg(F.count(F.when(F.col("df") > rare, 1)).alias("f"))
    need = _need(F.col("n"), similarity)
    info = materialize(groups.join(f_count, "node", "left").select(
        "node", "n", F.coalesce("f", F.lit(0)).cast("long").alias("f"),
        _shared(F.col("n"), similarity).alias("k"), _shared(need, similarity).alias("k_low")))

    # 1: nodes that share rare tokens, at most RARE of them a token
    one = shared.where(F.col("df") <= rare).select("token", "node")
    met = (one.select("token", F.col("node").alias("a")).join(one.select("token", F.col("node").alias("b")), "token")
           .where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")))
    a = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"), F.col("k").alias("ka"))
    b = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"), F.col("k").alias("kb"))
    # shared rare tokens plus all frequent ones must reach k of the smaller set
    enough = F.col("c") + F.least("fa", "fb") >= F.least("ka", "kb")
    pairs = materialize(met.join(a, "a").join(b, "b")
                        .where(_fits(F.col("na"), F.col("nb"), similarity) & enough).select("a", "b"))
    discard(*several)

    # 2: nodes that may share frequent tokens only, by combinations of many tokens
    many = info.select("node", (F.col("f") >= F.col("k_low")).alias("many")).where("many")
    others = pairs.select("a").union(pairs.select("b")).select("*", F.lit(False))
    built = _sets(many.union(others), groups, docs, shingle)
    sets = _together(built)
    members = materialize(_combinations(sets.where("many"), similarity))
    crowded = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "bucket")
    crowded = materialize(crowded)
    weight = crowded.groupBy("node").agg(F.sum("c").alias("w"))
    central = F.max(F.struct("w", (-F.col("node")).alias("node")))["node"]
    pivots = crowded.join(weight, "node").groupBy("bucket").agg((-central).alias("pivot"))
    star = materialize(crowded.join(pivots, "bucket").where("node <> pivot").select("pivot", "node").distinct())
    discard(members, crowded)
    stars = _stars(star, sets, similarity)
    discard(star)

    links = materialize(_verify(pairs, sets, similarity).union(stars.where("linked").select("pivot", "node")))
    discard(pairs)
    comps = connected_components(links, "a", "b")
    more = _around_centres(stars, comps, sets, similarity)
    discard(*built)
    if more.limit(1).count():
        comps = connected_components(links.union(more), "a", "b")

    node_comp = groups.select("key", "node", "rep").join(comps, "node", "left").select(
        "key", "rep", F.coalesce("comp", "node").alias("comp"))
    smallest = node_comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_key = node_comp.join(smallest, "comp").select("key", "component_id")
    return (rows.join(by_key, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       similarity: int = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns.

    Rows that share an id stay or go together: they go when none of them
    leads its component.  Rows with a null id stay.
    """
    found = link_components(docs, id_col, text_col, similarity, shingle)
    gone = (found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("leads"))
            .where("not leads").select(F.col("doc_id").alias("_lf_gone")))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_lf_gone"), "left_anti")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return link_components(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
                             lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.other)
SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id
GROUP BY r.doc_id
"""

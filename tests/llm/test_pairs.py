"""Jaccard join and substring dedup against brute force; components; the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listenflow.llm import jaccard_join, substring_dedup
from listenflow.llm.components import connected_components
from listenflow.llm.fm_index import FMIndex
from listenflow.session import materialize
from tests.llm.cases import documents, empty, rows_by_id, texts, words


def brute_links(all_texts, similarity=90, n=3):
    """Set sizes and smallest index of each component, by all pairs."""
    sets = []
    for t in all_texts:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


def near_copies():
    """A large group of near copies (chains included), and texts that share most of a passage."""
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(60):
        v = list(base)
        for _ in range(rnd.randint(0, 3)):
            v[rnd.randrange(len(v))] = f"n{rnd.randrange(10**6)}"
        out.append(" ".join(v))
    passage = [f"p{i}" for i in range(60)]
    out += [" ".join(passage + [f"u{k}_{i}" for i in range(rnd.choice([4, 8, 30]))]) for k in range(40)]
    return out


def test_components_match_brute_force(spark):
    more = near_copies()
    got = rows_by_id(jaccard_join.link_components(documents(spark, more), rare=2))
    sizes, comp = brute_links([*texts(), *more])
    assert [got[i].n_shingles for i in range(len(sizes))] == sizes
    assert [got[i].component_id for i in range(len(sizes))] == comp


def edited_copies(seed):
    """Groups of copies with many edits: most do not link with the original,
    some with each other (shared edits, words taken out at the same place)."""
    rnd = random.Random(seed)
    out = []
    for size, copies in ((50, 60), (90, 60), (25, 30)):
        base = [f"b{seed}_{size}_{i}" for i in range(size)]
        edits = [(rnd.randrange(size), rnd.choice([None, f"e{k}"])) for k in range(12)]
        for k in range(copies):
            v = list(base)
            for at, word in rnd.sample(edits, rnd.randint(0, 5)):
                v[at] = word
            for _ in range(rnd.choice([0, 0, 1, 2])):
                v[rnd.randrange(size)] = f"own{seed}_{k}"
            v = [w for w in v if w is not None]
            out.append(" ".join(v + [f"tail{k}"] * rnd.choice([0, 0, 1])))
    return out


@pytest.mark.parametrize("similarity, n, rare", [(90, 3, 2), (80, 5, 2), (80, 2, 1), (75, 3, 4)])
def test_groups_around_centres_match_brute_force(spark, similarity, n, rare):
    more = edited_copies(1) + edited_copies(2)
    got = rows_by_id(jaccard_join.link_components(documents(spark, more), similarity=similarity, shingle=n, rare=rare))
    sizes, comp = brute_links([*texts(), *more], similarity, n)
    assert [got[i].n_shingles for i in range(len(sizes))] == sizes
    assert [got[i].component_id for i in range(len(sizes))] == comp


def test_a_passage_shared_by_many(spark):
    """One passage makes up most of many documents that do not link."""
    passage = [f"p{i}" for i in range(40)]
    more = [" ".join(passage[:20] + [f"u{k}_{i}" for i in range(8 + k % 5)] + passage[20:]) for k in range(120)]
    got = rows_by_id(jaccard_join.link_components(documents(spark, more), rare=2))
    _, comp = brute_links([*texts(), *more])
    assert [got[i].component_id for i in range(len(comp))] == comp


def test_differences_to_a_centre_are_indexed_by_short_prefixes(spark, monkeypatch):
    """Texts of one passage and three sections with three versions each: most are
    far from their centre, and no token of their differences is theirs alone."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    more = []
    for k in range(81):
        v = passage + [f"s{at}_{k // 3 ** at % 3}_{i}" for at in range(3) for i in range(25)]
        if k >= 27:
            v[rnd.randrange(len(v))] = f"e{k % 7}"
        more.append(" ".join(v + [f"t{k % 9}"]))
    entries = []

    def kept(df):
        out = materialize(df)
        if {"pivot", "node", "token"} <= set(out.columns):
            entries.extend(r["count"] for r in out.groupBy("pivot", "node").count().collect())
        return out
    monkeypatch.setattr(jaccard_join, "materialize", kept)
    similarity, n = 80, 5
    got = rows_by_id(jaccard_join.link_components(documents(spark, more), similarity=similarity, shingle=n, rare=1))
    sizes, comp = brute_links([*texts(), *more], similarity, n)
    assert [got[i].n_shingles for i in range(len(sizes))] == sizes
    assert [got[i].component_id for i in range(len(sizes))] == comp
    # x and y differ in at most a ninth of their sizes together, so in a quarter of x
    largest = max(sizes[-len(more):])
    assert entries and max(entries) <= largest * 25 // 100 + 1


def test_large_shuffles_are_made_in_parts(spark, monkeypatch):
    """Prefixes, their shared tokens and the sets are written a part at a time; rows
    that meet are in one part, and the parts together are the whole."""
    more = near_copies() + edited_copies(1)
    written = {"folded": [], "shared": [], "sets": []}

    def kept(df):
        out = materialize(df)
        for name, columns, key in (("folded", {"key", "prefix", "node"}, "key"), ("shared", {"token", "node", "df"}, "token"),
                                   ("sets", {"node", "s", "many"}, "node")):
            if columns <= set(out.columns):
                written[name].append({r[0] for r in out.select(F.hex(key) if key == "key" else key).collect()})
        return out
    monkeypatch.setattr(jaccard_join, "materialize", kept)
    similarity, n = 80, 5
    got = rows_by_id(jaccard_join.link_components(documents(spark, more), similarity=similarity, shingle=n, rare=2))
    sizes, comp = brute_links([*texts(), *more], similarity, n)
    assert [got[i].n_shingles for i in range(len(sizes))] == sizes
    assert [got[i].component_id for i in range(len(sizes))] == comp
    for name, parts in written.items():
        total = sum(map(len, parts))
        assert len(parts) == jaccard_join.SLICES and total > 50, name
        assert len(set().union(*parts)) == total and max(map(len, parts)) < 0.5 * total, name
    assert sum(map(len, written["folded"])) == len({r.key for r in jaccard_join.prefixes(
        jaccard_join.narrow(documents(spark, more)), similarity, n).where("n > 0").collect()})


def test_sets_of_repeated_and_null_ids(spark):
    """Only the set of the row asked for is built, once, in whichever part its id is."""
    rows = [(i, f"a{i} b c d e f") for i in (1, 2, 3, 4, None)]
    docs = jaccard_join.narrow(spark.createDataFrame([*rows, *rows, (1, "another text of one id")], "doc_id long, text string"))
    made = jaccard_join.prefixes(docs, 90, 3)
    groups = (made.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
              .withColumn("node", F.monotonically_increasing_id()))
    groups = materialize(groups)
    ids = groups.where("rep is null or rep in (1, 2, 4)").select("node", (F.col("rep") == 2).alias("many"))
    asked = ids.union(ids.select("node", F.lit(False)))
    parts = jaccard_join._sets(asked, groups, docs, 3)
    found = [r for p in parts for r in p.join(groups, "node").collect()]
    assert sorted((r.rep or 0, bool(r.many)) for r in found) == [(0, False), (1, False), (1, False), (2, True), (4, False)]
    assert all(jaccard_join._key(np.frombuffer(r.s, "<u8")) == r.key and len(r.s) == 8 * r.n for r in found)


def test_prefixes_of_linked_sets_meet():
    """Whatever the counts, the first token that the differences of two linked sets
    share stands in both prefixes, at a place their sizes and distances allow."""
    rnd = np.random.default_rng(5)
    met = 0
    for _ in range(300):
        p, base = (np.sort(rnd.choice(400, 60, replace=False)).astype(np.uint64) for _ in range(2))
        base = np.union1d(base[:rnd.integers(5, 60)], p[:rnd.integers(0, 60)])
        both = [np.setdiff1d(np.union1d(base, rnd.choice(400, 4).astype(np.uint64)), rnd.choice(base, 3)) for _ in range(2)]
        level = rnd.integers(1, 255, 400).astype(np.uint8)
        apart = len(np.setxor1d(*both))
        if not len(both[0]) or not len(both[1]) or not apart or not jaccard_join._linked(apart, sum(map(len, both)), 80):
            continue
        found = []
        for x in both:
            d, linked, tokens, places = jaccard_join.index_prefix(p, level[p.astype(int)], x, level[x.astype(int)], 80)
            assert d == len(np.setxor1d(p, x))
            found.append((d, linked, dict(zip(tokens.tolist(), places.tolist()))))
        most = sum(map(len, both)) * 20 // 180
        for (dx, x_links, x), (dy, _, y) in (found, found[::-1]):
            if not x_links:
                assert any(t in y and y[t] <= dy - dy * 80 // 180 and 2 * (x[t] - 1) <= most + dx - dy
                           and 2 * (y[t] - 1) <= most + dy - dx for t in x)
                met += 1
    assert met > 50


def test_null_id_keeps_its_links(spark):
    """The first text links with the two others, which do not link with each other."""
    base = [f"w{i}" for i in range(100)]
    left, right = base[:-1] + ["x"], ["y"] + base[1:]
    left[40], right[60] = "l", "r"
    rows = [(None, " ".join(base)), (1, " ".join(left)), (2, " ".join(right)), (None, None), (None, " ".join(base))]
    for rare in (1, 8):
        found = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), rare=rare).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in found if r.n_shingles) == [
            (False, 1, 1), (False, 2, 1), (True, 0, 1), (True, 0, 1)]
    both = brute_links([t for _, t in rows[1:3]])[1]
    assert both == [0, 1]


def test_components_of_nothing_and_low_similarity(spark):
    assert jaccard_join.link_components(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.link_components(empty(spark), similarity=60)


def test_connected_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.comp for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(51)) and {got[100], got[150], got[200]} == {100}


def brute_removed(ids, all_texts, window=13):
    first = {}
    split = [words(t) for t in all_texts]
    for i, w in zip(ids, split):
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            first[s] = min(first.get(s, i), i)
    for i, w in zip(ids, split):
        gone = {p for k in range(len(w) - window + 1) if first[tuple(w[k:k + window])] < i for p in range(k, k + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        yield len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def test_substring_dedup_matches_brute_force(spark):
    """Many shards, and anchors counted as heavy from two segments on."""
    more = near_copies() + ["a b " * 30, "b a " * 30]
    d = documents(spark, more)
    got = rows_by_id(substring_dedup.remove_repeats(d, heavy=1, shard_words=300, keep_text=True))
    everything = [*texts(), *more]
    for i, want in enumerate(brute_removed(range(len(everything)), everything)):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == want, i
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_matching_statistics_match_brute_force():
    """Match lengths, ranges and smallest owners on a text over few symbols."""
    rnd = np.random.default_rng(9)
    parts = [rnd.integers(1, 4, rnd.integers(6, 30)) for _ in range(20)]
    text = np.concatenate([np.append(p, 0) for p in parts])
    index = FMIndex(text, 4, 6)
    at = np.array([i for i in range(len(text) - 5) if (text[i:i + 6] > 0).all()])
    matched, lo, hi = index.matching_statistics(text, at, 6)
    flat = text.tolist()
    for i, m, a, b in zip(at.tolist(), matched.tolist(), lo.tolist(), hi.tolist()):
        window = flat[i:i + 6]

        def places(part):
            return [k for k in range(len(flat) - len(part) + 1) if flat[k:k + len(part)] == part]
        assert m == max(k for k in range(7) if k == 0 or len(places(window[6 - k:])) > 1)
        if m == 6:
            assert sorted(index.suffixes[a:b].tolist()) == places(window)


def test_anchor_hashes_are_those_of_the_windows():
    rnd = np.random.default_rng(4)
    for window, anchor in ((13, 6), (13, 4), (7, 7), (9, 1), (12, 5)):
        for n in (window, window + 1, 60, 400):
            words_ = rnd.integers(0, 5 if n == 60 else 10**9, n).astype(np.uint64)
            at, g = substring_dedup.window_anchors(words_, window, anchor)
            assert np.array_equal(substring_dedup.anchor_hashes(words_, window, anchor), np.unique(g[at]))


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join",
                                                      "secret scans", "packing"]
    clean = {r.doc_id for r in docs.collect()}
    kept = corpus_pipeline.remove_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    assert sum(i not in left for i in clean if lab.get(i) == 0) <= 0.02 * len(clean)

    small = documents(spark, near_copies()).select(*docs.columns)
    unique = corpus_pipeline.remove_exact_copies(spark, small, sf)
    one = corpus_pipeline.remove_near_copies(spark, small, sf)
    masked = corpus_pipeline.mask_secrets(spark, small, sf)
    everything = [*texts(), *near_copies()]
    last = {t or "": i for i, t in enumerate(everything)}
    assert {r.doc_id for r in unique.collect()} == set(last.values())
    assert {r.doc_id for r in one.collect()} == set(brute_links(everything)[1])
    for df in (unique, one, masked):
        assert df.columns == docs.columns
    for r in masked.collect():
        assert r.n_chars == (None if r.text is None else len(r.text))
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty(spark).select(*docs.columns), sf).count() == 0


def test_pipeline_near_copies_by_five_words(spark):
    """The stage as the pipeline runs it; the last text has four scattered
    changes (180 of 220 shingles of five words, 190 of 214 of three)."""
    text = [f"v{i}" for i in range(204)]
    changed = [f"c{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(text)]
    more = [*near_copies(), " ".join(text), " ".join(changed)]
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    got = {r.doc_id for r in stage(spark, documents(spark, more), "").collect()}
    everything = [*texts(), *more]
    assert got == set(brute_links(everything, 80, 5)[1])
    assert len(everything) - 2 in got and len(everything) - 1 not in got

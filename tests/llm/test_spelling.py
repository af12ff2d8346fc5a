"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from listenflow.llm import spelling_variants as sv
from tests.llm.cases import SCHEMA, documents, empty, texts


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}
    partners = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            partners[a].append(b)
            partners[b].append(a)
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(partners[w]), words.get(form[w]))
    return out


def vocabulary():
    """Words over few letters (many near ones), chains of forms, ties, runs of one letter."""
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.choice([4, 5, 5, 6, 8]))) for _ in range(500)}
    words |= {"a" * k for k in range(4, 9)} | {"Ää" * 3, "straße", "strasse", "Straße", "×÷×÷×", "ÿÿÿÿÿÿ"}
    chain = ["colour", "color", "colors", "colours", "kolour", "cooloour"]
    text = [" ".join([w] * rnd.choice([1, 2, 3, 3, 6, 7, 30])) for w in sorted(words)]
    return [*text, *[" ".join([w] * 2 ** (k + 2)) for k, w in enumerate(chain)]]


def test_variants_match_brute_force(spark):
    more = vocabulary()
    docs = documents(spark, more)
    docs = docs.union(spark.createDataFrame([(None, "color colour", *[None] * (len(SCHEMA) - 2))], SCHEMA))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sv.spelling_variants(docs).collect()}
    want = brute([*enumerate([*texts(), *more]), (None, "color colour")])
    assert got == want
    assert max(x[3] for x in got.values()) > 10 and any(x[1] != x[0] != None for x in got.values())  # noqa: E711


def test_signatures_hold_disjoint_pivots():
    order = {g: (i, 10 - i) for i, g in enumerate(sorted({"aa", "ab", "ba", "bb", "bc", "cb"}))}
    for letters in itertools.product("abc", repeat=6):
        word = "".join(letters)
        if any(word[i:i + 2] not in order for i in range(5)):
            continue
        last, pivots, prefix = sv.signature(word, order)
        (_, i), (_, j) = pivots
        assert abs(i - j) >= 2 and set(pivots) <= set(prefix) and max(g for g, _ in prefix) == last
        options = [(x, y) for x, y in itertools.combinations(prefix, 2) if abs(x[1] - y[1]) >= 2]
        weight = {p: order[word[p:p + 2]][1] for _, p in prefix}
        assert weight[i] + weight[j] == min(weight[x[1]] + weight[y[1]] for x, y in options)


def test_no_words_and_short_words(spark):
    assert sv.spelling_variants(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sv.spelling_variants(empty(spark), min_chars=3)

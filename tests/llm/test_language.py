"""Language identification: plain features and decisions, held-out accuracy, bounds, awkward cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from listenflow.llm import language_id as li
from listenflow.llm.common import table
from tests.llm.cases import documents, empty, rows_by_id, texts

SF = "/root/testdata/sf0.1"
MASK = 0xFFFFFFFF


def plain_counts(text):
    """The n-grams of the folded text, hashed one at a time."""
    s = [32]
    for c in text:
        low = c.lower() if c.isalpha() else " "
        s += [ord(low) if len(low) == 1 else ord(c)] if low != " " else [32] if s[-1] != 32 else []
    found = Counter()
    for n in range(1, li.SIZES + 1):
        for i in range(len(s) - n + 1):
            if n == 1 and i == 0:
                continue                    # the blank in front is no symbol of the text
            h = s[i] * 0x9E3779B1 & MASK
            for c in s[i + 1:i + n]:
                h = ((h ^ h >> 15) * 0x85EBCA6B + c) & MASK
            found[(h * 0xC2B2AE35 & MASK) >> 32 - li.BITS] += 1
    return found


SAMPLES = ["Straße ÉTÉ 123 – x", "  lead  and trail  ", "ÀÉ", "a", "İstanbul ǅ 中文 😀 𝒜𝓑", "word " * 50]


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_features_match_plain_loop(monkeypatch, block):
    monkeypatch.setattr(li, "BLOCK", block)
    for text in SAMPLES:
        got = li.ngram_counts(text)
        assert {i: int(c) for i, c in enumerate(got) if c} == plain_counts(text)
        assert abs(float((li.features(text).astype(np.float64) ** 2).sum()) - 1) < 1e-5
    assert li.ngram_counts("") is None and li.ngram_counts("12 .\n😀") is None


def invented(seed, n):
    """Texts of six languages, two of each of three families."""
    rnd = random.Random(seed)
    stems = {"x": ["bra", "kol", "tum", "den"], "y": ["lia", "ero", "sio", "mai"], "z": ["čuš", "žin", "řet", "ďum"]}
    ends = {"x1": "ik", "x2": "un", "y1": "es", "y2": "ao", "z1": "ě", "z2": "ý"}
    rows = []
    for lang, end in ends.items():
        for _ in range(n):
            rows.append((" ".join(rnd.choice(stems[lang[0]]) + rnd.choice(stems[lang[0]]) + (end if rnd.random() < 0.5 else "")
                                  for _ in range(rnd.randint(5, 40))), lang))
    return rows


def test_families_then_pairs():
    model = li.fit_languages(invented(1, 30))
    assert sorted(map(sorted, model.families)) in ([[0, 1], [2, 3, 4, 5]], [[0, 1], [2, 3], [4, 5]],
                                                   [[0, 1, 2, 3], [4, 5]], [[0, 1, 4, 5], [2, 3]])
    held = invented(2, 20)
    names, scores = model.predict([t for t, _ in held])
    assert np.mean([n == lang for n, (_, lang) in zip(names, held)]) > 0.95
    assert 0 <= scores.min() and scores.max() <= 1
    # the decision, by plain loops over the machines
    for text, _ in held[::7]:
        x = [*map(float, li.features(text)), 1.0]

        def dot(w):
            return sum(float(a) * b for a, b in zip(w, x))
        family = max(range(len(model.families)), key=lambda f: dot(model.family_w[f])) if len(model.families) > 1 else 0
        wins = Counter({m: 0 for m in model.families[family]})
        for (a, b), w in zip(model.pairs, model.pair_w):
            if a in wins:
                wins[a if dot(w) >= 0 else b] += 1
        top = [m for m, c in wins.items() if c == max(wins.values())]
        if len(top) == 1:
            assert model.predict([text])[0] == [model.languages[top[0]]]


def test_svm_separates_and_weighs_classes():
    x = np.array([[1.0, 0, 1]] * 30 + [[0, 1.0, 1]] * 2)
    y = np.array([1.0] * 30 + [-1.0] * 2)
    w = li.linear_svm(x @ x.T, y) @ x
    assert ((x @ w) * y > 0.9).all()


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = li.fit_from_documents(docs, 1200)
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    names, _ = model.predict([r.text for r in rows])
    assert np.mean([n == r.lang for n, r in zip(names, rows)]) > 0.99


def test_sample_is_bounded(spark):
    docs = table(spark, SF, "documents")
    twice = docs.union(docs)                                    # repeated ids
    rows = li.training_sample(twice, 200)
    assert 150 < len(rows) <= 200 and max(Counter(lang for _, lang in rows).values()) <= 50
    fold = {(r.text, r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert set(rows) <= fold
    small = li.training_sample(docs, 200, 40_000)
    assert 0 < sum(len(t.encode()) for t, _ in small) <= 40_000
    assert li.training_sample(empty(spark)) == []


def test_awkward_texts(spark):
    model = li.fit_languages(invented(1, 10))
    got = rows_by_id(li.predict_languages(documents(spark), model))
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert got[i].lang_pred in model.languages and 0 <= got[i].score <= 1
    assert (got[5].lang_pred, got[5].score) == (got[6].lang_pred, got[6].score)     # repeated text
    assert li.predict_languages(empty(spark), model).count() == 0
    assert li.fit_languages([]).predict(["a", None])[0] == ["und", "und"]
    assert li.fit_languages([("1 2", "en")]).predict(["a"])[0] == ["und"]
    names, scores = li.fit_languages([("abc", "en")]).predict(["x y", "3"])
    assert names == ["en", "und"] and list(scores) == [1.0, 0.0]

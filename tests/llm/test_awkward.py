"""Null ids, repeated ids with different texts and a very long text, for every
operator that judges documents one by one; plain versions of the classifiers'
features; bounds of the labelled samples."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listenflow.llm import bpe_fst, language_id, packing, pii, quality_cnn, quality_rules, secret_scan, toxicity
from listenflow.llm.common import ARROW_BYTES, labelled_sample, prepare
from tests.llm.cases import texts

LONG = "A long text, 10.0.0.1 and so on; token=abcdef123456. " * 4_000        # 212,000 characters
NICE = [("good text here", 1)] * 5 + [("BAD!! $$$ ###", 0)] * 5


def operators():
    toxic = toxicity.fit_toxicity([("nice words", 0)] * 5 + [("awful scum", 1)] * 5)
    net = quality_cnn.fit_quality(NICE)
    langs = language_id.fit_languages([("good text here", "en")] * 3 + [("gut und schön", "de")] * 3)
    return {
        "pii": lambda d: pii.digest(pii.find_personal_data(d)),
        "quality_rules": lambda d: quality_rules.quality_rules(d, references=[]),
        "quality_cnn": lambda d: quality_cnn.score_quality(d, net).drop("held_out"),
        "secrets": secret_scan.scan_secrets,
        "bpe": bpe_fst.token_digests,
        "toxicity": lambda d: toxicity.score_toxicity(d, toxic).drop("held_out"),
        "language": lambda d: language_id.predict_languages(d, langs).drop("held_out"),
        "packing": lambda d: packing.pack(d).groupBy("doc_id").agg(F.sum("length").alias("ids"), F.count(F.lit(1)).alias("n")).drop("n"),
    }


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")


def result(df):
    return sorted(map(str, df.drop("doc_id").collect()))


@pytest.mark.parametrize("name", sorted(operators()))
def test_null_and_repeated_ids_and_long_texts(spark, name):
    """A document is judged by its text alone, whatever its id."""
    run = operators()[name]
    some = [*texts()[:14], texts()[-1], LONG]
    if name == "packing":
        # ids of one document add up; rows of a null id add up too
        want = {i: n for i, n in run(frame(spark, list(enumerate(some)))).collect()}
        got = run(frame(spark, [(None, t) for t in some])).collect()
        assert [(r.doc_id, r.ids) for r in got] == [(None, sum(want.values()))]
        twice = run(frame(spark, [(5, t) for t in some])).collect()
        assert [(r.doc_id, r.ids) for r in twice] == [(5, sum(want.values()))]
        return
    want = result(run(frame(spark, list(enumerate(some)))))
    assert len(want) == len(some)
    nulls = run(frame(spark, [(None, t) for t in some]))
    assert all(r.doc_id is None for r in nulls.select("doc_id").collect())
    assert result(nulls) == want
    assert result(run(frame(spark, [(5, t) for t in some]))) == want


def test_arrow_batches_are_bounded_in_bytes(spark):
    prepare(spark)
    sizes = (spark.range(60).coalesce(1).select(F.repeat(F.lit("x" * 1000), 1000).alias("t"))
             .mapInArrow(lambda batches: (__import__("pyarrow").record_batch([[b.num_rows]], names=["n"]) for b in batches), "n long")
             .collect())
    assert sum(r.n for r in sizes) == 60 and max(r.n for r in sizes) <= ARROW_BYTES / 1e6 + 1


def test_labelled_sample_is_bounded_in_rows_and_bytes(spark, tmp_path):
    ids = [i for i in range(400)]
    rows = [(i, f"text {i} " * (50 if i % 2 else 5), i % 2) for i in ids]
    copies = [(i, t + "again", y) for i, t, y in rows[:50] for _ in range(40)]      # ids that repeat
    spark.createDataFrame([(i, t) for i, t, _ in rows + copies], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = labelled_sample(spark, str(tmp_path), "toxic", 100)
    assert len(found) == 100 and len({t.split()[1] for t, _ in found}) == 100
    assert all(not t.endswith("again") or t == min(x for i, x, _ in rows + copies if f"text {i} " in x[:len(f"text {i} ")]) for t, _ in found)
    small = labelled_sample(spark, str(tmp_path), "toxic", 100, max_bytes=3000)
    assert found[:len(small)] == small and sum(len(t.encode()) for t, _ in small) <= 3000 < sum(len(t.encode()) for t, _ in found[:len(small) + 1])


def plain_convolution(net, raw):
    """One position, one filter at a time."""
    halves = max(2, -(-(len(raw) + quality_cnn.WIDTH) // (quality_cnn.HALF * quality_cnn.STRIDE)))
    positions = halves * quality_cnn.HALF
    raw = raw.ljust(positions * quality_cnn.STRIDE + quality_cnn.WIDTH, b"\0")
    response = [[sum(float(net.filters[k, raw[p * quality_cnn.STRIDE + k], f]) for k in range(quality_cnn.WIDTH))
                 for f in range(quality_cnn.FILTERS)] for p in range(positions)]
    chunks = []
    for start in range(0, positions - quality_cnn.CHUNK + 1, quality_cnn.HALF):
        block = response[start:start + quality_cnn.CHUNK]
        chunks.append([max(0.0, max(r[f] for r in block) + float(net.bias[f])) for f in range(quality_cnn.FILTERS)])
    mean = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality_cnn.FILTERS)]
    top = [max(c[f] for c in chunks) for f in range(quality_cnn.FILTERS)]
    hidden = [max(0.0, sum(x * float(w) for x, w in zip(mean + top, net.w1[:, h])) + float(net.b1[h])) for h in range(quality_cnn.HIDDEN)]
    z = sum(h * float(w) for h, w in zip(hidden, net.w2)) + float(net.b2[0])
    return 1 / (1 + np.exp(-z))


def test_convolution_matches_plain_loops():
    net = quality_cnn.fit_quality(NICE)
    rnd = random.Random(1)
    raws = [b"", b"a", b"some good text", bytes(rnd.randrange(256) for _ in range(700)), b"BAD!! " * 60, "é中😀".encode() * 30]
    assert np.allclose(net.score(raws), [plain_convolution(net, r) for r in raws], atol=1e-5)


def test_toxicity_features_match_a_plain_set():
    mask = 0xFFFFFFFF
    for text in ("", "ab", "abc", "Some TEXT here, some text", "é中😀 ǅ aaaaaa"):
        s = [ord(c) for c in text.lower()]
        plain = set()
        for n in toxicity.SIZES:
            for i in range(len(s) - n + 1):
                h = s[i] * 0x9E3779B1 & mask
                for c in s[i + 1:i + n]:
                    h = ((h ^ h >> 15) * 0x85EBCA6B + c) & mask
                plain.add((h * 0xC2B2AE35 & mask) >> 32 - toxicity.BITS)
        found = toxicity.ngram_features(text)
        assert set(found.tolist()) == plain
        model = toxicity.fit_toxicity([("nice words here", 0)] * 5 + [("awful scum text", 1)] * 5)
        z = sum(float(model.weights[f]) for f in plain) + model.bias
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-z))) < 1e-6

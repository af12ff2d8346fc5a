"""Classifiers: held-out accuracy, degenerate training sets, awkward texts."""

import zlib

import numpy as np

from listenflow.llm import quality_cnn, toxicity
from listenflow.llm.common import labelled_sample, table
from tests.llm.cases import documents, empty, rows_by_id, texts

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    pos = label == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def held(spark, label):
    lab = table(spark, SF, "labels").select("doc_id", label).dropDuplicates(["doc_id"])
    rows = table(spark, SF, "documents").join(lab, "doc_id").select("doc_id", "text", label).collect()
    return [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]


def test_sample_avoids_held_out_fold_and_is_bounded(spark):
    rows = labelled_sample(spark, SF, "toxic", 500)
    assert len(rows) == 500
    # copies may stand in both folds, so texts are looked up among the training ids
    lab = {r.doc_id for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    allowed = {r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect() if r.doc_id in lab}
    assert {t for t, _ in rows} <= allowed


def test_toxicity_held_out(spark):
    model = toxicity.fit_from_labels(spark, SF, 3000)
    rows = held(spark, "toxic")
    s = model.score([r.text for r in rows])
    assert auc(s, np.array([r.toxic for r in rows])) > 0.93


def test_quality_held_out(spark):
    net = quality_cnn.fit_from_labels(spark, SF, 1000)
    rows = held(spark, "quality")
    s = net.score([r.text.encode() for r in rows])
    assert auc(s, np.array([r.quality for r in rows])) > 0.97


def test_scores_of_awkward_texts(spark):
    net = quality_cnn.fit_quality([("good text here", 1)] * 5 + [("BAD!! $$$ ###", 0)] * 5)
    model = toxicity.fit_toxicity([("nice words", 0)] * 5 + [("awful scum", 1)] * 5)
    for scored, fold in ((quality_cnn.score_quality(documents(spark), net), None),
                         (toxicity.score_toxicity(documents(spark), model), None)):
        got = rows_by_id(scored)
        assert len(got) == len(texts())
        for i, r in got.items():
            assert 0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[0].score == got[1].score          # null and empty
        assert got[5].score == got[6].score          # repeated text
    assert quality_cnn.score_quality(empty(spark), net).count() == 0
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_one_class_or_no_labels():
    assert toxicity.fit_toxicity([]).score(["x y z"])[0] < 1e-6
    assert toxicity.fit_toxicity([("a b c", 1)] * 3).score(["x"])[0] > 0.99
    assert quality_cnn.fit_quality([]).score([b"x"])[0] > 0.99
    assert quality_cnn.fit_quality([("a", 0)] * 3).score([b"x", b""]).max() < 1e-6


def test_long_text_blocks_agree(monkeypatch):
    net = quality_cnn.fit_quality([("good text here", 1)] * 5 + [("BAD!! $$$ ###", 0)] * 5)
    text = b"some good text BAD!! " * 4000
    whole = net.score([text, b"short"])
    monkeypatch.setattr(quality_cnn, "BLOCK", 1 << 12)
    assert np.allclose(net.score([text, b"short"]), whole, atol=1e-6)

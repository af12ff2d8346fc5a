"""BPE transducer against the public library; packing against its definition."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from listenflow.llm import bpe_fst, packing
from tests.llm.cases import documents, empty, rows_by_id, texts


def library():
    ranks = bpe_fst.read_ranks(public_tokenizers.path(bpe_fst.RANKS))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_matches_library():
    ranks, lib = library()
    codec = bpe_fst.Codec(ranks, public_tokenizers.PATTERN)
    rnd = random.Random(2)
    parts = [" ", "\x1c", "\x85", "\xa0", "a", "e", "the", "ing", "1", "٣", "é", "中", "😀", "\n", "\r\n", "\t", "'s",
             "'LL", "!", "~~", "ß", "  ", "zz", "　"]
    cases = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    cases += ["".join(rnd.choice("abcdetanis") for _ in range(rnd.randint(50, 2000))) for _ in range(30)]
    for text, ids in zip(cases, codec.encode_many(cases)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text), repr(text)
        assert "".join(codec.decode_stream(ids, 3)) == text
    for piece in cases[-30:]:
        assert codec.fst.encode(piece.encode()) == lib.encode_ordinary(piece)


def test_small_tables_do_not_change_results(monkeypatch):
    ranks, lib = library()
    monkeypatch.setattr(bpe_fst, "MAX_WORDS", 50)
    monkeypatch.setattr(bpe_fst, "MAX_TRANSITIONS", 200)
    codec = bpe_fst.Codec(ranks, public_tokenizers.PATTERN)
    for _ in range(3):
        for t in texts():
            assert np.frombuffer(codec.encode(t or ""), "<u4").tolist() == lib.encode_ordinary(t or "")


def test_utf8_stream_by_single_bytes():
    text = "aé中😀z"
    machine = bpe_fst.Utf8Stream()
    assert "".join(machine.feed(bytes([b])) for b in text.encode()) == text
    machine.close()


def test_token_digests(spark):
    import hashlib
    _, lib = library()
    got = rows_by_id(bpe_fst.token_digests(documents(spark)))
    for i, t in enumerate(texts()):
        ids = np.array(lib.encode_ordinary(t or ""), "<u4")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = rows_by_id(bpe_fst.decode_documents(bpe_fst.encode_documents(documents(spark))))
    assert all(back[i].text == (t or "") for i, t in enumerate(texts()))
    assert bpe_fst.token_digests(empty(spark)).count() == 0


def check_packing(rows, docs):
    tk = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = collections.Counter()
    seqs, of_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        of_doc[r.doc_id].append(r)
    for doc, group in docs.items():
        ids = np.array(tk.encode(group[0] or "", add_special_tokens=False).ids + [2], "<u4")
        pieces = sorted(of_doc[doc], key=lambda r: (r.start, r.sequence_id))
        covered = np.zeros(len(ids), int)
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
            covered[p.start:p.start + p.length] += 1
        assert (covered == len(group)).all()
        want["tokens"] += len(ids) * len(group)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding / max(1, want["tokens"])


def test_packing(spark):
    more = ["z " * 9000]
    rows = packing.pack(documents(spark, more)).collect()
    assert check_packing(rows, {i: [t] for i, t in enumerate([*texts(), *more])}) < 0.02
    assert packing.pack(empty(spark)).count() == 0


def test_packing_repeated_ids_and_small_padding(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    twice = d.where("doc_id < 40").union(d.where("doc_id < 40"))
    assert check_packing(packing.pack(twice).collect(), {r.doc_id: [r.text] * 2 for r in d.where("doc_id < 40").collect()}) < 0.02


def test_patterns_cover_and_are_near_the_bound():
    rng = np.random.default_rng(3)
    sizes = rng.choice(np.arange(1, 100), 60, replace=False)       # small enough to fill a sequence
    histogram = sorted((int(s), int(n)) for s, n in zip(sizes, rng.integers(200, 4000, 60)))
    ranges, used = packing.pattern_ranges(histogram, 256)
    left = dict(histogram)
    for c, lo, hi, base, count in ranges:
        assert (hi - lo) % count == 0 and base + count <= used
        left[c] -= hi - lo
    assert min(left.values()) >= 0
    volume = sum(c * n for c, n in histogram) / 256
    rest = sum(c * n for c, n in left.items()) / 256
    assert rest <= len(histogram)                       # less than one sequence per pattern
    assert used + rest <= 1.01 * volume


def test_words_of_every_latin_letter():
    """Words that go to the merge model directly give the tokenizer's ids."""
    from tokenizers import Tokenizer

    from listenflow.llm.common import tokenizer_path
    from listenflow.llm.packing import VOCABULARY, WordTokenizer
    path = tokenizer_path(VOCABULARY)
    letters = [chr(c) for c in range(65, 0x260) if chr(c).isalpha()]
    words = [a + b + "en" for a in letters for b in ("", "s", "É", a)] + ["Straße,", "ſt", "ŉa", "ǅungla", "İx", "éte"]
    plain = Tokenizer.from_file(path)
    for word, ids in zip(words, WordTokenizer(path).encode_many([w.encode() for w in words], b"")):
        assert list(memoryview(ids).cast("I")) == plain.encode(word, add_special_tokens=False).ids, word

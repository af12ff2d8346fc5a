"""Byte-level BPE as a lazily determinised finite-state transducer.

The merge ranks are compiled into a transducer that reads a pre-token byte by
byte and writes a token as soon as no later byte can change it.

*States.*  For every prefix of a byte string there is exactly one last token
of the prefix's BPE encoding, and the encoding of a prefix is the chain of
those last tokens.  A token ``t`` can follow a token ``s`` exactly when BPE
encodes the bytes of ``s`` followed by ``t`` as ``[s, t]``; the last token of
a prefix is the longest vocabulary entry ending there that can follow the
last token of the prefix before it.  A later token can only start at a
*live* position: one from which the bytes read so far are the beginning of a
vocabulary entry (at most as many as the longest entry has bytes).  A state
holds the last-token chains of the live positions, cut at the furthest point
where all of them agree.  Tokens before that point are output; the rest is
the bounded lookahead.

*Lazy determinisation.*  A transition ``(state, byte) -> (state, tokens)`` is
computed when a text first needs it and then kept in a table of bounded size
that is emptied when full; the tokens of the words met last are kept likewise.

Decoding streams the tokens' bytes through an incremental UTF-8 machine whose
state is the unfinished character (at most three bytes).

Defined cases: null and empty texts have no token (and the digests of empty
strings); repeated rows are encoded alike; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from listenflow.llm.common import map_texts, narrow, prepare, table, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
MAX_WORDS = 1 << 18         # words remembered per worker, and as many of the generation before
MAX_TRANSITIONS = 1 << 19   # transitions remembered per worker
LONG_PIECE = 64             # longer pre-tokens are read one by one
NO_TOKEN = -1


def unicode_pattern(pattern: str):
    """The pre-token pattern, with ``\\s`` meaning Unicode White_Space as in
    the libraries the rank files are made for."""
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")
                         .replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+"))


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.beginnings = {b[:i] for b in ranks for i in range(1, len(b))}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(max(ranks.values()) + 1)]
        self.halves: dict[int, tuple[int, int]] = {}       # the merge that makes a token
        for piece, token in ranks.items():
            if len(piece) > 1:
                parts = self._merge(piece, below=token)
                if len(parts) == 2:
                    self.halves[token] = (parts[0], parts[1])
        self.joined = {pair: token for token, pair in self.halves.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Empty the transition table."""
        self.follows.clear()
        self.states: dict[tuple, int] = {}
        self.kept: list[tuple] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.start = self._state((NO_TOKEN, b"", ()))

    def _merge(self, piece: bytes, below: int | None = None) -> list[int]:
        """Merge a short string by ascending rank (ranks under ``below`` only)."""
        ranks = self.ranks
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _can_follow(self, s: int, t: int) -> bool:
        """Whether BPE leaves the tokens ``s`` and ``t`` apart when adjacent.

        Merges are undone from the highest rank down, on either side of the
        border.  While the parts that touch the border existed, every merge
        of a lower rank than the ones undone had been tried, so the border
        falls if the touching parts join at a lower rank than that.
        """
        if s == NO_TOKEN:
            return True
        key = (s, t)
        known = self.follows.get(key)
        if known is None:
            known = self.follows[key] = self._apart(s, t)
        return known

    def _apart(self, left: int, right: int) -> bool:
        bound = len(self.ranks) + 1
        halves, joined = self.halves, self.joined
        while True:
            both = joined.get((left, right))
            if both is not None and both < bound:
                return False
            undo_left = left in halves and (left > right or right not in halves)
            if undo_left:
                bound, left = left, halves[left][1]
            elif right in halves:
                bound, right = right + 1, halves[right][0]
            else:
                return True

    def _state(self, state: tuple) -> int:
        n = self.states.get(state)
        if n is None:
            n = self.states[state] = len(self.kept)
            self.kept.append(state)
        return n

    def _move(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Transition of state ``(before, pending, last)``: ``before`` is the
        token ahead of the pending bytes, ``last[i]`` the last token of their
        prefix of ``i + 1`` bytes."""
        before, pending, last = self.kept[number]
        pending += bytes((byte,))
        n = len(pending)
        for size in range(min(n, self.longest), 0, -1):
            t = self.ranks.get(pending[n - size:])
            if t is None:
                continue
            if self._can_follow(before if size == n else last[n - size - 1], t):
                break
        else:
            raise ValueError("vocabulary lacks a single byte")
        last += (t,)
        # the furthest position that the chains of all live positions share
        bytes_of, cut = self.bytes_of, n
        for p in range(n - 1, max(-1, n - self.longest - 1), -1):
            if cut <= 0:
                break
            if pending[p:] not in self.beginnings:
                continue
            a, b = min(p, cut), max(p, cut)
            while a != b:
                b -= len(bytes_of[last[b - 1]])
                if b < a:
                    a, b = b, a
            cut = a
        out: list[int] = []
        if cut > 0:
            at = cut
            while at > 0:
                out.append(last[at - 1])
                at -= len(bytes_of[last[at - 1]])
            out.reverse()
            before, pending, last = out[-1], pending[cut:], last[cut:]
        if pending and pending not in self.beginnings:
            before = NO_TOKEN       # no later token starts right after it
        move = (self._state((before, pending, last)), tuple(out))
        self.moves[number << 8 | byte] = move
        return move

    def _finish(self, number: int) -> list[int]:
        _, pending, last = self.kept[number]
        at, out = len(pending), []
        while at > 0:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token, or of a run of bytes."""
        whole = self.ranks.get(piece)
        if whole is not None:   # as the public library does: an entry of the vocabulary is one token
            return [whole]
        if len(self.moves) >= MAX_TRANSITIONS:
            self.forget()
        state, out, moves = self.start, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state, tokens = move
            if tokens:
                out.extend(tokens)
        return out + self._finish(state)

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of many pre-tokens (little-endian unsigned 32-bit).

        All of them are read in step: at each position the distinct (state,
        byte) pairs are looked up once.
        """
        out = [b""] * len(pieces)
        if len(self.moves) >= MAX_TRANSITIONS:
            self.forget()
        todo = []
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = self.id_bytes[whole]
            elif len(piece) > LONG_PIECE:
                out[i] = b"".join([self.id_bytes[t] for t in self.encode(piece)])
            else:
                todo.append(i)
        if not todo:
            return out
        todo.sort(key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in todo])
        width = int(sizes[0])
        read = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in todo]), np.uint8).reshape(-1, width)
        state = np.full(len(todo), self.start, np.int64)
        moves, move, id_bytes = self.moves, self._move, self.id_bytes
        for at in range(width):
            n = int(np.searchsorted(-sizes, -at, "left"))    # pieces longer than ``at``
            keys, back = np.unique(state[:n] << 8 | read[:n, at], return_inverse=True)
            found = [moves.get(k) or move(k >> 8, k & 255) for k in keys.tolist()]
            state[:n] = np.array([f[0] for f in found], np.int64)[back]
            written = [b"".join([id_bytes[t] for t in f[1]]) if f[1] else None for f in found]
            gives = np.array([w is not None for w in written])[back]
            for j in np.flatnonzero(gives).tolist():
                out[todo[j]] += written[back[j]]
        ends = {k: b"".join([id_bytes[t] for t in self._finish(k)]) for k in set(state.tolist())}
        for j, k in enumerate(state.tolist()):
            out[todo[j]] += ends[k]
        return out


class Utf8Stream:
    """Incremental UTF-8 decoding: feed byte chunks, get whole characters.

    The state is the unfinished character at the end of what was fed.
    """

    def __init__(self):
        self.rest = b""

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        n = len(data)
        cut = n
        for back in range(1, min(3, n) + 1):        # only the last three bytes can be unfinished
            b = data[n - back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                if need > back:
                    cut = n - back
                break
            if b < 0x80:
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8")

    def close(self) -> None:
        if self.rest:
            raise UnicodeDecodeError("utf-8", self.rest, 0, len(self.rest), "unfinished character")


class Codec:
    """Whole texts to token ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.pieces = unicode_pattern(pattern)
        self.known: dict[str, bytes] = {}   # tokens of a word that follows a space
        self.before: dict[str, bytes] = {}  # the generation before
        self.table = [self.fst.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Token ids of whole texts.

        A single space, and a single line feed, between two characters that
        are no white space always start a new match of the pattern, so a text
        is cut there and each part is looked up as it stands after a space; a
        text with any other white space goes through the pattern as a whole.
        The parts not met before are split by the pattern and sent through
        the transducer together.
        """
        if len(self.known) >= MAX_WORDS:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        new: dict[str, list[str]] = {}
        odd = {}
        for i, parts in enumerate(cut):
            first = parts[0]
            ok = bool(first) and not first[0].isspace() and not first[-1].isspace()
            if ok:
                for p in set(parts[1:]):
                    if p in known or p in new:
                        continue
                    if p in before:
                        known[p] = before[p]
                        continue
                    line = p[:1] == "\n"
                    word = p[1:] if line else p
                    if not word or word[0].isspace() or word[-1].isspace():
                        ok = False
                        break
                    new[p] = self.pieces.findall(p if line else " " + p)
            if not ok:
                odd[i] = self.pieces.findall(texts[i])
        firsts = [[] if i in odd else self.pieces.findall(parts[0]) for i, parts in enumerate(cut)]
        words = list({w for found in (*new.values(), *odd.values(), *firsts) for w in found})
        ids = dict(zip(words, self.fst.encode_many([w.encode("utf-8") for w in words])))
        for p, found in new.items():
            known[p] = b"".join([ids[w] for w in found]) if len(found) > 1 else ids[found[0]]
        out = []
        for i, parts in enumerate(cut):
            if i in odd:
                out.append(b"".join([ids[w] for w in odd[i]]))
            else:
                del parts[0]
                out.append(b"".join([ids[w] for w in firsts[i]] + [known[p] for p in parts]))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids: bytes) -> bytes:
        t = self.table
        return b"".join([t[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decode_stream(self, ids: bytes, step: int = 4096):
        """Decoded text in pieces, ``step`` tokens at a time."""
        machine = Utf8Stream()
        for at in range(0, len(ids), 4 * step):
            yield machine.feed(self.decode_bytes(ids[at:at + 4 * step]))
        machine.close()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODECS: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """The worker's codec for a rank file (read once per Python worker)."""
    import public_tokenizers
    path = path or tokenizer_path(RANKS)
    if path not in _CODECS:
        _CODECS[path] = Codec(read_ranks(path), public_tokenizers.PATTERN)
    return _CODECS[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     path: str | None = None) -> DataFrame:
    """``doc_id, ids``: token ids of every whole text as little-endian unsigned 32-bit integers."""
    def run(ids, texts):
        c = codec(path)
        return pa.record_batch([ids, pa.array(c.encode_many(texts.to_pylist()), pa.binary())],
                               names=["doc_id", "ids"])
    return map_texts(narrow(docs, id_col, text_col), run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``."""
    def run(batches):
        c = codec(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(["".join(c.decode_stream(i or b""))
                                                          for i in b.column(1).to_pylist()], pa.string())],
                                  names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  path: str | None = None) -> DataFrame:
    """Encode every text and decode its ids again, in one pass over the texts."""
    def run(ids, texts):
        c = codec(path)
        n, a, d = [], [], []
        for e in c.encode_many(texts.to_pylist()):
            n.append(len(e) // 4)
            a.append(hashlib.sha256(e).hexdigest())
            h = hashlib.sha256()
            for piece in c.decode_stream(e):
                h.update(piece.encode("utf-8"))
            d.append(h.hexdigest())
        return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(a), pa.array(d)],
                               names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_texts(narrow(docs, id_col, text_col), run, SCHEMA)


def op9_query(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_digests(table(spark, sf_dir, "documents"))

"""Cost tables of conversation repair (used inside Spark tasks).

A conversation is a string of symbols, one per message: its role class
(``s``, ``u``, ``a`` or any other, ``x``) and whether it is truncated, or
``DELETE`` when it has to go.  Edits turn its roles into ``(s?(ua)+)?``; the
states of that pattern are 0 (nothing yet), 1 (after ``s``), 2 (after ``u``)
and 3 (after ``ua``); 0 and 3 accept.

The *cost to go* of a place is a vector over the states: the least cost of the
messages from there on.  Less its minimum it is one of a small closed set of
vectors (inserting is always possible, so the entries differ by little).  That
makes the Four-Russians table finite: for every block of ``BLOCK`` symbols and
every normalised vector behind the block it holds the vector before the
block, the cost added, and where each state is led by the chosen edits.
Blocks are looked up from the end to the start; expanding a block backward
gives the vectors inside it, and from them the edits: at every place the
ASCII-least letter that still reaches the least cost, so ties are broken by
the whole audit string and not by the block it falls into.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5     # costs, fixed values
STATES = 4
ROLE_AT = ("user", "user", "assistant", "user")     # the role an edit may put at a state
AFTER_ROLE = (2, 2, 3, 2)                           # and the state it leads to
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
CLASSES = "suax"
MUST_GO = 2 * len(CLASSES)                          # the symbol of blank and duplicate messages
SYMBOLS = MUST_GO + 1
BLOCK = 4
_FAR = 1 << 20


def _consume(symbol: int, q: int):
    """(letter, cost, next state) of the edits that use up a message."""
    yield "D", DELETE, q
    if symbol != MUST_GO:
        more = TRUNCATED * (symbol % 2)
        kept = KEPT[CLASSES[symbol // 2]][q]
        if kept is not None:
            yield "K", KEEP + more, kept
        yield "R", REROLE + more, AFTER_ROLE[q]


def _with_inserts(b: list[int]) -> list[int]:
    out = []
    for q in range(STATES):
        one = AFTER_ROLE[q]
        out.append(min(b[q], INSERT + b[one], 2 * INSERT + b[AFTER_ROLE[one]]))
    return out


def _before(symbol: int, go) -> list[int]:
    return _with_inserts([min(c + go[n] for _, c, n in _consume(symbol, q)) for q in range(STATES)])


def _edit(symbol: int, go, q: int) -> tuple[str, int]:
    """ASCII-least letters from state ``q`` until the message is used up, and the state then."""
    before, letters = _before(symbol, go), ""
    while True:
        options = [(letter, cost + go[n], n) for letter, cost, n in _consume(symbol, q)]
        options.append(("I", INSERT + before[AFTER_ROLE[q]], AFTER_ROLE[q]))
        letter, _, q = min((letter, c, n) for letter, c, n in options if c == before[q])
        letters += letter
        if letter != "I":
            return letters, q


class Tables:
    """Vectors, and the tables for single symbols and for whole blocks."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        end = tuple(_with_inserts([0, _FAR, _FAR, 0]))
        self.vectors, at, todo = [end], {end: 0}, [end]
        rows: list[list[tuple[int, int]]] = []
        while todo:
            go, todo = todo[0], todo[1:]
            row = []
            for s in range(SYMBOLS):
                b = _before(s, go)
                low = min(b)
                v = tuple(x - low for x in b)
                if v not in at:
                    at[v] = len(self.vectors)
                    self.vectors.append(v)
                    todo.append(v)
                row.append((at[v], low))
            rows.append(row)
        n = len(self.vectors)
        # one symbol: vector before, cost added, state after; [symbol, vector behind]
        self.next1 = np.array([[rows[v][s][0] for v in range(n)] for s in range(SYMBOLS)], np.int64)
        self.off1 = np.array([[rows[v][s][1] for v in range(n)] for s in range(SYMBOLS)], np.int64)
        self.edits1 = [[[_edit(s, self.vectors[v], q) for q in range(STATES)] for v in range(n)] for s in range(SYMBOLS)]
        self.state1 = np.array([[[e[1] for e in qs] for qs in vs] for vs in self.edits1], np.int64)
        # every block, grown by one symbol in front at a time
        nxt, off, state = self.next1, self.off1, self.state1
        for _ in range(block - 1):
            codes = len(nxt)
            first = np.arange(SYMBOLS)[:, None, None]
            front = self.state1[np.broadcast_to(first, (SYMBOLS, codes, n)), nxt[None]]
            state = np.take_along_axis(np.broadcast_to(state[None], (SYMBOLS, *state.shape)), front, axis=3)
            off = off[None] + self.off1[first, nxt[None]]
            nxt = self.next1[first, nxt[None]]
            nxt, off, state = (x.reshape(SYMBOLS * codes, *x.shape[2:]) for x in (nxt, off, state))
        self.next_, self.off, self.state = nxt, off, state
        self._next, self._off = nxt.ravel().tolist(), off.ravel().tolist()
        self._next1, self._off1 = self.next1.ravel().tolist(), self.off1.ravel().tolist()
        self.n = n
        self._letters: dict = {}

    def codes(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The first symbols that fill no block, then the blocks' codes."""
        rest = len(symbols) % self.block
        blocks = []
        for i in range(rest, len(symbols), self.block):
            code = 0
            for s in symbols[i:i + self.block]:
                code = code * SYMBOLS + s
            blocks.append(code)
        return symbols[:rest], blocks

    def cost(self, v: int, q: int = 0) -> int:
        return self.vectors[v][q]

    def last_letters(self, q: int) -> str:
        """Inserts behind the last message."""
        return {0: "", 1: "II", 2: "I", 3: ""}[q]

    def _block_letters(self, code: int, v: int, q: int) -> tuple[str, int]:
        found = self._letters.get((code, v, q))
        if found is None:
            symbols, rest = [], code
            for _ in range(self.block):
                symbols.append(rest % SYMBOLS)
                rest //= SYMBOLS
            behind = [v]                            # expanded backward
            for s in symbols[:-1]:
                behind.append(int(self.next1[s, behind[-1]]))
            letters, state = "", q
            for s, b in zip(reversed(symbols), reversed(behind)):
                more, state = self.edits1[s][b][state]
                letters += more
            found = self._letters[(code, v, q)] = (letters, state)
        return found

    def run(self, symbols: list[int], v: int = 0, q: int = 0) -> tuple[str, int, int, int]:
        """Letters, last state, vector before and cost of ``symbols`` in front
        of vector ``v``, entered in state ``q``."""
        rest, blocks = self.codes(symbols)
        n, behind, cost = self.n, [], 0
        for code in reversed(blocks):
            behind.append(v)
            cost += self._off[code * n + v]
            v = self._next[code * n + v]
        behind1 = []
        for s in reversed(rest):
            behind1.append(v)
            cost += self._off1[s * n + v]
            v = self._next1[s * n + v]
        out = []
        for s in rest:
            letters, q = self.edits1[s][behind1.pop()][q]
            out.append(letters)
        for code in blocks:
            letters, q = self._block_letters(code, behind.pop(), q)
            out.append(letters)
        return "".join(out), q, v, cost

    def map_of(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``symbols`` as a map: for every vector behind them the vector before
        and the cost added, and for every state before them the state behind."""
        rest, blocks = self.codes(symbols)
        v, off = np.arange(self.n), np.zeros(self.n, np.int64)
        behind = []
        for code in reversed(blocks):
            behind.append(v)
            off = off + self.off[code, v]
            v = self.next_[code, v]
        for s in reversed(rest):
            behind.append(v)
            off = off + self.off1[s, v]
            v = self.next1[s, v]
        state = np.broadcast_to(np.arange(STATES), (self.n, STATES))
        for s in rest:
            state = np.take_along_axis(self.state1[s, behind.pop()], state, axis=1)
        for code in blocks:
            state = np.take_along_axis(self.state[code, behind.pop()], state, axis=1)
        return v, off, state


def join_maps(left, right):
    """The map of two neighbouring stretches."""
    (lv, lo, ls), (rv, ro, rs) = left, right
    return lv[rv], ro + lo[rv], np.take_along_axis(rs, ls[rv], axis=1)


@lru_cache(maxsize=4)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)

"""Secret scans: fixed patterns plus a password guess-cost estimate.

*Fixed patterns* find assignments to credential names, access key ids and long
hexadecimal runs.  *Added* by the method are values in a credential context
(a credential word, then a separator or a copula, then a value) that the
fixed patterns leave out and that an attacker would need many guesses for.

The guess cost of a value is found by dynamic programming over its
characters: the value is cut into segments, each a dictionary word (also with
letters swapped for digits), a date, a repeat, a keyboard walk or brute force,
and the cheapest segmentation counts.  The cost alone decides, so that plain
words of prose are told from secrets by the dictionary: Spark counts the
documents that each word of ``WORD_CHARS`` letters occurs in, outside of values
in a credential context.  A word stands between white space, punctuation or
quotes, so that letters inside keys and hashes are none, and has to occur in at
least ``MIN_TEXTS`` different texts, so that a password mentioned once is none.
Of each of ``WORD_CLASSES`` hash classes the ``CLASS_WORDS`` most frequent words
(at most 32,768 together) are ranked.  A fixed list of common words keeps its
ranks where they are lower.  Of a value that fixed spans cover in part, the
pieces outside them are scored, up to the closing quote of a quoted value.  The
cost of a segmentation of ``k`` segments is ``log10(k!) + sum(log10(guesses of a
segment))``.  The dynamic program runs once over the whole value, whatever its
length, and follows cuts below ``CEILING`` only: it holds the costs of one
position, and those of the segments that end further on.

Defined cases: null and empty texts have no span; a span is reported once per
kind; added spans never overlap a fixed one; repeated rows are scanned alike;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenflow.llm.common import map_texts, narrow, prepare, table

KINDS = ("assign", "access", "hex", "guess")

# fixed values: the patterns of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# maximal runs of at least 24 digits are the matches of [0-9a-f]+ that count
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

# credential contexts: fixed word list
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[ _-]?key|access[ _-]?key|"
    r"private[ _-]?key|credentials?|auth|bearer|login|pin)[\"']?"
    r"(?:\x20*(?:[:=]|=>|->)\x20*|\x20+(?:is|was)\x20+)[\"']?([^\x00-\x20\x7F]{6,})", re.IGNORECASE | re.ASCII)
CLOSING = "\"'`,.;:)]}>"
MIN_GUESS_LOG10 = 8.0       # 100 million guesses
CEILING = 24.0              # costs from here on are not told apart
LONGEST_WORD = 16

# fixed values: common words in order of use; a word's rank is its guess count
WORDS = (
    "password the and you that was for are with his they this have from one had word but not what all were "
    "when your can said there use each which she how their will other about out many then them these some her "
    "would make like him into time has look two more write see number way could people than first water been "
    "call who now find long down day did get come made may part love admin welcome login master dragon monkey "
    "letmein sunshine princess football baseball secret shadow superman hello freedom whatever trust user test "
    "guest root pass access default changeme example sample demo token key value none null true false string "
    "public private server client system database service account email name http https localhost").split()


class Ranks(dict):
    """Word -> rank; hashed by identity, so that costs can be cached per table."""
    __hash__ = object.__hash__
    __eq__ = object.__eq__


RANK = Ranks({w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))})
WORD_CHARS = (3, 16)
WORD_CLASSES, CLASS_WORDS = 64, 512
MIN_TEXTS = 3
WORD = "(?<![^\\s\"'(\\[])([a-z\u00DF-\u00F6\u00F8-\u00FF]{%d,%d})(?![^\\s.,;:!?\"')\\]])" % WORD_CHARS
SWAPS = str.maketrans("430157@$!", "aeoistasi")     # 4a 3e 0o 1i 5s 7t @a $s !i
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {key: (r, c) for r, row in enumerate(ROWS) for c, key in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d\d)|(?:19|20)\d\d[-/.]?\d\d[-/.]?\d\d|\d{8}|\d{6}")
YEAR = 365.25


def _is_date(s: str) -> bool:
    """Whether the digits of ``s`` are a year, month and day in some order."""
    parts = re.split("[-/.]", s)
    if len(parts) == 1:
        if len(s) == 4:
            return True
        cuts = [(s[:-4], s[-4:-2], s[-2:]), (s[:2], s[2:4], s[4:])]
    else:
        cuts = [parts]
    for a, b, c in cuts:
        for year, month, day in ((a, b, c), (c, a, b), (c, b, a)):
            if (len(year) == 2 or year[:2] in ("19", "20")) and 1 <= int(month) <= 12 and 1 <= int(day) <= 31:
                return True
    return False


def _charset(s: str) -> int:
    size = 0
    if any("a" <= c <= "z" for c in s):
        size += 26
    if any("A" <= c <= "Z" for c in s):
        size += 26
    if any("0" <= c <= "9" for c in s):
        size += 10
    if any(c < "\x80" and not c.isalnum() for c in s):
        size += 33
    if not s.isascii():
        size += 128
    return max(size, 2)


def segments_from(value: str, low: str, swapped: str, i: int, ranks: Ranks):
    """``(end, log10 guesses)`` of every segment at ``i`` other than brute force."""
    n = len(value)
    for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
        rank = ranks.get(low[i:j])
        extra = 0.0
        if rank is None:
            rank = ranks.get(swapped[i:j])
            extra = math.log10(4)
        if rank is not None:
            if value[i:j] != low[i:j] and not value[i:j].isdigit():
                extra += math.log10(2 if value[i:j].istitle() or value[i:j].isupper() else 8)
            yield j, math.log10(rank + 1) + extra
    for width in (4, 6, 8, 10):
        if i + width <= n and DATE.fullmatch(value, i, i + width) and _is_date(value[i:i + width]):
            years = 120.0
            yield i + width, math.log10(years if width == 4 else years * YEAR * (4 if width == 10 else 1))
    # repeats of a unit, as far as they go
    for unit in range(1, LONGEST_WORD + 1):
        block = value[i:i + unit]
        j = i + unit
        while value.startswith(block, j) and j + unit <= n:
            j += unit
        if j - i >= 2 * unit and j - i >= 3:
            yield j, guess_cost(block, ranks) + math.log10((j - i) / unit)
    # keyboard walks and alphabet or digit sequences
    j, turns, way = i + 1, 0, None
    while j < n and low[j] in PLACE and low[j - 1] in PLACE:
        (r0, c0), (r1, c1) = PLACE[low[j - 1]], PLACE[low[j]]
        if (r1 - r0, c1 - c0) == (0, 0) or abs(r1 - r0) > 1 or abs(c1 - c0) > 1:
            break
        if (r1 - r0, c1 - c0) != way:
            turns, way = turns + 1, (r1 - r0, c1 - c0)
        j += 1
        if j - i >= 4:
            yield j, math.log10(47 * (j - i)) + 0.6 * turns
    for step in (1, -1):
        j = i + 1
        while j < n and value[j].isalnum() and ord(value[j]) - ord(value[j - 1]) == step:
            j += 1
            if j - i >= 3:
                yield j, math.log10(26 * (j - i))


# no cut into more segments costs less than CEILING: k of them cost log10(k!) at least
SEGMENTS = next(k for k in range(1, 99) if math.log10(math.factorial(k)) >= CEILING)


@lru_cache(maxsize=1 << 14)
def guess_cost(value: str, ranks: Ranks = RANK) -> float:
    """log10 of the guesses the cheapest segmentation needs, ``CEILING`` if it
    is that or more."""
    low = value.lower()
    if len(low) != len(value):      # a letter whose lower case is longer
        low = value
    swapped = low.translate(SWAPS)
    per_char = math.log10(_charset(value))
    inf = math.inf
    # by number of segments: the cheapest cut of what is behind the position,
    # and of what is behind the start of a brute-force segment that goes on
    best, force = [0.0] + [inf] * SEGMENTS, [inf] * (SEGMENTS + 1)
    ahead: dict[int, list[float]] = {}
    for i in range(len(value)):
        if min(best) < CEILING:
            for end, guesses in segments_from(value, low, swapped, i, ranks):
                at = ahead.setdefault(end, [inf] * (SEGMENTS + 1))
                for k in range(SEGMENTS):
                    if best[k] + guesses < at[k + 1]:
                        at[k + 1] = best[k] + guesses
            for k in range(SEGMENTS):
                force[k + 1] = min(force[k + 1], best[k])
        force = [c if (c := f + per_char) < CEILING else inf for f in force]
        best = ahead.pop(i + 1, None)
        best = list(force) if best is None else list(map(min, best, force))
        if not ahead and min(best) >= CEILING:
            return CEILING
    return min(CEILING, min(c + math.log10(math.factorial(k)) for k, c in enumerate(best)))


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN]
    return out


def word_ranks(docs: DataFrame, text_col: str = "text") -> Ranks:
    """The ranks of the most frequent words of the table.

    Collected to the driver: at most ``WORD_CLASSES * CLASS_WORDS`` words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    prose = F.lower(F.regexp_replace(text, "(?i)" + CONTEXT.pattern, " "))
    found = F.array_distinct(F.regexp_extract_all(prose, F.lit(WORD), F.lit(1)))
    # one of 64 bits per text: copies of a text count once, and 64 is plenty to tell few from many
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(text), F.lit(64)).cast("int"))
    counts = (docs.select(F.explode(found).alias("w"), bit.alias("bit"))
              .groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("texts"))
              .where(F.bit_count("texts") >= MIN_TEXTS))
    # the most frequent of each hash class: no task gets all the words
    by_class = Window.partitionBy(F.pmod(F.xxhash64("w"), F.lit(WORD_CLASSES))).orderBy(F.desc("n"), "w")
    top = counts.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= CLASS_WORDS).select("w", "n").collect()
    ranks = Ranks(RANK)
    for i, r in enumerate(sorted(top, key=lambda r: (-r.n, r.w))):
        ranks[r.w] = min(i + 1, ranks.get(r.w, i + 1))
    return ranks


def _outside(start: int, end: int, taken: list[tuple[int, int, str]]):
    """The pieces of ``start`` to ``end`` that no span of ``taken`` covers."""
    at = start
    for s, e, _ in sorted(taken):
        if s >= end:
            break
        if s > at:
            yield at, s
        at = max(at, e)
    if at < end:
        yield at, end


def guessed_spans(text: str, taken: list[tuple[int, int, str]], least: float = MIN_GUESS_LOG10, ranks: Ranks = RANK):
    """Values in a credential context that take at least ``10**least`` guesses."""
    out = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in CLOSING:
            end -= 1
        if end - start < 6:
            continue
        if not any(s < end and start < e for s, e, _ in taken):
            if guess_cost(text[start:end], ranks) >= least:
                out.append((start, end, "guess"))
            continue
        quote = text[start - 1]
        if quote in "\"'" and (close := text.find(quote, start, end)) >= 0:
            end = close
        out += [(s, e, "guess") for s, e in _outside(start, end, taken) if guess_cost(text[s:e], ranks) >= least]
    return out


def find_secrets(text: str, ranks: Ranks = RANK) -> tuple[list, list]:
    """``(fixed spans, added spans)``, each ``(start, end, kind)`` in code points."""
    fixed = sorted(fixed_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    return fixed, guessed_spans(text, fixed, ranks=ranks)


def as_text(spans) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def redact(text: str, ranks: Ranks = RANK) -> str:
    """The text with every secret replaced by a mark; overlapping spans become one."""
    fixed, added = find_secrets(text, ranks)
    out, at = [], 0
    for start, end, _ in sorted(fixed + added):
        if end <= at:
            continue
        if start >= at:
            out.append(text[at:start])
            out.append("[SECRET]")
        at = end
    out.append(text[at:])
    return "".join(out)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest of the fixed spans and all spans of every whole text."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col))

    def run(ids, texts):
        n = {k: [] for k in KINDS}
        sha, spans = [], []
        for t in texts.to_pylist():
            fixed, added = find_secrets(t, ranks.value)
            for k in KINDS:
                n[k].append(sum(s[2] == k for s in fixed + added))
            sha.append(hashlib.sha256(as_text(fixed).encode()).hexdigest())
            spans.append(as_text(fixed + added))
        long = [pa.array(n[k], pa.int64()) for k in KINDS]
        return pa.record_batch([ids, *long[:3], pa.array(sha), pa.array(spans), long[3]],
                               names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])
    return map_texts(narrow(docs, id_col, text_col), run, SCHEMA)


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` masked; other columns as they are.
    A null text stays null."""
    schema = docs.schema
    at = schema.names.index(text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs, text_col))

    def run(batches):
        for b in batches:
            if b.num_rows:
                texts = [None if t is None else redact(t, ranks.value) for t in b.column(at).to_pylist()]
                yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return scan_secrets(table(spark, sf_dir, "documents"))

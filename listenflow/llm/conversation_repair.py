"""Conversation structure repair by Four-Russians block tables.

Messages of a conversation are edited (keep, rerole, delete, insert) at least
cost until their roles read ``(s?(ua)+)?``; see :mod:`repair_tables` for the
cost vectors and block tables.

*Order.*  Messages are range-partitioned by conversation, turn (nulls first),
role, text and a salt, so that a conversation with a third of all rows, or a
third of all rows being one message, is spread over many tasks; the order is
written once with a running number.

*Faults.*  A message is a duplicate if its number is greater than the smallest
one of its (conversation, role, text); that minimum is pre-aggregated.

*Segments.*  Runs of at most ``2**SEGMENT_BITS`` numbers of one conversation
become one row of symbols.  A conversation of one segment is solved at once.
The segments of a longer one become maps (vector behind -> vector before, cost
added, state before -> state behind), which are joined in a tree of at most
``2**FAN_BITS`` children a node; going down again, each segment learns the
vector behind it and the state before it.  No task sees more than one node.

*Replay.*  The edits of a segment meet its messages in one shuffle of the
texts, sorted, and are applied row by row in a stream.  A digest of a whole
conversation is a stream over it, as SHA-256 is serial by nature; it holds one
batch at a time.

Defined cases: null roles and texts are one space; a null conversation id is a
conversation of its own; null turns come first; messages of one turn are
ordered by role and text (texts alike in their first 32 characters by their
hash); equal rows are duplicates of each other; an empty role is a role of no
known class; a number of gaps beyond 64 bits is null; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.llm.common import prepare, table
from listenflow.llm.repair_tables import AFTER_ROLE, CLASSES, KEPT, MUST_GO, ROLE_AT, STATES, join_maps, tables
from listenflow.operators.ranking import segment_count
from listenflow.session import materialize

SEGMENT_BITS = 12       # 4,096 running numbers a segment
FAN_BITS = 12           # 4,096 children a node
FAULTS = "-tbd"         # none, truncated, blank, duplicate: order of the codes
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
ENDED = "[.!?][\\x20\\x09-\\x0D]*\\z"


def damage(messages: DataFrame) -> DataFrame:
    """The test damage of the query: ``conv_id, turn, role, text, copies`` of
    the rows that are not dropped (``copies`` 2 for a repeated row)."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), k.alias("k"))
    return rows.where("k <> 0").select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def ordered(messages: DataFrame) -> DataFrame:
    """``conv, role, text, copies, o, class_, fault, h1, h2``, written once.

    ``o`` numbers the rows so that those of a conversation are consecutive and
    in order; ``fault`` knows blank and truncated, not yet duplicates.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.col("copies").cast("int") if "copies" in messages.columns else F.lit(1)
    rows = messages.select(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), role.alias("role"),
                           text.alias("text"), copies.alias("copies"))
    rows = rows.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("2"), "role", "text").alias("h2"))
    # only short keys: Spark brings a sample of them to the driver; the salt spreads equal rows
    rows = rows.withColumn("salt", F.rand(13))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32),
            F.substring("text", 1, 32), F.col("h1"), F.col("salt")]
    sorted_ = rows.repartitionByRange(segment_count(messages.sparkSession), *keys).sortWithinPartitions(*keys)
    initial = F.substring("role", 1, 1)
    return materialize(sorted_.select(
        "conv", "role", "text", "copies", F.monotonically_increasing_id().alias("o"),
        F.when(initial.isin(*"sua"), initial).otherwise("x").alias("class_"),
        F.when(~F.col("text").rlike(NOT_SPACE), "b").when(~F.col("text").rlike(ENDED), "t").otherwise("-").alias("fault"),
        "h1", "h2"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def segments(rows: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``conv, at, codes``: one row per segment; a letter per message after
    damage for its class and first fault, in order."""
    heard = rows.where("fault <> 'b'").groupBy("conv", "h1", "h2").agg(
        F.min("o").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    heard = heard.select(F.col("conv").alias("c_"), F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), "first")
    marked = rows.select("conv", "o", "copies", "class_", "fault", "h1", "h2").join(
        heard, _same("conv", "c_") & (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")), "left")
    repeat = F.col("o") > F.col("first")
    fault = F.when(F.col("fault") == "b", 2).when(F.coalesce(repeat, F.lit(False)), 3).when(F.col("fault") == "t", 1).otherwise(0)
    later = F.when(F.col("fault") == "b", 2).otherwise(3)       # what a second copy is

    def letter(f: Column) -> Column:
        return F.char(F.lit(ord("a")) + (F.instr(F.lit(CLASSES), F.col("class_")) - 1) * len(FAULTS) + f)
    letters = F.concat(letter(fault), F.repeat(letter(later), F.col("copies") - 1))
    return (marked.select("conv", F.shiftright("o", segment_bits).alias("at"), "o", letters.alias("letters"))
            .groupBy("conv", "at").agg(F.sort_array(F.collect_list(F.struct("o", "letters"))).alias("s"))
            .select("conv", "at", F.array_join(F.col("s.letters"), "").alias("codes")))


# --- inside tasks -----------------------------------------------------------

_CLASS = {chr(ord("a") + i): CLASSES[i // 4] for i in range(4 * len(CLASSES))}
_SYMBOL = {chr(ord("a") + i): i // 4 * 2 + i % 4 if i % 4 < 2 else MUST_GO for i in range(4 * len(CLASSES))}
_CLASSES = str.maketrans(_CLASS)
_FAULT = str.maketrans({chr(ord("a") + i): FAULTS[i % 4] for i in range(4 * len(CLASSES))})
LEGAL = ("su", "ua", "au")


def _tally(codes: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated, illegal pairs of a run of messages."""
    faults, classes = codes.translate(_FAULT), codes.translate(_CLASSES)
    legal = sum(classes.count(p) for p in LEGAL)
    return faults.count("b"), faults.count("d"), faults.count("t"), max(len(codes) - 1 - legal, 0)


def _symbols(codes: str) -> list[int]:
    return [_SYMBOL[c] for c in codes]


def _pack(m) -> tuple[bytes, bytes, bytes]:
    v, off, state = m
    return v.astype("<i2").tobytes(), off.astype("<i8").tobytes(), np.ascontiguousarray(state).astype("u1").tobytes()


def _unpack(v: bytes, off: bytes, state: bytes):
    return (np.frombuffer(v, "<i2").astype(np.int64), np.frombuffer(off, "<i8"),
            np.frombuffer(state, "u1").astype(np.int64).reshape(-1, STATES))


STAT = "blank long, duplicate long, truncated long, illegal long"
MAP = f"v binary, off binary, state binary, {STAT}, ends string"
STATS = ["blank", "duplicate", "truncated", "illegal"]


def _rows(batch: pa.RecordBatch):
    return zip(*[c.to_pylist() for c in batch.columns])


def _batch(rows: list[tuple], conv: pa.Array, names: list[str], types: list) -> pa.RecordBatch:
    """``rows`` behind a conversation column that is passed on as it came."""
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.record_batch([conv, *[pa.array(c, t) for c, t in zip(cols, types)]], names=["conv", *names])


_I, _B, _S = pa.int64(), pa.binary(), pa.string()


# --- stages -----------------------------------------------------------------

def _solve(short: DataFrame, conv_type: str) -> DataFrame:
    """Conversations of one segment, entered with ``v`` behind it and ``q`` before it."""
    def run(batches):
        t = tables()
        for b in batches:
            out = []
            for at, codes, v, q, last in _rows(b.select(b.schema.names[1:])):
                letters, end, before, cost = t.run(_symbols(codes), v, q)
                out.append((at, f"{q}{letters}{t.last_letters(end) if last else ''}", cost + t.cost(before),
                            *_tally(codes)))
            yield _batch(out, b.column(0), ["at", "script", "cost", *STATS], [_I, _S, _I, _I, _I, _I, _I])
    return (short.select("conv", "at", "codes", "v", "q", "last")
            .mapInArrow(run, f"conv {conv_type}, at long, script string, cost long, {STAT}"))


def _leaf_maps(long_: DataFrame, conv_type: str) -> DataFrame:
    def run(batches):
        t = tables()
        for b in batches:
            out = []
            for at, codes in _rows(b.select(["at", "codes"])):
                ends = codes[0].translate(_CLASSES) + codes[-1].translate(_CLASSES)
                out.append((at, *_pack(t.map_of(_symbols(codes))), *_tally(codes), ends))
            yield _batch(out, b.column(0), ["at", "v", "off", "state", *STATS, "ends"], [_I, _B, _B, _B, _I, _I, _I, _I, _S])
    return long_.select("conv", "at", "codes").mapInArrow(run, f"conv {conv_type}, at long, {MAP}")


def _grouped(maps: DataFrame, bits: int) -> DataFrame:
    """``conv, at, kids``: the nodes of the next level with their children in order."""
    kid = F.struct("at", "v", "off", "state", *STATS, "ends")
    return (maps.groupBy("conv", F.shiftright("at", bits).alias("up")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))
            .withColumnRenamed("up", "at"))


def _joined_maps(nodes: DataFrame, conv_type: str) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for at, kids in _rows(b.select(["at", "kids"])):
                m, stats, ends = None, [0, 0, 0, 0], ""
                for k in kids:
                    part = _unpack(k["v"], k["off"], k["state"])
                    m = part if m is None else join_maps(m, part)
                    stats = [x + k[s] for x, s in zip(stats, STATS)]
                    if ends and ends[-1] + k["ends"][0] not in LEGAL:
                        stats[3] += 1
                    ends = (ends or k["ends"])[0] + k["ends"][-1]
                out.append((at, *_pack(m), *stats, ends))
            yield _batch(out, b.column(0), ["at", "v", "off", "state", *STATS, "ends"], [_I, _B, _B, _B, _I, _I, _I, _I, _S])
    return nodes.select("conv", "at", "kids").mapInArrow(run, f"conv {conv_type}, at long, {MAP}")


def _children(nodes: DataFrame, told: DataFrame, conv_type: str) -> DataFrame:
    """``conv, at, vq, q, last`` of every child, from those of its node."""
    def run(batches):
        for b in batches:
            out, which = [], []
            for i, (kids, v, q, last) in enumerate(_rows(b.select(["kids", "vq", "q", "last"]))):
                maps = [_unpack(k["v"], k["off"], k["state"]) for k in kids]
                behind = [v]
                for m in reversed(maps[1:]):
                    behind.append(int(m[0][behind[-1]]))
                for j, (k, m, w) in enumerate(zip(kids, maps, reversed(behind))):
                    out.append((k["at"], w, q, last and j == len(kids) - 1))
                    which.append(i)
                    q = int(m[2][w, q])
            yield _batch(out, b.column(0).take(pa.array(which, pa.int64())), ["at", "vq", "q", "last"],
                         [_I, _I, _I, pa.bool_()])
    told = told.select(F.col("conv").alias("c_"), F.col("at").alias("at_"), "vq", "q", "last")
    return (nodes.join(told, _same("conv", "c_") & (F.col("at") == F.col("at_")))
            .select("conv", "kids", "vq", "q", "last")
            .mapInArrow(run, f"conv {conv_type}, at long, vq long, q long, last boolean"))


def edit_scripts(segs: DataFrame, fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame]:
    """From :func:`segments`: the scripts ``conv, at, script`` (state before,
    then letters) per segment, and ``conv, blank, duplicate, truncated,
    illegal, cost`` per conversation."""
    conv_type = segs.schema["conv"].dataType.simpleString()
    several = segs.groupBy("conv").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("conv").alias("c_"))
    match = _same("conv", "c_")
    start = (F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(True))
    short = _solve(segs.join(several, match, "left_anti").select(
        "*", start[0].alias("v"), start[1].alias("q"), start[2].alias("last")), conv_type)
    short = materialize(short)
    long_ = materialize(segs.join(several, match, "left_semi"))

    levels, maps = [], materialize(_leaf_maps(long_, conv_type))
    while maps.groupBy("conv").count().where("count > 1").limit(1).count():
        levels.append(materialize(_grouped(maps, fan_bits)))
        maps = materialize(_joined_maps(levels[-1], conv_type))

    def total(v: bytes, off: bytes) -> int:     # the whole conversation: nothing behind, nothing before
        return int(np.frombuffer(off, "<i8")[0]) + tables().cost(int(np.frombuffer(v, "<i2")[0]))

    def costs(batches):
        for b in batches:
            yield _batch([(total(v, off), *rest) for v, off, *rest in _rows(b.select(["v", "off", *STATS]))],
                         b.column(0), ["cost", *STATS], [_I] * 5)
    whole = maps.select("conv", "v", "off", *STATS).mapInArrow(costs, f"conv {conv_type}, cost long, {STAT}")

    told = maps.select("conv", "at", start[0].alias("vq"), start[1].alias("q"), start[2].alias("last"))
    for nodes in reversed(levels):
        told = materialize(_children(nodes, told, conv_type))
    told = told.select(F.col("conv").alias("c_"), F.col("at").alias("at_"), F.col("vq").alias("v"), "q", "last")
    parts = _solve(long_.join(told, match & (F.col("at") == F.col("at_"))), conv_type)
    scripts = short.select("conv", "at", "script").union(parts.select("conv", "at", "script"))
    stats = short.select("conv", *STATS, "cost").union(whole.select("conv", *STATS, "cost"))
    return scripts, stats


class _Replay:
    """Applies scripts to messages in a stream of both, sorted."""

    def __init__(self):
        self.letters, self.q = iter(""), 0

    def start(self, script: str):
        self.letters, self.q = iter(script[1:]), int(script[0])

    def _put(self, text: str) -> tuple[str, str]:
        role, self.q = ROLE_AT[self.q], AFTER_ROLE[self.q]
        return role, text

    def message(self, role: str, text: str):
        for letter in self.letters:
            if letter == "I":
                yield self._put("")
                continue
            if letter == "R":
                yield self._put(text)
            elif letter == "K":
                self.q = KEPT[role[0]][self.q]
                yield role, text
            return

    def rest(self):
        for _ in self.letters:      # only inserts are left
            yield self._put("")


def _stream(rows: DataFrame, scripts: DataFrame, by: list[str], segment_bits: int) -> DataFrame:
    """Messages and, in front of each segment, its script."""
    nothing = F.lit(None).cast("string")
    both = scripts.select("conv", "at", F.shiftleft("at", segment_bits).alias("o"), F.lit(0).alias("kind"),
                          "script", nothing.alias("role"), nothing.alias("text"), F.lit(0).alias("copies")).union(
        rows.select("conv", F.shiftright("o", segment_bits).alias("at"), "o", F.lit(1).alias("kind"),
                    nothing.alias("script"), "role", "text", "copies"))
    return both.repartition(*by).sortWithinPartitions("conv", "o", "kind").select("conv", "o", "script", "role", "text", "copies")


def repaired_messages(rows: DataFrame, scripts: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``conv_id, place, part, role, text``: the repaired conversations; order by
    ``place, part`` within a conversation.  Partitioned by segment."""
    conv_type = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        replay, left = _Replay(), None
        for b in batches:
            out, which = [], []
            for i, (o, script, role, text, copies) in enumerate(_rows(b.select(b.schema.names[1:]))):
                if script is not None:
                    replay.start(script)
                    left = script.count("K") + script.count("R") + script.count("D")
                    continue
                made = [m for _ in range(copies) for m in replay.message(role, text)]
                left -= copies
                if left == 0:
                    made += replay.rest()
                out += [(o, part, r, t) for part, (r, t) in enumerate(made)]
                which += [i] * len(made)
            yield _batch(out, b.column(0).take(pa.array(which, pa.int64())), ["place", "part", "role", "text"], [_I, _I, _S, _S])
    return (_stream(rows, scripts, ["conv", "at"], segment_bits)
            .mapInArrow(run, f"conv {conv_type}, place long, part long, role string, text string")
            .withColumnRenamed("conv", "conv_id"))


def digests(rows: DataFrame, scripts: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """``conv, audit, repaired_sha256``: the letters of all edits and the hash of
    the repaired ``role:text`` lines."""
    conv_type = rows.schema["conv"].dataType.simpleString()

    def run(batches):
        replay, sha, audit, empty, conv, started = _Replay(), None, [], True, None, False

        def feed(messages):
            nonlocal empty
            for role, text in messages:
                sha.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode("utf-8", "surrogatepass"))
                empty = False

        def close():
            feed(replay.rest())
            return "".join(audit), sha.hexdigest()
        for b in batches:
            done, ids = [], []
            for c, o, script, role, text, copies in _rows(b):
                if not started or c != conv:
                    if started:
                        done.append(close())
                        ids.append(conv)
                    conv, started, sha, audit, empty, replay = c, True, hashlib.sha256(), [], True, _Replay()
                if script is not None:
                    replay.start(script)
                    audit.append(script[1:])
                else:
                    for _ in range(copies):
                        feed(replay.message(role, text))
            yield _batch(done, pa.array(ids, b.schema.field(0).type), ["audit", "repaired_sha256"], [_S, _S])
            kind = b.schema.field(0).type
        if started:
            yield _batch([close()], pa.array([conv], kind), ["audit", "repaired_sha256"], [_S, _S])
    return (_stream(rows, scripts, ["conv"], segment_bits)
            .mapInArrow(run, f"conv {conv_type}, audit string, repaired_sha256 string"))


def repair(messages: DataFrame, segment_bits: int = SEGMENT_BITS,
           fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``conv_id, turn, role, text`` (and ``copies``, where rows stand for
    several): the ordered rows, the scripts and the statistics."""
    rows = ordered(messages)
    segs = materialize(segments(rows, segment_bits))
    scripts, stats = edit_scripts(segs, fan_bits)
    return rows, materialize(scripts), stats


def audit_repairs(conversations: DataFrame, segment_bits: int = SEGMENT_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """The table of the query, for the damaged ``conversations``."""
    damaged = damage(conversations)
    rows, scripts, stats = repair(damaged, segment_bits, fan_bits)
    digest = digests(rows, scripts, segment_bits)
    big = "decimal(38,0)"       # turns may lie anywhere in 64 bits
    seen = damaged.groupBy("conv_id").agg(
        (F.max("turn").cast(big) - F.min("turn").cast(big) + 1 - F.countDistinct("turn")).alias("gaps"))
    out = conversations.select("conv_id").distinct()
    for i, part in enumerate((seen.withColumnRenamed("conv_id", "conv"), stats, digest)):
        out = out.join(part.withColumnRenamed("conv", f"c{i}"), _same("conv_id", f"c{i}"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).try_cast("long").alias(c) for c in ("gaps", *STATS, "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return audit_repairs(table(spark, sf_dir, "conversations"))

"""Personal data by bootstrapped contextual extraction (native DataFrame operations only).

*Seeds.*  Four fixed patterns (e-mail, IPv4, payment card, phone) give the base
spans.  *Candidates* are strings of a looser shape per kind that the fixed
patterns leave out (obfuscated addresses, numbers without a country code, ...).
*Patterns* are the two words to the left of a seed or candidate.

Spark builds the bipartite graph of patterns and instances (distinct values)
and scores it in ``ROUNDS`` rounds: the confidence of a pattern is the mean
score of its distinct instances (a seed scores 1, an unknown candidate 0 at
first) with ``PRIOR`` imaginary instances of score 0 added; the score of a
candidate is ``1 - product(1 - confidence)`` over its patterns.  A pattern is
accepted when at least ``MIN_SEEDS`` distinct instances support it and its
confidence is at least ``MIN_CONFIDENCE``; seeds support from the start, and
after each round the candidates behind accepted patterns are promoted and
support the patterns of the next round.  At the end the candidates behind
accepted patterns are added to the spans.  Base spans always stay.

One pass over the texts finds seeds and candidates; it is written once in the
shared checkpoint folder, as are the graph's edges.  Everything after it works
on (pattern, instance) rows, aggregated before every shuffle; the joins on a
hot pattern are plain equi-joins that adaptive execution splits.

Defined cases: a null text counts as empty and has no span; a repeated row
keeps its own spans; an added span that overlaps a base span is left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenflow.llm.common import prepare, table
from listenflow.session import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
PRIOR = 2.0
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.6
CONTEXT_CHARS = 48
BLOCK = 128

# The contract's patterns.  Possessive quantifiers and the look-behinds only
# spare the engine retries that must fail: a run is tried from its start (or
# from the end of the match before), not from each of its characters.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]+",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
# a character without which a text has no match of the kind
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "email": f"(?<!{_LOCAL}){_LOCAL}++ ?(?:\\(at\\)|\\[at\\]|\\{{at\\}}|(?<= )at(?= )) ?[A-Za-z0-9-]+"
             "(?: ?(?:\\.|\\(dot\\)|\\[dot\\]|\\{dot\\}|(?<= )dot(?= )) ?[A-Za-z0-9-]+)+",
    "ip": "(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"
          "|[0-9]{1,3}(?:(?:\\[\\.\\]|\\(\\.\\)| dot )[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    "card": "(?<![0-9A-Za-z.+-])[0-9]{4}(?:[ ._/-]?[0-9]{4}){3}(?:[0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": "(?<![0-9A-Za-z.+-])(?<!\\+[0-9]{1,3} )(?:\\([0-9]{2,4}\\)|[0-9]{2,4})[ ./-][0-9]{3,4}[ .-]?[0-9]{3,4}"
             "(?![0-9A-Za-z])",
}


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def spans_of(text: Column, pattern: str) -> Column:
    """Array of ``(s, e, v, left)`` of the leftmost non-overlapping matches.

    The pieces between the matches give the positions; sums over blocks of
    ``BLOCK`` matches keep texts with very many matches cheap.
    """
    made = "array<struct<s:int,e:int,v:string,left:string>>"

    def place(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def with_pieces(p: Column) -> Column:
            steps = F.transform(found, lambda v, i: F.char_length(F.get(p, i)) + F.char_length(v))

            def with_steps(d: Column) -> Column:
                blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(d) / BLOCK).cast("int")),
                                     lambda b: _total(F.slice(d, b * BLOCK + 1, F.lit(BLOCK))))

                def with_blocks(t: Column) -> Column:
                    before = F.transform(t, lambda x, b: _total(F.slice(t, F.lit(1), b)))

                    def final(o: Column) -> Column:
                        def one(v: Column, i: Column) -> Column:
                            block = F.floor(i / BLOCK).cast("int")
                            start = (F.get(o, block) + _total(F.slice(d, block * BLOCK + 1, i - block * BLOCK))
                                     + F.char_length(F.get(p, i)))
                            return F.struct(start.alias("s"), (start + F.char_length(v)).alias("e"), v.alias("v"),
                                            _left(F.get(p, i)).alias("left"))
                        return F.transform(found, one)
                    return _let(before, final)
                return _let(blocks, with_blocks)
            return _let(steps, with_steps)
        return F.when(F.size(found) == 0, F.array().cast(made)).otherwise(_let(pieces, with_pieces)).cast(made)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _left(piece: Column) -> Column:
    """The end of ``piece`` that holds its last two words; all of it when they
    are longer than ``CONTEXT_CHARS``."""
    end = F.substring(piece, -CONTEXT_CHARS, CONTEXT_CHARS)
    return F.when(end.rlike("\\s\\S+\\s+\\S+\\s*$"), end).otherwise(piece)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits of ``v`` pass the Luhn check."""
    doubled = F.transform(F.split(F.reverse(_digits(v)), ""),
                          lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
                              2 * x.cast("int") - F.when(x.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return _total(F.filter(doubled, lambda x: x.isNotNull())) % 10 == 0


def holds(kind: str, v: Column) -> Column:
    """The contract's test of a match."""
    n = F.char_length(_digits(v))
    if kind == "ip":
        parts = F.transform(F.split(v, "\\."), lambda x: F.ltrim(x, F.lit("0")))
        return F.forall(parts, lambda x: (F.char_length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), _luhn(v)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 8) & (n <= 15)
    return F.lit(True)


def _pattern(left: Column) -> Column:
    """The two words to the left, lower case, digits as 0; null without a letter."""
    words = F.regexp_extract(F.lower(F.regexp_replace(left, "[0-9]", "0")), "(?:^|\\s)(\\S*\\s*\\S+)\\s*$", 1)
    return F.when(words.rlike("\\p{L}"), F.regexp_replace(words, "\\s+", " "))


def _gated(kind: str, text: Column, value: Column, empty: Column) -> Column:
    need = NEEDS[kind]
    return value if need is None else F.when(text.contains(need), value).otherwise(empty)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: ``_row, _id`` and per kind its base spans
    (``b_<kind>``) and candidates (``c_<kind>``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    none = F.array().cast("array<struct<s:int,e:int,v:string,left:string>>")
    base = {f"b_{k}": _gated(k, text, _kept(spans_of(text, BASE[k]), k), none) for k in KINDS}
    digit = text.rlike("[0-9]")
    loose = {f"c_{k}": F.when(text.rlike("[(\\[{ ]at[)\\]} ]") if k == "email" else digit,
                              spans_of(text, LOOSE[k])).otherwise(none) for k in KINDS}
    return rows.select(F.monotonically_increasing_id().alias("_row"), "_id",
                       *[c.alias(n) for n, c in {**base, **loose}.items()])


def _kept(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: holds(kind, s["v"]))


def occurrences(found: DataFrame) -> DataFrame:
    """Seeds and candidates with their pattern: ``_row, kind, s, e, pattern, instance, seed``."""
    parts = F.concat(*[
        F.transform(F.col(f"{p}_{k}"), _occurrence(k, p == "b")) for p in "bc" for k in KINDS])
    return (found.select("_row", F.explode(parts).alias("o")).select("_row", "o.*")
            .withColumn("pattern", _pattern(F.col("left"))).drop("left"))


def _occurrence(kind: str, seed: bool):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["left"].alias("left"),
                              F.xxhash64(F.lower(x["v"])).alias("instance"), F.lit(seed).alias("seed"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
                   min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``kind, pattern, support, confidence, accepted`` from distinct
    ``kind, pattern, instance, seed`` rows; ``support`` counts seeds and
    promoted candidates."""
    scores = None
    for _ in range(rounds):
        if scores is None:
            scored = edges.withColumn("score", F.col("seed").cast("double")).withColumn("supports", F.col("seed"))
        else:
            scored = edges.join(scores, ["kind", "instance"], "left").withColumn(
                "score", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0)))).withColumn(
                "supports", F.col("seed") | F.coalesce("promoted", F.lit(False)))
        patterns = scored.groupBy("kind", "pattern").agg(
            F.sum(F.col("supports").cast("long")).alias("support"),
            (F.sum("score") / (F.count(F.lit(1)) + PRIOR)).alias("confidence"))
        patterns = patterns.withColumn(
            "accepted", (F.col("support") >= min_seeds) & (F.col("confidence") >= min_confidence))
        # only candidates need a score; patterns no seed supports cannot give one
        scores = (edges.where("not seed").join(patterns.where("confidence > 0"), ["kind", "pattern"])
                  .groupBy("kind", "instance")
                  .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))))).alias("score"),
                       F.max("accepted").alias("promoted")))
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``doc_id``, the base spans per kind and ``added``: array of ``(kind, s, e)``."""
    found = materialize(scan(docs, id_col, text_col))
    occ = occurrences(found).where(F.col("pattern").isNotNull())
    edges = materialize(occ.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed")))
    good = score_patterns(edges, ROUNDS, min_seeds, min_confidence).where("accepted")
    added = (occ.where("not seed").join(good.select("kind", "pattern"), ["kind", "pattern"])
             .groupBy("_row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("added")))
    rows = found.select("_row", F.col("_id").alias("doc_id"), *[f"b_{k}" for k in KINDS])
    base = F.concat(*[F.col(f"b_{k}") for k in KINDS])
    free = F.filter("added", lambda a: ~F.exists(base, lambda b: (b["s"] < a["e"]) & (a["s"] < b["e"])))
    return (rows.join(added, "_row", "left")
            .withColumn("added", F.coalesce(free, F.array().cast("array<struct<kind:string,s:int,e:int>>"))).drop("_row"))


def _joined(kind: str, base: Column, added: Column | None) -> Column:
    """``kind:start:end`` of one kind, by start."""
    spans = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    if added is not None:
        more = F.transform(F.filter(added, lambda a: a["kind"] == kind),
                           lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e")))
        spans = F.array_sort(F.array_distinct(F.concat(spans, more)))
    return F.transform(spans, lambda x: F.concat(F.lit(kind + ":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))


def digest(found: DataFrame) -> DataFrame:
    base = F.array_join(F.concat(*[_joined(k, F.col(f"b_{k}"), None) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[_joined(k, F.col(f"b_{k}"), F.col("added")) for k in KINDS]), ",")
    return found.select("doc_id", *[F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(base, 256).alias("base_sha256"), every.alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return digest(find_personal_data(table(spark, sf_dir, "documents")))

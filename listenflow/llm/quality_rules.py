"""Quality rules by distribution divergence (native DataFrame operations only).

Each document gives two histograms: its characters over ``CHAR_CLASSES`` and
its words over the common words of the languages (every other word falls into
one rest bin).  They are compared with references of each language by the
Jensen-Shannon distance (base 2, so 0 to 1), and the distance to the nearest
language counts.  References are sums over *all* documents of a language; the
common words of a language are its ``COMMON`` most frequent words of at most
``COMMON_CHARS`` letters, so both have a fixed size.  Every language with
``MIN_REFERENCE_WORDS`` words or more has a reference, whatever its share of
the table.  The ``LANGUAGES`` with most documents are literals of the second
pass and every document is compared with them; if there are more, the others
are joined on the language, and a document is compared with its own as well.
A document whose language has no reference passes both distance rules: they
have nothing to judge it by.  One without a language is judged by the nearest of
the references.  Minimum-length guards: the character distance is used from
``MIN_CHARS`` word characters on, the word distance from ``MIN_WORDS`` words
on, with an allowance of ``WORD_NOISE / sqrt(words)`` for chance; shorter
documents pass that rule.

Both passes are maps over the documents (array functions inside a row); only
the reference counts are shuffled, after partial aggregation.

The statistics of a document leave their projection through a generator: no
filter on what they decide is moved below it, where their expressions would be
evaluated again inside one another.

Defined cases: a null text has no word (and fails the rule of ten words); an
unknown language is a language of its own, and so is the null one as a
reference; an empty table gives an
empty result; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenflow.llm.common import WORD_BREAK, prepare, table
from listenflow.session import materialize

COMMON = 24
COMMON_CHARS = 8
LANGUAGES = 64              # references that every document is compared with
MIN_REFERENCE_WORDS = 2000  # a language needs this many words for stable histograms
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.27
# the distance of n words drawn from the reference itself shrinks as 1/sqrt(n)
MAX_WORD_DISTANCE = 0.18
WORD_NOISE = 1.8        # good labelled documents reach 1.68
# name -> characters taken away in this order; the rest is the last class
CHAR_CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("space", WORD_BREAK), ("letter", "\\p{L}+"),
                ("digit", "[0-9]+"), ("point", "[.,;:!?'\"()-]+"))
CLASS_NAMES = [n for n, _ in CHAR_CLASSES] + ["other"]
SYMBOLS = "[#*$%&|<>]"      # fixed value


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def char_classes(docs: DataFrame) -> DataFrame:
    """Adds ``_c_<class>``: characters of ``_text`` per class."""
    rest = "_text"
    made = []
    for i, (name, pattern) in enumerate(CHAR_CLASSES):
        docs = docs.withColumn(f"_r{i}", F.regexp_replace(rest, pattern, ""))
        docs = docs.withColumn(f"_c_{name}", (F.char_length(rest) - F.char_length(f"_r{i}")).cast("long"))
        made.append(f"_r{i}")
        rest = f"_r{i}"
    return (docs.withColumn("_c_other", F.char_length(rest).cast("long"))
            .withColumn("_symbols", F.regexp_count(F.col("_r2"), F.lit(SYMBOLS)).cast("long")).drop(*made))


def repeat_words(words: str) -> Column:
    """Words covered by a five-word window that occurs twice or more in the text.

    Windows are compared by a 64-bit hash of their five words; only texts in
    which two are equal sort them, so a long text costs n log n.
    """
    w = F.col(words)

    def covered(windows: Column) -> Column:
        def runs(s: Column) -> Column:
            hit = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return _let(F.array_sort(F.transform(hit, lambda x: x["i"])),
                        lambda p: F.aggregate(
                            F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))),
                            F.lit(0), lambda a, x: a + x))
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(ordered, runs))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 5),
                          lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
    return F.when(F.size(w) < 6, F.lit(0)).otherwise(_let(windows, covered)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _base(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"))


def reference_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """``lang, docs, classes, words`` of every language with enough words: its
    character-class shares and the shares of its common words."""
    base = _base(docs, id_col, text_col, lang_col)
    chars = (char_classes(base).groupBy("_lang")
             .agg(F.count(F.lit(1)).alias("docs"), *[F.sum(f"_c_{n}").alias(n) for n in CLASS_NAMES]))
    # one row per word; words that cannot be common share the null key, which
    # counts towards the total
    words = base.select("_lang", F.explode(split_words(F.lower("_text"))).alias("w"))
    able = (F.char_length("w") <= COMMON_CHARS) & F.col("w").rlike("^\\p{L}+$")
    counts = (words.select("_lang", F.when(able, F.col("w")).alias("w"))
              .groupBy("_lang", "w").agg(F.count(F.lit(1)).alias("n")))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("_lang", F.pmod(F.xxhash64("w"), F.lit(64))).orderBy(F.col("w").isNull(), F.desc("n"), "w")))
    # the most frequent of each of 64 hash classes, then of the language: no
    # task gets all the words of a language
    top = (ranked.groupBy("_lang")
           .agg(F.sum("n").alias("n_words"),
                F.slice(F.sort_array(F.collect_list(F.when(
                    (F.col("rank") <= COMMON) & F.col("w").isNotNull(),
                    F.struct(F.col("n").alias("n"), F.col("w").alias("w")))), asc=False), 1, COMMON).alias("common")))
    all_chars = sum((F.col(n) for n in CLASS_NAMES), F.lit(0))
    return (chars.join(top.where(F.col("n_words") >= MIN_REFERENCE_WORDS), "_lang")
            .select(F.col("_lang").alias("lang"), "docs",
                    F.array(*[F.col(n) / all_chars for n in CLASS_NAMES]).alias("classes"),
                    F.map_from_entries(F.transform("common", lambda x: F.struct(
                        x["w"].alias("w"), (x["n"] / F.col("n_words")).alias("p")))).alias("words")))


def language_references(table_: DataFrame) -> list[dict]:
    """The references every document is compared with.

    Collected to the driver: at most ``LANGUAGES`` rows of fixed size.
    """
    found = table_.orderBy(F.desc("docs"), "lang").limit(LANGUAGES).collect()
    return [{"lang": r.lang, "classes": list(r.classes), "words": dict(r.words)}
            for r in sorted(found, key=lambda r: r.lang)]


def _term(p: Column, q: Column) -> Column:
    """One bin of the Jensen-Shannon divergence."""
    def half(a, b):
        return F.when(a > 0, a / 2 * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    return half(p, q) + half(q, p)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def char_distance(references: list[dict]) -> Column:
    total = sum((F.col(f"_c_{n}") for n in CLASS_NAMES), F.lit(0)).cast("double")
    each = [_distance(sum((_term(F.col(f"_c_{n}") / total, F.lit(float(q)))
                           for n, q in zip(CLASS_NAMES, ref["classes"])), F.lit(0.0)))
            for ref in references]
    return F.when(total > 0, F.least(*each) if len(each) > 1 else each[0]).otherwise(F.lit(0.0))


def word_distance(words: str, references: list[dict]) -> Column:
    """Distance of the common-word histogram to the nearest language."""
    vocabulary = sorted({w for ref in references for w in ref["words"]})
    if not vocabulary:
        return F.lit(0.0)
    shares = F.create_map(*[x for w in vocabulary for x in
                            (F.lit(w), F.array(*[F.lit(float(ref["words"].get(w, 0.0))) for ref in references]))])
    n = F.size(words).cast("double")

    def distances(common: Column) -> Column:
        # (share in the document, shares in the references) of each common word it has
        bins = F.transform(F.array_distinct(common), lambda d: F.struct(
            ((F.size(common) - F.size(F.array_remove(common, d))) / n).alias("p"),
            F.element_at(shares, d).alias("q")))

        def to_language(b: Column, rest: Column, k: int, held: float) -> Column:
            sums = F.aggregate(b, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                               lambda a, x: F.struct((a["s"] + _term(x["p"], x["q"][k])).alias("s"),
                                                     (a["q"] + x["q"][k]).alias("q")))
            # common words the document lacks add half their share each
            return _let(sums, lambda s: _distance(s["s"] + (held - s["q"]) / 2 + _term(rest, F.lit(1.0 - held))))

        def nearest(b: Column) -> Column:
            rest = 1.0 - F.size(common) / n
            each = [to_language(b, rest, k, float(sum(ref["words"].values()))) for k, ref in enumerate(references)]
            return F.least(*each) if len(each) > 1 else each[0]
        return _let(bins, nearest)

    common = F.filter(F.col(words), lambda w: w.isin(vocabulary))
    return F.when(n > 0, _let(common, distances)).otherwise(F.lit(1.0))


def own_char_distance(classes: str) -> Column:
    """Distance to the class shares in a column; null where it is null."""
    total = sum((F.col(f"_c_{n}") for n in CLASS_NAMES), F.lit(0)).cast("double")
    terms = [_term(F.col(f"_c_{n}") / total, F.get(F.col(classes), F.lit(i))) for i, n in enumerate(CLASS_NAMES)]
    return F.when((total > 0) & F.col(classes).isNotNull(), _distance(sum(terms, F.lit(0.0))))


def own_word_distance(words: str, shares: str) -> Column:
    """Distance to the common words in a map column; null where it is null."""
    n = F.size(words).cast("double")

    def distance(common: Column) -> Column:
        bins = F.transform(F.array_distinct(common), lambda d: F.struct(
            ((F.size(common) - F.size(F.array_remove(common, d))) / n).alias("p"),
            F.element_at(F.col(shares), d).alias("q")))
        sums = F.aggregate(bins, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
                           lambda a, x: F.struct((a["s"] + _term(x["p"], x["q"])).alias("s"), (a["q"] + x["q"]).alias("q")))
        held = F.aggregate(F.map_values(F.col(shares)), F.lit(0.0), lambda a, x: a + x)
        rest = 1.0 - F.size(common) / n
        return _let(sums, lambda s: _distance(s["s"] + (held - s["q"]) / 2 + _term(rest, 1.0 - held)))

    common = F.filter(F.col(words), lambda w: F.map_contains_key(F.col(shares), w))
    return F.when((n > 0) & F.col(shares).isNotNull(), _let(common, distance))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  references: list[dict] | None = None, max_char: float = MAX_CHAR_DISTANCE,
                  max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One row per document: base counts, distances, ``base_failed`` and ``kept``."""
    more = None
    if references is None:
        known = materialize(reference_table(docs, id_col, text_col, lang_col))
        refs = language_references(known)
        if known.count() > len(refs):
            more = (known.where(~F.col("lang").isin([r["lang"] for r in refs]))
                    .select(F.col("lang").alias("_lang"), F.col("classes").alias("_classes"), F.col("words").alias("_shares")))
    else:
        refs = references
    rows = _base(docs, id_col, text_col, lang_col)
    judged = F.col("_lang").isin(["", *[r["lang"] for r in refs]]) if refs else F.lit(False)
    char = char_distance(refs) if refs else F.lit(0.0)
    word = word_distance("_lower", refs) if refs else F.lit(0.0)
    if more is not None:
        rows = rows.join(more, "_lang", "left")
        judged = judged | F.col("_classes").isNotNull()
        char = F.least(char, own_char_distance("_classes"))
        word = F.least(word, own_word_distance("_lower", "_shares"))
    rows = rows.withColumn("_words", split_words(F.col("_text")))
    rows = rows.withColumn("_lower", split_words(F.lower("_text")))
    rows = char_classes(rows)
    rows = rows.select(F.col("_id").alias("doc_id"), F.inline(F.array(F.struct(
        F.size("_words").cast("long").alias("n_words"),
        (sum((F.col(f"_c_{n}") for n in CLASS_NAMES if n != "space"), F.lit(0))).cast("long").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
        repeat_words("_words").alias("n_repeat_words"),
        char.alias("char_distance"), word.alias("word_distance"), judged.alias("judged")))))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (((F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > max_char))
           | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > max_word + WORD_NOISE / F.sqrt(F.col("n_words")))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & ~(F.col("judged") & far)).alias("kept"),
                       "char_distance", "word_distance")


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules(table(spark, sf_dir, "documents"))

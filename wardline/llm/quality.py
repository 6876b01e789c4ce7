"""Quality rules: base rules and the divergence of a text's histograms from its language's references.

Base rules (words are stretches without white space of ASCII): fewer than MIN_WORDS words, or more than half of
the words in three-word windows that occur twice or more, fail.

Divergence: every text has a histogram of character classes and one of COMMON words (each listed word, and all
others). A language's reference is the sum of the histograms of all its texts that the base rules pass. A text
goes when the Jensen-Shannon distance (base 2, 0 to 1) of its character classes is above CHARS_LIMIT, or
that of its common words above WORDS_LIMIT. Texts under GUARD_WORDS words are too short for the word
histogram and are judged by their characters alone; all are long enough for that, as MIN_WORDS holds.

All work is DataFrame functions. Null texts read as empty; a null language is a language of its own; repeated
rows are judged each alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import materialise

MIN_WORDS = 50
GUARD_WORDS = 100
CHARS_LIMIT = 0.24
WORDS_LIMIT = 0.27
# Frequent function words of four languages.
COMMON = (
    "the of and to in is that it for on with as was he be by at this are or from an have not you "
    "de la que el en y los se del las un por con no una su para es lo al "
    "le les des et est du dans qui au pour sur pas par ne ce il avec une plus "
    "der die und den von zu das mit sich ist nicht ein dem eine auf im für auch").split()
COMMON = list(dict.fromkeys(COMMON))
_SPACE = "[\\x20\\x09-\\x0D]+"
# Letters in lower case, in upper case, other letters and marks, digits, white space, sentence marks.
CLASSES = ["\\p{Ll}", "\\p{Lu}", "\\p{L}\\p{M}", "\\p{N}", "\\x20\\x09-\\x0D", ".,;:!?'\"()\\-"]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def described(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, lang, the base counts and the two histograms of every row, and its columns named in carry."""
    extra = [c for c in carry if c != "lang"]
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    split = split.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    n = F.size("words")
    # A window's hash over its place: equal windows are neighbours once sorted. The place takes as many bits as
    # the number of words needs, the hash the rest.
    shift = F.ceil(F.log2(n + F.lit(2))).cast("int")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function(
        "shiftleft", F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]), F.col("bits"))
        .bitwiseOR(i.cast("long")))).otherwise(F.array().cast("array<long>"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    found = F.filter("words", lambda w: w.isin(COMMON))
    places = F.transform(found, lambda w: F.array_position(F.array(*map(F.lit, COMMON)), w).cast("int"))
    counted = (split.withColumn("bits", shift).withColumn("lines", lines).withColumn("places", places)
               .withColumn("windows", F.sort_array(windows)))

    def key(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col("bits"))

    last = F.size("windows") - 1
    # Places of windows that equal the one before or after them in the sorted order.
    repeated = F.filter("windows", lambda x, i: (
        (i > 0) & (key(x) == key(F.get("windows", i - 1)))) | ((i < last) & (key(x) == key(F.get("windows", i + 1)))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    counted = counted.withColumn("repeated", F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(mask))))
    covered = F.aggregate(
        "repeated", F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3).cast("long"), p - a["at"])).alias("n")),
        lambda a: a["n"])

    def chars(kind: str) -> Column:
        return F.length(F.regexp_replace("text", f"[^{kind}]+", ""))

    classes = [chars(k) for k in CLASSES]
    classes[2] = F.length(F.regexp_replace("text", "[^\\p{L}\\p{M}]+", "")) - classes[0] - classes[1]
    return counted.select(
        "doc_id", "lang",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in classes], F.length("text").cast("long")).alias("classes"),
        F.array(*[(F.size("places") - F.size(F.array_remove("places", i + 1))).cast("long") for i in range(len(COMMON))],
                n.cast("long")).alias("common"),
        *extra,
    ).withColumn("classes", _with_rest("classes")).withColumn("common", _with_rest("common"))


def _with_rest(name: str) -> Column:
    """The last entry, a total, becomes what the others leave of it."""
    size = F.size(name)
    parts = F.slice(F.col(name), F.lit(1), size - 1)
    rest = F.element_at(name, -1) - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.array_append(parts, F.greatest(rest, F.lit(0).cast("long")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0.0 if either is empty."""

    def shares(h: Column) -> Column:
        total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x.cast("double"))
        return _let(total, lambda t: F.transform(h, lambda x: x / F.greatest(t, F.lit(1e-300))))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / ((a + b) / 2))).otherwise(0.0)

    each = F.zip_with(shares(p), shares(q), lambda a, b: (term(a, b) + term(b, a)) / 2)
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    some = F.exists(p, lambda x: x > 0) & F.exists(q, lambda x: x > 0)
    return F.when(some, F.sqrt(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))).otherwise(0.0)


def references(facts: DataFrame) -> DataFrame:
    """lang, ref_classes, ref_common: sums over the language's texts that the base rules pass."""
    n_classes, n_common = len(CLASSES) + 1, len(COMMON) + 1
    sums = (facts.filter(~F.col("base_failed")).groupBy("lang").agg(
        *[F.sum(F.col("classes")[i]).alias(f"a{i}") for i in range(n_classes)],
        *[F.sum(F.col("common")[i]).alias(f"b{i}") for i in range(n_common)]))
    return sums.select(F.col("lang").alias("ref_lang"), F.array(*[f"a{i}" for i in range(n_classes)]).alias("ref_classes"),
                       F.array(*[f"b{i}" for i in range(n_common)]).alias("ref_common"))


def judge(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the distances, and
    the row's columns named in carry."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    facts = materialise(described(docs, carry).withColumn("base_failed", base), "quality")
    joined = facts.join(references(facts), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    judged = (joined.withColumn("chars_distance", F.coalesce(distance(F.col("classes"), F.col("ref_classes")), F.lit(0.0)))
              .withColumn("words_distance", F.coalesce(distance(F.col("common"), F.col("ref_common")), F.lit(0.0))))
    far = (F.col("chars_distance") > CHARS_LIMIT) | (
        (F.col("n_words") >= GUARD_WORDS) & (F.col("words_distance") > WORDS_LIMIT))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
                         "chars_distance", "words_distance", *carry)

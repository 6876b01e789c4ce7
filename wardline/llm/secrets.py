"""Secret scans: three base patterns, and random-looking tokens by two character Markov models.

Base kinds, leftmost non-overlapping matches each: assign (a key word, `:` or `=`, a value of 8 or more), access
(AKIA and 12 or more of A-Z0-9), hex (32 or more of 0-9a-f).

The method adds kind markov: stretches of TOKEN_CHARS or more from [A-Za-z0-9+/_=-], between what else the text
holds and the base spans (which are cut out of a token; what is left of it on either side is scored), whose log-likelihood ratio between the model of random strings and the model of ordinary identifiers is at
least MIN_RATIO. Both are first-order chains over the alphabet with a boundary state, add-one smoothed.
They are trained from labelled samples: random are the values of base matches and renderings (hex, base64,
upper-case) of digests of sampled texts; ordinary are the tokens of sampled texts outside base matches and
their words joined to identifiers. The sample is about SAMPLE_DOCS documents chosen by a hash of the id; what
reaches the driver is one count per label and pair of characters.

Spans are code points, end exclusive, ordered by start, kind, end. Null texts read as empty; an untrained model
(empty table) adds nothing; repeated rows are scanned each. All work is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# With a greedy class, a minimum in the pattern finds what a filter on maximal runs would keep.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8
TOKEN_CHARS = 12
TOKEN = f"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{TOKEN_CHARS},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0 is the boundary
SAMPLE_DOCS = 20_000
MIN_RATIO = 12.0
MASK = "[SECRET]"
_SPANS = "array<struct<start:int,kind:int,end:int>>"
_KEYS = ["password", "passwd", "secret", "token", "api"]


def _numbers(values: list, kind: str) -> Column:
    """A constant array; given as text so that the plan holds one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _states(token: Column) -> Column:
    """The alphabet numbers of a token's characters."""
    of_code = [0] * 128
    for i, c in enumerate(ALPHABET):
        of_code[ord(c)] = i + 1
    return F.transform(F.split(token, ""), lambda c: F.get(_numbers(of_code, "int"), F.ascii(c)))


def _found(text: Column, pattern: str, kind: int, value: int = 0, least: int = 0, extra=None) -> Column:
    """Spans of the pattern's matches, with the text between matches giving the positions."""
    pattern = F.lit(pattern)
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                        F.regexp_extract_all(text, pattern, F.lit(value)).alias("value"))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPANS).alias("spans"))

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        good = F.length(x["value"]) >= least
        if extra:
            good = good & extra(x["hit"])
        return F.when(x["hit"].isNull(), a).otherwise(F.struct(
            end.alias("pos"), F.when(good, F.array_append(a["spans"], F.struct(
                start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).otherwise(a["spans"]).alias("spans")))

    return F.aggregate(rows, zero, step, lambda a: a["spans"])


def base_spans(text: Column) -> Column:
    none = F.array().cast(_SPANS)
    lower = F.lower(text)
    asks = lower.contains(_KEYS[0])
    for k in _KEYS[1:]:
        asks = asks | lower.contains(k)
    return F.concat(F.when(asks, _found(text, ASSIGN, 0, 2, ASSIGN_VALUE)).otherwise(none),
                    F.when(text.contains("AKIA"), _found(text, ACCESS, 1)).otherwise(none), _found(text, HEX, 2))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of every span, so that places stay the same."""

    def step(a: Column, s: Column) -> Column:
        start = F.greatest(a["pos"], s["start"])
        gap = F.substr(text, a["pos"] + 1, start - a["pos"])
        return F.when(s["end"] > a["pos"], F.struct(s["end"].alias("pos"), F.concat(
            a["out"], gap, F.repeat(F.lit(" "), s["end"] - start)).alias("out"))).otherwise(a)

    masked = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                         lambda a: F.concat(a["out"], F.substr(text, a["pos"] + 1, F.length(text) - a["pos"])))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def count_pairs(samples: DataFrame) -> DataFrame:
    """label, pair, n: how often each pair of states follows in the tokens of a label.

    samples: token, label (1 random, 0 ordinary).
    """
    states = F.concat(F.array(F.lit(0)), _states(F.col("token")), F.array(F.lit(0)))
    return (samples.filter(F.length("token") > 0).select("label", states.alias("s"))
            .select("label", F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i:
                    F.col("s")[i] * STATES + F.col("s")[i + 1])).alias("pair"))
            .groupBy("label", "pair").agg(F.count("*").alias("n")))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of states; empty without samples of both labels."""
    n = {(r["label"], r["pair"]): r["n"] for r in count_pairs(samples).collect()}  # at most 2 x STATES ** 2 rows
    if {label for label, _ in n} != {0, 1}:
        return []
    total = {(y, s): sum(n.get((y, s * STATES + t), 0) for t in range(STATES)) for y in (0, 1) for s in range(STATES)}

    def log_p(y: int, pair: int) -> float:
        return math.log((n.get((y, pair), 0) + 1) / (total[y, pair // STATES] + STATES))

    return [round(log_p(1, p) - log_p(0, p), 6) for p in range(STATES * STATES)]


def labelled_samples(docs: DataFrame) -> DataFrame:
    """token, label from about SAMPLE_DOCS documents."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    part = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    digest = F.sha2("text", 256)
    rendered = F.array(digest, F.base64(F.unhex(digest)), F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 256))), "[+/=]", ""),
                       F.upper(F.regexp_replace(F.base64(F.unhex(F.sha2(digest, 512))), "[+/=]", "")))
    values = [F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))]
    # One of a base match or rendering, stripped of what the alphabet lacks.
    random = part.select(F.explode(F.concat(rendered, *values)).alias("token"), F.lit(1).alias("label"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(plain, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))
    ordinary = (part.select(words.alias("words"))
                .select(F.explode(F.array_append("words", F.array_join(F.slice("words", 1, 4), "_"))).alias("token"),
                        F.lit(0).alias("label")))
    return random.union(ordinary).withColumn("token", F.regexp_replace("token", "[^A-Za-z0-9+/_=-]", ""))


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token: above 0 it is likelier a random string."""
    weights = _numbers(table, "double")
    end = F.aggregate(
        _states(token), F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum")),
        lambda a, s: F.struct(s.alias("at"), (a["sum"] + F.get(weights, a["at"] * STATES + s)).alias("sum")))
    return end["sum"] + F.get(weights, end["at"] * STATES)


def scan(docs: DataFrame, table: list[float], text: str = "text", name: str = "spans") -> DataFrame:
    """docs with a column of all spans: array of (start, kind, end), kind an index of KINDS."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    based = docs.withColumn(name, base_spans(whole))
    if table:
        rest = f"{name}_rest"
        free = _found(F.col(rest), TOKEN, 3, extra=lambda hit: ratio(hit, table) >= MIN_RATIO)
        based = based.withColumn(rest, _blanked(whole, F.col(name))).withColumn(name, F.concat(name, free)).drop(rest)
    return based.withColumn(name, F.array_sort(name))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(F.array(*map(F.lit, KINDS)), s["kind"]), s["start"], s["end"])), ",")


def digests(scanned: DataFrame) -> DataFrame:
    def of(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"))


def redact(scanned: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """Every span of the text replaced by MASK (overlapping ones by one), the spans dropped."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def step(a: Column, s: Column) -> Column:
        gap = F.substr(whole, a["pos"] + 1, s["start"] - a["pos"])
        return F.when(s["start"] >= a["pos"], F.struct(
            s["end"].alias("pos"), F.concat(a["out"], gap, F.lit(MASK)).alias("out"))).otherwise(
            F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), a["out"].alias("out")))

    masked = F.aggregate(name, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                         lambda a: F.concat(a["out"], F.substr(whole, a["pos"] + 1, F.length(whole) - a["pos"])))
    return scanned.withColumn(text, F.when(F.size(name) > 0, masked).otherwise(F.col(text))).drop(name)

"""Phrase collocations from one count of longest windows, marginalised with ROLLUP.

1. Windows: every word position gives one window of ORDER words, the word and the ORDER - 1 that follow it in its
   piece as lead columns, padded with nothing where the piece ends. A task sums equal windows of a bounded
   stretch of text before anything is shuffled, and sends those of a bucket of leading pairs as one text in which
   first and second words stand once, a third of the size of a row per window.
2. Windows meet by the bucket of their leading pair, so a frequent first word is spread over its pairs. There a window is
   cut back to its longest prefix found MIN_COUNT times (the first word stays): its count stays in every prefix
   that can matter, and most rows fold together.
3. ROLLUP over (lang, w1, ..., w4) sums successively shorter prefixes: every occurrence of a phrase begins at
   one position, so a prefix sum is the phrase's frequency, and the sum over a language its number of words.
4. Cuts, containment and ranks are joins and group limits over the frequent phrases alone.

Words are split as the contract says: A-Z lower-cased, pieces at . , ; : ! ? and the characters x0A to x0D, words at spaces and
tabs. A null text is empty, a null language `und`. Scores are computed in decimals of 38 digits, exact up
to counts of 10**19. Repeated rows count as often as they occur. A language without candidates has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import bounded_batches, mix, pieces
from wardline.session import materialise

ORDER, MIN_COUNT, TOP = 4, 30, 2000
INSIDE = 80  # percent of a phrase's occurrences that a longer one must hold to replace it
FACTOR = 2_000_000
CHUNK_BYTES = 8 << 20
BUCKETS = 4  # of leading pairs, for each shuffle partition
HELD_BYTES, HELD_ROWS = 16 << 20, 1_500_000
_BREAKS = r"[.,;:!?\n\x0b\f\r]"
_W = [f"w{i + 1}" for i in range(ORDER)]
_DECIMAL = "decimal(38,0)"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, each word's piece, each word's text)."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _BREAKS)
    text_of_piece = pc.list_parent_indices(split).to_numpy()
    found = pc.ascii_split_whitespace(pc.list_flatten(split))
    words, piece = pc.list_flatten(found), pc.list_parent_indices(found)
    full = pc.greater(pc.binary_length(words), 0)
    piece = np.asarray(piece.filter(full))
    return words.filter(full), piece, text_of_piece[piece]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new group of equal keys begins, in rows sorted by them."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _folded(parts: pa.Array, starts: np.ndarray, by: str) -> pa.Array:
    """The parts of each group joined."""
    offsets = pa.array(np.append(starts, len(parts)), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, parts), by)


def count_windows(texts: pa.Array, langs: pa.Array, buckets: int) -> pa.Table:
    """lang, bucket, windows: the summed windows of one stretch of texts, those of a bucket of leading pairs in one text.

    It lists first words by line feeds; each is followed by its second words after tabs, each of these by its tails
    (third and fourth word) after \\v, and a tail by \\r and its count where that is not 1. Words hold none of these.
    """
    words, piece, text = _words(texts)
    coded = words.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    by_word = pc.sort_indices(coded.dictionary)
    rank[by_word.to_numpy()] = np.arange(1, len(rank) + 1)
    code = rank[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
    sorted_words = coded.dictionary.take(by_word)
    lead = [code]
    for i in range(1, ORDER):
        follows = np.zeros(len(code), np.int64)  # 0: the piece has ended
        same = piece[i:] == piece[:-i]
        follows[:max(0, len(code) - i)] = np.where(same, code[i:], 0)
        lead.append(follows)
    lang = langs.dictionary_encode()
    of_lang = lang.indices.to_numpy()[text].astype(np.int64)
    hashed = np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in sorted_words.cast(pa.binary()).to_pylist())], np.uint64)
    with np.errstate(over="ignore"):
        bucket = (mix(hashed[lead[0]] * np.uint64(3) + hashed[lead[1]]) % np.uint64(buckets)).astype(np.int64)

    base = np.int64(len(rank) + 1)
    # language and bucket, leading pair, tail; two words fit a long for up to 2**31 different words in a stretch
    keys = [lead[2] * base + lead[3], lead[0] * base + lead[1], of_lang * buckets + bucket]
    order = np.lexsort(keys)
    tail, pair, part = (k[order] for k in keys)
    new = _starts(part, pair, tail)
    n = np.diff(np.append(new, len(order)))
    at, pair, part = order[new], pair[new], part[new]

    def named(codes: np.ndarray) -> pa.Array:
        return sorted_words.take(pa.array(codes - 1, mask=codes == 0))

    third, fourth = named(lead[2][at]), named(lead[3][at])
    tails = pc.coalesce(pc.binary_join_element_wise(third, fourth, " "), third, pa.scalar(""))
    several = pa.array(n, mask=n == 1).cast(pa.string())
    tails = pc.coalesce(pc.binary_join_element_wise(tails, several, "\r"), tails)
    pairs = _starts(part, pair)
    seconds = pc.binary_join_element_wise(pc.fill_null(named(lead[1][at[pairs]]), ""), _folded(tails, pairs, "\v"), "\v")
    first = lead[0][at[pairs]]
    firsts = _starts(part[pairs], first)
    lines = pc.binary_join_element_wise(named(first[firsts]), _folded(seconds, firsts, "\t"), "\t")
    parts = _starts(part[pairs][firsts])
    key = part[pairs][firsts][parts]
    return pa.table([lang.dictionary.take(pa.array(key // buckets)), pa.array(key % buckets, pa.int32()), _folded(lines, parts, "\n")],
                    names=["lang", "bucket", "windows"])


def windows(docs: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, windows: padded longest windows, summed within stretches of CHUNK_BYTES of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> list[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            found = count_windows(table["text"].combine_chunks(), table["lang"].combine_chunks(), buckets)
            return found.to_batches(max_chunksize=max(1, found.num_rows * (4 << 20) // max(1, found.nbytes)))

        for part in pieces(batches):
            if held and size + part.nbytes > CHUNK_BYTES:
                yield from counted()
                held, size = [], 0
            held.append(part)
            size += part.nbytes
        if held:
            yield from counted()

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, "lang string, bucket int, windows string")


def _split(lines: pa.Array, by: str) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(what stands before the first mark, the parts after it, the line of each part)."""
    found = pc.split_pattern(lines, by)
    offsets, parts = found.offsets.to_numpy(), found.flatten()
    first = np.zeros(len(parts), bool)
    first[offsets[:-1] - offsets[0]] = True
    line = np.repeat(np.arange(len(lines)), np.diff(offsets) - 1)
    return parts.filter(pa.array(first)), parts.filter(pa.array(~first)), line


def unfold(folded: pa.Array) -> pa.Table:
    """w1, w2, tail, n of every window; w2 and tail are empty where the piece had ended."""
    lines = pc.split_pattern(folded, "\n").flatten()
    w1, seconds, line = _split(lines, "\t")
    w2, tails, second = _split(seconds, "\v")
    counted = pc.split_pattern(tails, "\r", max_splits=1)
    several = np.diff(counted.offsets.to_numpy()) == 2
    parts, at = counted.flatten(), counted.offsets.to_numpy()[:-1] - counted.offsets.to_numpy()[0]
    n = np.ones(len(tails), np.int64)
    n[several] = parts.take(pa.array(at[several] + 1)).cast(pa.int64()).to_numpy()
    return pa.table([w1.take(pa.array(line[second])), w2.take(pa.array(second)), parts.take(pa.array(at)), pa.array(n)],
                    names=["w1", "w2", "tail", "n"])


def _where(column: pa.Array, stands: np.ndarray) -> pa.Array:
    """The column with nulls where a row doesn't stand."""
    return column.take(pa.array(np.arange(len(column)), mask=~stands))


def _summed(table: pa.Table) -> pa.Table:
    return table.group_by(["w1", "w2", "tail"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).combine_chunks()


def _cut(table: pa.Table, min_count: int) -> pa.Table:
    """Summed windows of whole leading pairs, each cut back to its longest prefix found min_count times."""
    def code(*columns: np.ndarray) -> np.ndarray:
        out = columns[0]
        for c in columns[1:]:
            out = np.unique(out * (c.max(initial=0) + 1) + c, return_inverse=True)[1]
        return out

    def codes(column: pa.Array) -> np.ndarray:
        return column.dictionary_encode().indices.to_numpy().astype(np.int64)

    w1, w2, tail = (table[c].combine_chunks() for c in ("w1", "w2", "tail"))
    n = table["n"].to_numpy()
    third, fourth, has = _split(tail, " ")
    last = np.zeros(len(n), np.int64)
    last[has] = np.arange(1, len(fourth) + 1)
    pair = code(codes(w1), codes(w2))
    of_pair = np.bincount(pair, weights=n)[pair] if len(n) else n
    three = code(pair, codes(third))
    of_three = np.bincount(three, weights=n)[three] if len(n) else n
    two_stand, three_stand, four_stand = of_pair >= min_count, of_three >= min_count, n >= min_count

    def kept(column: pa.Array, stands: np.ndarray) -> pa.Array:
        return _where(column, stands).fill_null("")

    full = fourth.take(pa.array(last - 1, mask=last == 0)).fill_null("")
    cut = pa.table([w1, kept(w2, two_stand), kept(third, two_stand & three_stand), kept(full, two_stand & three_stand & four_stand),
                    table["n"]], names=[*_W, "n"])
    return cut.group_by(_W).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def _met(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """lang, w1 ... w4, n from folded windows sorted by (bucket, language). Leading pairs are whole in a bucket.

    A task holds HELD_BYTES of folded text or HELD_ROWS different windows. A bucket with more hands its windows on as
    they are; the sums downstream are the same."""
    def given(lang: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        words = [table[w].combine_chunks() for w in _W]
        words = [_where(w, np.asarray(pc.binary_length(w)) > 0) for w in words]
        lang_column = pa.repeat(pa.scalar(lang, pa.string()), table.num_rows)
        out = pa.table([lang_column, *words, table["n"]], names=["lang", *_W, "n"])
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)

    def whole(table: pa.Table) -> pa.Table:
        third, fourth, has = _split(table["tail"].combine_chunks(), " ")
        last = np.zeros(table.num_rows, np.int64)
        last[has] = np.arange(1, len(fourth) + 1)
        return pa.table([table["w1"], table["w2"], third, fourth.take(pa.array(last - 1, mask=last == 0)).fill_null(""), table["n"]],
                        names=[*_W, "n"])

    key, held, size, summed, over = None, [], 0, None, False

    def compact() -> pa.Table:
        tables = ([summed] if summed is not None else []) + ([unfold(pa.concat_arrays(held))] if held else [])
        return _summed(pa.concat_tables(tables))

    for batch in batches:
        for i in range(batch.num_rows):
            of = (batch["bucket"][i].as_py(), batch["lang"][i].as_py())
            if of != key:
                if held or summed is not None:
                    yield from given(key[1], whole(compact()) if over else _cut(compact(), min_count))
                key, held, size, summed, over = of, [], 0, None, False
            part = batch["windows"].slice(i, 1)
            if held and size + part.nbytes > HELD_BYTES:
                summed, held, size = compact(), [], 0
                if summed.num_rows > HELD_ROWS:
                    yield from given(key[1], whole(summed))
                    summed, over = None, True
            held.append(part)
            size += part.nbytes
    if held or summed is not None:
        yield from given(key[1], whole(compact()) if over else _cut(compact(), min_count))


def frequent_prefixes(docs: DataFrame, min_count: int) -> DataFrame:
    """lang, w1 ... w4, n: the windows, cut back to their longest prefix found min_count times (at least one word), summed."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = windows(docs, BUCKETS * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "lang")
    schema = "lang string, " + ", ".join(f"{w} string" for w in _W) + ", n long"
    return (dealt.select("bucket", "lang", "windows").mapInArrow(lambda batches: _met(batches, min_count), schema)
            .groupBy("lang", *_W).agg(F.sum("n").alias("n")))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f of every phrase of 1 to ORDER words found min_count times; lang, n)."""
    bounded_batches(docs.sparkSession)
    prefixes = frequent_prefixes(docs, min_count)
    rolled = materialise(prefixes.rollup("lang", *_W).agg(F.sum("n").alias("f"), F.grouping_id().alias("level")), "rolled")
    size = F.lit(None).cast("int")
    for i in range(ORDER + 1):  # grouping_id has a bit for each column summed over
        size = F.when(F.col("level") == (1 << (ORDER - i)) - 1, i).otherwise(size)
    sized = rolled.withColumn("size", size)
    whole = F.element_at(F.array(*_W), F.col("size")).isNotNull()  # else the window had ended or was cut before
    phrases = sized.filter("size > 0").filter(whole & (F.col("f") >= min_count)).select(
        "lang", F.slice(F.array(*_W), F.lit(1), F.col("size")).alias("words"), "f")
    return (phrases.withColumn("phrase", F.array_join("words", " ")),
            sized.filter("size = 0").select("lang", F.col("f").alias("n")))


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    found, totals = phrase_counts(docs, min_count)
    return best_phrases(materialise(found, "phrases"), totals, top, inside)


def best_phrases(found: DataFrame, totals: DataFrame, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The ranks, from the frequencies (lang, words, phrase, f) of all frequent phrases and the words (lang, n)."""
    size = F.size("words")
    candidates = found.filter(size >= 2)

    k = F.col("k")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), k).alias("left"), _part(k + 1, size - k).alias("right"))
    left, right = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    score = F.expr(f"cast(a as {_DECIMAL}) * {FACTOR} div (cast(l as {_DECIMAL}) + r)")
    lowest = (cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))

    longer = found.filter(size >= 3)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda at: F.struct(at.alias("at"), n.alias("n")))))
    holds = (longer.select("lang", "f", "words", F.explode(spans).alias("span"))
             .select("lang", "f", _part(F.col("span.at"), F.col("span.n")).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("most")))
    replaced = F.col("most").cast(_DECIMAL) * 100 >= F.col("a").cast(_DECIMAL) * inside
    own = lowest.join(holds, ["lang", "phrase"], "left").filter(F.col("most").isNull() | ~replaced)

    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").cast("long").alias("score"))


def oracle_sql() -> str:
    def grams(n: int) -> str:
        lists = ", ".join(["w", *(f"w[{i + 1}:]" for i in range(1, n))])
        return (f"SELECT lang, array_to_string(g, ' ') AS phrase, {n} AS size, count(*) AS f FROM (SELECT lang, "
                f"unnest(list_transform(list_zip({lists})[:len(w) - {n - 1}], lambda t: [{', '.join(f't[{i + 1}]' for i in range(n))}])) AS g "
                f"FROM pieces WHERE len(w) >= {n}) GROUP BY ALL")

    return f"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS ({' UNION ALL '.join(grams(n) for n in range(1, ORDER + 1))}),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2 AND f >= {MIN_COUNT}),
cuts AS (SELECT *, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, CAST({FACTOR} AS HUGEINT) * a // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, w, size, s, unnest(range(2, size)) AS m FROM (SELECT *, unnest(range(1, size)) AS s FROM c WHERE size >= 3)),
holds AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS most FROM spans WHERE s + m - 1 <= size GROUP BY ALL),
own AS (SELECT lowest.* FROM lowest LEFT JOIN holds USING (lang, phrase)
  WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST({INSIDE} AS HUGEINT) * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""

"""Hard negatives by a secondary-sort shuffle.

Each anchor's positives are its best rows of the same label; for each of them the hard negatives are the first rows of other
labels whose score lies between LOW and 100 percent of the positive's. All scores are integer inner products.

1. Positives: anchors meet all rows in bounded blocks; each task keeps the first few of the same label per anchor, and a
   group limit merges them.
2. Negatives: the same blocks, with the positives known. A row can only be among the first few of a window
   if it is so within its task, so each task emits at most that many per window and no other pair leaves it.
3. Positives and negatives get keys (anchor, descending score, kind, id, row) and go through
   repartitionAndSortWithinPartitions. A streaming iterator reads them in order: a positive opens its window, a
   negative is emitted to every open window that has room, and a window closes when it is full or the scores fall below it. It
   holds the open windows of one anchor, never its rows.

Rows with a null label or vector, or any null or non-finite component, take no part. Equal scores go by smaller id,
rows without an id last. A row is told from others by its place in the table, so rows that share an id count
apart, and a repeated anchor gets its answers again. Vectors of different lengths are compared as if the shorter
ones ended in zeros. A component beyond +-2**31 counts as +-2**31.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import blocks
from wardline.llm.common import bounded_batches
from wardline.session import materialise

SCALE, EVERY, SHIFTED, LABELS = 256, 100, 7, 10
POSITIVES, NEGATIVES, LOW = 5, 5, 80
_FOUND = "anchor long, score long, missing boolean, id long, row long"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class _Anchors:
    """The anchors of one pair, gathered from their batches."""

    def __init__(self):
        self.parts, self.ready = [], False

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def gather(self) -> bool:
        """True if there are anchors."""
        if not self.ready and self.parts:
            table = pa.Table.from_batches(self.parts)
            self.row, self.label = (blocks.integers(table[c].combine_chunks()) for c in ("row", "label"))
            self.v, self.ready, self.parts = blocks.matrix(table["v"]), True, []
            if "positives" in table.column_names:  # scores, filled up to POSITIVES with none
                lists = table["positives"].to_pylist()
                self.marks = np.full((len(lists), POSITIVES), blocks.LEAST)
                for i, held in enumerate(lists):
                    self.marks[i, :len(held)] = held
        return self.ready


def _columns(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(part["vec_id"].is_null()), blocks.integers(part["vec_id"]), blocks.integers(part["row"])


def _batches(anchors: _Anchors, best: blocks.Best) -> Iterator[pa.RecordBatch]:
    owner, score, missing, ids, row = best.rows
    table = pa.table([pa.array(anchors.row[owner]), pa.array(score), pa.array(missing.astype(bool)), pa.array(ids), pa.array(row)],
                     names=["anchor", "score", "missing", "id", "row"])
    yield from table.to_batches(max_chunksize=50_000)


def _same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor's first POSITIVES rows of its label within one stripe."""
    at, anchors, best = None, None, None
    for pair, is_row, part in blocks.runs(batches):
        if pair != at:
            if best:
                yield from _batches(anchors, best)
            at, anchors, best = pair, _Anchors(), None
        if not is_row:
            anchors.add(part)
            continue
        if not anchors.gather():
            continue
        best = best or blocks.Best(len(anchors.row), POSITIVES)
        for some in blocks.steps(len(anchors.row), part):
            missing, ids, row = _columns(some)
            open_ = (anchors.label[:, None] == blocks.integers(some["label"])) & (anchors.row[:, None] != row)
            best.add(blocks.products(anchors.v, blocks.matrix(some["v"])), open_, missing, ids, row)
    if best:
        yield from _batches(anchors, best)


def _in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every positive of each anchor, the first NEGATIVES rows of other labels in its window within one stripe."""
    at, anchors, best = None, None, []
    for pair, is_row, part in blocks.runs(batches):
        if pair != at:
            for b in best:
                yield from _batches(anchors, b)
            at, anchors, best = pair, _Anchors(), []
        if not is_row:
            anchors.add(part)
            continue
        if not anchors.gather():
            continue
        best = best or [blocks.Best(len(anchors.row), NEGATIVES) for _ in range(POSITIVES)]
        for some in blocks.steps(len(anchors.row), part):
            missing, ids, row = _columns(some)
            score = blocks.products(anchors.v, blocks.matrix(some["v"]))
            other = anchors.label[:, None] != blocks.integers(some["label"])
            for j, b in enumerate(best):
                mark = anchors.marks[:, j, None]
                b.add(score, other & (score <= mark) & (score >= _floor_of(mark)), missing, ids, row)
    for b in best:
        yield from _batches(anchors, b)


def _floor_of(positive: np.ndarray) -> np.ndarray:
    """The least integer n with LOW * positive <= 100 * n, without passing 64 bits."""
    whole, rest = positive // 100, positive % 100
    return LOW * whole + -(-LOW * rest // 100)


def _spread(key: tuple) -> int:
    """A partition number from the anchor alone."""
    return key[0] * 0x9E3779B97F4A7C15 % (1 << 64) >> 33


def _mined(items: Iterator[tuple[tuple, int]]) -> Iterator[tuple]:
    """items in the order of their keys (anchor, -score, kind, missing, id, row); value: the anchor's id."""
    anchor, windows = None, []
    for (of, minus, kind, missing, id_, _), anchor_id in items:
        if of != anchor:
            anchor, windows = of, []
        score, own = -minus, None if missing else id_
        if kind == 0:
            windows.append([score, own, 0])
            continue
        still = []
        for window in windows:
            if LOW * window[0] > 100 * score:
                continue  # all later scores are lower
            window[2] += 1
            yield anchor_id, window[1], window[2], own, window[0], score
            if window[2] < NEGATIVES:
                still.append(window)
        windows = still


def mine(vectors: DataFrame, block_asked: int = blocks.BLOCK_ASKED) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label and any other columns.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    rows = materialise(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), shifted.alias("label"),
        blocks.integer_vector(F.col("embedding"), SCALE).alias("v")).filter("v IS NOT NULL AND label IS NOT NULL")
        .withColumn("row", F.monotonically_increasing_id()), "labelled")
    anchors = rows.filter(F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)))
    columns = ["pair", "is_row", "row", "vec_id", "label", "v"]

    met = blocks.beside_all(anchors, rows, "row", block_asked).select(columns)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "missing", "id", "row")
    positives = materialise(met.mapInArrow(_same_label, _FOUND).withColumn("_n", F.row_number().over(first))
                            .filter(F.col("_n") <= POSITIVES).drop("_n"), "positives")
    marks = positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("score").alias("positives"))
    met = blocks.beside_all(anchors.join(marks, "row"), rows, "row", block_asked).select(*columns, "positives")
    negatives = met.mapInArrow(_in_windows, _FOUND).distinct()  # one row may be in several windows

    both = positives.withColumn("kind", F.lit(0)).unionByName(negatives.withColumn("kind", F.lit(1)))
    named = both.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    keyed = named.select("anchor", "score", "kind", "missing", "id", "row", "anchor_id").rdd.map(
        lambda r: ((r[0], -r[1], r[2], r[3], r[4], r[5]), r[6]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, _spread)
    return spark.createDataFrame(ordered.mapPartitions(_mined), _MINED)


def oracle_sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, c.row, CAST(list_inner_product(a.e, c.e) AS HUGEINT) AS score
  FROM v a JOIN v c ON a.row <> c.row WHERE a.vec_id % {EVERY} = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= {POSITIVES}),
w AS (SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
  FROM p JOIN s n ON p.anchor = n.anchor AND NOT n.same AND {LOW} * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score,
  CAST(negative_score AS BIGINT) AS negative_score FROM w WHERE rank <= {NEGATIVES}"""

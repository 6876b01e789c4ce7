"""Exact top-k by inner product with vector-approximation files.

Every different vector is one class with its k + 1 smallest ids; more equal rows can't be among anybody's first
k. A class is approximated by one cell of BITS bits per dimension (equal widths between the least and the
largest value), a small fraction of the exact vector. Then, in Spark:

1. Bounds: every asked vector is scored against the middle of every cell in bounded blocks. The true
   product differs from it by at most half the cell widths weighted by the asked vector's components, so middle
   plus and minus that slack bound it. A task keeps what may still reach its k-th best lower bound; the k-th best
   lower bound over all tasks then thins these candidates again.
2. Reading: each asked vector's candidates are read (joined with the exact vectors) in the order of their
   bound, FIRST * (k + 1) at once; the k-th best exact score found says which of the rest could still
   enter, and exactly these are read too. What is not read is certain to lie below.

Everything is integer arithmetic. Equal scores go by smaller id, rows without an id last. An asked row is no candidate of its own, but
another row with the same id is one. Rows whose vector is null, or holds a null or non-finite component, take
no part. Vectors of different lengths are compared as if the shorter ones ended in zeros; an empty vector scores
0. Repeated asked rows get one answer each. A component beyond +-2**31 counts as +-2**31.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import blocks
from wardline.llm.common import bounded_batches
from wardline.session import materialise

SCALE, K, EVERY = 64, 20, 20
BITS = 6
FIRST = 2
HELD = 2_000_000  # candidates a task holds before it hands them on
_EXTENT = "dim int, lo long, hi long"


def _by_id(*before: Column) -> list[Column]:
    return [*before, F.col("vec_id").asc_nulls_last()]


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """class, v, ids (the k + 1 smallest, as structs), asked: one row per different vector."""
    first = Window.partitionBy("v").orderBy(*_by_id())
    thin = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    ids = thin.groupBy("v").agg(F.collect_list(F.struct("vec_id")).alias("ids"))
    wanted = rows.filter("asked").select("v", F.lit(True).alias("asked")).distinct()
    return materialise(ids.join(wanted, "v", "left").select(
        F.monotonically_increasing_id().alias("class"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "classes")


def grid_of(classes: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(least value, cell width) of every dimension; the driver gets two numbers per dimension."""
    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = blocks.matrix(batch.column(0), len(lo))
            lo, hi = (np.pad(x, (0, m.shape[1] - len(x))) for x in (lo, hi))
            lo, hi = np.minimum(lo, m.min(axis=0)), np.maximum(hi, m.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(lo)), pa.int32()), pa.array(lo), pa.array(hi)], ["dim", "lo", "hi"])

    found = (classes.select("v").mapInArrow(extent, _EXTENT).groupBy("dim")
             .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").collect())
    lo = np.array([r["lo"] for r in found], np.int64)
    return lo, np.array([-(-(r["hi"] - r["lo"] + 1) // (1 << bits)) for r in found], np.int64)


def approximate(classes: DataFrame, lo: np.ndarray, width: np.ndarray, bits: int) -> DataFrame:
    """class, cells: the approximation file, BITS bits per dimension."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = blocks.matrix(batch["v"], len(lo))
            cell = ((m - lo) // np.maximum(width, 1)).astype(np.uint32)
            bit = (cell[:, :, None] >> np.arange(bits, dtype=np.uint32)) & 1
            packed = np.packbits(bit.reshape(len(m), -1).astype(np.uint8), axis=1)
            yield pa.RecordBatch.from_arrays([batch["class"], pa.array([p.tobytes() for p in packed], pa.binary())], ["class", "cells"])

    return materialise(classes.select("class", "v").mapInArrow(encode, "class long, cells binary"), "cells")


def _doubled_middles(cells: pa.Array, lo: np.ndarray, width: np.ndarray, bits: int) -> np.ndarray:
    """Least plus largest value of each cell."""
    n, dims = len(cells), len(lo)
    if not n or not dims:
        return np.zeros((n, dims), np.int64)
    raw = np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(n, -1)
    bit = np.unpackbits(raw, axis=1)[:, :dims * bits].reshape(n, dims, bits)
    cell = bit @ (1 << np.arange(bits, dtype=np.int64))
    return 2 * (lo + cell * width) + width - 1


def bounds(classes: DataFrame, cells: DataFrame, lo: np.ndarray, width: np.ndarray, bits: int, k: int,
           block_asked: int = blocks.BLOCK_ASKED) -> DataFrame:
    """asker, class, low2, high2: twice the bounds of every product that may be among the asker's first k + 1."""
    wanted = k + 1
    asked = classes.filter("asked").select("class", "v")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for pair, is_row, part in blocks.runs(batches):
            if pair != at:
                if state:
                    yield from state.left()
                at, state = pair, _Scan(wanted, width)
            if not is_row:
                state.ask(part)
            else:
                for some in blocks.steps(state.n, part):
                    yield from state.see(some["class"], _doubled_middles(some["cells"], lo, width, bits))
        if state:
            yield from state.left()

    met = blocks.beside_all(asked, cells, "class", block_asked)
    return materialise(met.select("pair", "is_row", "class", "v", "cells").mapInArrow(
        scan, "asker long, class long, low2 long, high2 long"), "bounds")


class _Scan:
    """One block of askers against a stream of cells."""

    def __init__(self, wanted: int, width: np.ndarray):
        self.wanted, self.width, self.parts, self.n = wanted, width, [], 0
        self.best = None

    def ask(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)
        self.n += part.num_rows

    def see(self, classes: pa.Array, middles: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        if self.best is None:
            self.ids = np.concatenate([blocks.integers(p["class"]) for p in self.parts])
            each = [blocks.matrix(p["v"], len(self.width)) for p in self.parts]
            self.asked, self.parts = np.concatenate(each), []
            reach = np.pad(np.maximum(self.width - 1, 0), (0, self.asked.shape[1] - len(self.width)))
            self.slack = blocks.products(np.abs(self.asked), reach[None, :])[:, 0]
            self.best = np.full((self.n, self.wanted), blocks.LEAST // 4)
            self.held, self.n_held = [], 0
        score = blocks.products(self.asked, middles)
        both = np.concatenate((self.best, score), axis=1)
        self.best = np.partition(both, both.shape[1] - self.wanted, axis=1)[:, -self.wanted:]
        asker, at = np.nonzero(score >= self._least()[:, None])
        self.held.append((asker, blocks.integers(classes)[at], score[asker, at]))
        self.n_held += len(asker)
        if self.n_held > HELD:
            self._thin()
            if self.n_held > HELD // 2:
                yield from self.left()

    def _least(self) -> np.ndarray:
        """A middle below this has an upper bound under the k-th best lower bound."""
        return self.best.min(axis=1) - 2 * self.slack

    def _thin(self) -> None:
        asker, cls, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        good = score >= self._least()[asker]
        self.held, self.n_held = [(asker[good], cls[good], score[good])], int(good.sum())

    def left(self) -> Iterator[pa.RecordBatch]:
        if self.best is None or not self.n_held:
            return
        self._thin()
        (asker, cls, score), self.held, self.n_held = self.held[0], [], 0
        slack = self.slack[asker]
        table = pa.table([pa.array(self.ids[asker]), pa.array(cls), pa.array(score - slack), pa.array(score + slack)],
                         names=["asker", "class", "low2", "high2"])
        yield from table.to_batches(max_chunksize=50_000)


def read_exact(found: DataFrame, classes: DataFrame) -> DataFrame:
    """asker, class, score, ids: the candidates with their exact vectors read."""
    asked = classes.filter("asked").select(F.col("class").alias("asker"), F.col("v").alias("asked_v"))
    joined = found.select("asker", "class").join(classes.select("class", "v", "ids"), "class").join(asked, "asker")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = blocks.row_products(blocks.matrix(b["asked_v"]), blocks.matrix(b["v"]))
            yield pa.RecordBatch.from_arrays([b["asker"], b["class"], pa.array(value), b["ids"]], ["asker", "class", "score", "ids"])

    return joined.select("asker", "class", "v", "asked_v", "ids").mapInArrow(
        score, "asker long, class long, score long, ids array<struct<vec_id:long>>")


def _kth(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """asker, name: its n-th largest value, for askers that have n."""
    order = Window.partitionBy("asker").orderBy(F.desc(value))
    return (df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)
            .filter(F.col("_n") == n).select("asker", F.col(value).alias(name)))


def answers(classes: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """asker, found: its first k + 1 rows, as structs of class, vec_id and score in order."""
    certain = _kth(candidates, "low2", k + 1, "least")
    candidates = materialise(candidates.join(certain, "asker", "left").filter(
        F.col("least").isNull() | (F.col("high2") >= F.col("least"))).drop("least"), "candidates")
    near = Window.partitionBy("asker").orderBy(F.desc("high2"), "class")
    first = (candidates.withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= FIRST * (k + 1)))
    reached = materialise(_kth(read_exact(first, classes), "score", k + 1, "reached"), "reached")
    open_ = candidates.join(reached, "asker", "left").filter(
        F.col("reached").isNull() | (F.col("high2") >= 2 * F.col("reached")))
    rows = read_exact(open_, classes).select("asker", "class", "score", F.explode("ids").alias("id")).select(
        "asker", "class", "score", F.col("id.vec_id").alias("vec_id"))
    order = Window.partitionBy("asker").orderBy(*_by_id(F.desc("score")), "class")
    ranked = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    return ranked.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("n", "class", "vec_id", "score"))).alias("found"))


def search(vectors: DataFrame, is_asked: Column, k: int = K, scale: int = SCALE, bits: int = BITS,
           block_asked: int = blocks.BLOCK_ASKED) -> DataFrame:
    """query_id, rank, vec_id, score of every asked row's first k other rows.

    vectors: vec_id, embedding and any other columns. is_asked: a condition on vec_id; null is no.
    """
    bounded_batches(vectors.sparkSession)
    rows = materialise(vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), blocks.integer_vector(F.col("embedding"), scale).alias("v"),
        F.coalesce(is_asked, F.lit(False)).alias("asked")).filter(F.col("v").isNotNull()), "vectors")
    classes = classes_of(rows, k)
    lo, width = grid_of(classes, bits)
    cells = approximate(classes, lo, width, bits)
    found = answers(classes, bounds(classes, cells, lo, width, bits, k, block_asked), k)
    asked = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "v").join(
        classes.filter("asked").select("v", F.col("class").alias("asker")), "v").drop("v")
    own = F.array_position(F.transform("found", lambda e: (e["class"] == F.col("asker"))
                                       & (e["vec_id"] == F.col("query_id"))), True)
    others = F.filter("found", lambda e, i: i + 1 != F.col("own"))
    return (asked.join(found, "asker").withColumn("own", own)
            .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"),
                    F.col("e.score").alias("score")))


def production(vectors: DataFrame) -> DataFrame:
    return search(vectors, F.col("vec_id") % EVERY == 0)


def oracle_sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row AS asker, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY asker ORDER BY score DESC, vec_id NULLS LAST) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {K}"""

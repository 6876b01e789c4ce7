"""Integer vectors, exact inner products, and every asked vector beside every row in bounded blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ASKED = 32_768  # asked vectors that one task holds
SCORES_IN_FLIGHT = 4_000_000
MOST = float(2**31)
LEAST = np.iinfo(np.int64).min


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector is null or holds a null or non-finite
    component. Beyond +-2**31 a component counts as +-2**31, so that its products stay defined."""
    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x.cast("double") * F.lit(float(scale))))).cast("long")

    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return F.when(F.forall(vector, fine), F.transform(vector, whole))


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int = 0) -> np.ndarray:
    """Rows of one width, shorter vectors filled up with zeros: they add nothing to a product."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(dims, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _size(m: np.ndarray) -> int:
    return int(np.abs(m).max(initial=0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a with those of b, exact; beyond 64 bits they stay at the bound."""
    a, b = aligned(a, b)
    if a.shape[1] * _size(a) * _size(b) < 2**53:  # every partial sum is exact in a double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return _held(a.astype(object) @ b.astype(object).T)


def row_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with the same row of b."""
    a, b = aligned(a, b)
    if a.shape[1] * _size(a) * _size(b) < 2**62:
        return np.einsum("ij,ij->i", a, b)
    return _held((a.astype(object) * b.astype(object)).sum(axis=1))


def _held(exact: np.ndarray) -> np.ndarray:
    return np.clip(exact, LEAST + 1, np.iinfo(np.int64).max).astype(np.int64)


def beside_all(asked: DataFrame, rows: DataFrame, key: str, block_asked: int = BLOCK_ASKED) -> DataFrame:
    """Both tables in one, dealt so that each partition holds one block of asked rows and then, in no order, one
    stripe of the rows: columns pair, is_row, and those of both tables (null where a table lacks one).

    Every asked row meets every row once. A task holds one block of asked rows, bounded by block_asked, and
    streams its stripe, so no partition must fit in memory. There are as many stripes as give every shuffle
    partition a pair; with more blocks than that each block meets all rows in one stripe. `key` names a
    column that both have and that spreads the rows; a null key is dealt by itself.
    """
    spark = asked.sparkSession
    blocks = max(1, -(-asked.count() // block_asked))
    stripes = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks))

    def part(n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("_block", part(blocks)).withColumn("_stripe", each(stripes)).withColumn("is_row", F.lit(False))
    right = rows.withColumn("_stripe", part(stripes)).withColumn("_block", each(blocks)).withColumn("is_row", F.lit(True))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("pair", F.col("_block") * stripes + F.col("_stripe"))
    return (both.drop("_block", "_stripe").repartitionById(blocks * stripes, "pair")
            .sortWithinPartitions("pair", "is_row"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(pair, is_row, rows) of each stretch of rows of one kind, in the order of beside_all."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pair = batch["pair"].to_numpy(zero_copy_only=False)
        kind = batch["is_row"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((pair[1:] != pair[:-1]) | (kind[1:] != kind[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield int(pair[start]), bool(kind[start]), batch.slice(start, end - start)


def steps(n_asked: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose scores against all asked rows stay within SCORES_IN_FLIGHT."""
    each = max(1, SCORES_IN_FLIGHT // max(1, n_asked))
    for at in range(0, rows.num_rows, each):
        yield rows.slice(at, each)


def integers(column: pa.Array) -> np.ndarray:
    """Long values; null reads as 0."""
    return np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), np.int64)


class Best:
    """The first k of each owner by score descending, then id with missing ids last, then row, over a stream."""

    def __init__(self, owners: int, k: int):
        self.k = k
        self.floor = np.full(owners, LEAST)  # the k-th best score so far; nothing below it can enter
        self.rows = [np.zeros(0, np.int64) for _ in range(5)]  # owner, score, missing, id, row

    def add(self, scores: np.ndarray, open_: np.ndarray, missing: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        """scores: owners x rows; open_ says which of them take part."""
        owner, at = np.nonzero(open_ & (scores >= self.floor[:, None]))
        if not len(owner):
            return
        score = scores[owner, at]
        if len(owner) > 4 * self.k * len(self.floor) and scores.shape[1] > self.k:
            # most can't enter: look at what reaches the slice's own k-th best only
            held = np.where(open_, scores, LEAST)
            kth = np.partition(held, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            good = score >= kth[owner]
            owner, at, score = owner[good], at[good], score[good]
        new = (owner, score, missing[at].astype(np.int64), ids[at], row[at])
        owner, score, miss, id_, row_ = (np.concatenate(x) for x in zip(self.rows, new, strict=True))
        order = np.lexsort((row_, id_, miss, -score, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = order[rank < self.k]
        self.rows = [x[keep] for x in (np.concatenate(y) for y in zip(self.rows, new, strict=True))]
        full = order[rank == self.k - 1]
        kept = np.concatenate((np.zeros(0, np.int64), score[full]))
        self.floor[owner[rank == self.k - 1]] = kept

"""Exact filtered vector search that skips blocks of stored vectors by pivot distances.

The index cuts the stored vectors, at unit length, into blocks around pivots: each row belongs to its nearest pivot, and a
block knows its pivot and radius. By the triangle inequality no row of a block lies nearer to a query than the query's distance
from the pivot less the radius, and as 2 - 2 cos is the squared distance of unit vectors this bounds every cosine in
the block. A search reads, for each request, the most promising blocks first, until they hold k rows, and then only blocks whose bound
reaches the k-th best score found; the rest is certain to hold nothing better. Pivots only steer the work: any choice gives
the same answer, and blocks that no request needs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import policy
from wardline.operators.retrieval import _SCORED, _matrix, _meet, _merge
from wardline.session import materialise

MAX_PIVOTS = 4096
SLACK = 1e-9  # float noise of a distance
_PLACED = "block int, distance double"
MEET_REQUESTS, MEET_ROWS = 16_384, 65_536  # about as many of a block meet in one task


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # the vectors' columns, and block
    pivots: np.ndarray  # at most MAX_PIVOTS unit vectors
    radius: np.ndarray  # of every block; negative where it is empty


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between unit vectors; an all-zero vector stays zero and is compared as such."""
    square = (vectors * vectors).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def build(vectors: DataFrame, n_pivots: int = 256) -> Index:
    """vectors: nric, embedding and any columns to filter by. Rows without a vector are left out.

    The pivots are the stored vectors that come first by a hash of their key, n_pivots of them (at most MAX_PIVOTS, which
    bounds what is sent to the tasks). Blocks are folders, so one that is not wanted is not opened.
    """
    stored = vectors.filter(F.col("embedding").isNotNull())
    n = min(n_pivots, MAX_PIVOTS)
    chosen = stored.select("nric", "embedding").orderBy(F.xxhash64("nric"), "nric").limit(n).toArrow()
    pivots = _matrix(chosen["embedding"])
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    names, at = stored.columns, stored.columns.index("embedding")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(_matrix(batch.column(at)), shared.value)
            nearest = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(d)), nearest])], [*names, "block", "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema) + ", " + _PLACED
    placed = materialise(stored.mapInArrow(place, schema), "blocks", partition_by="block")
    found = placed.groupBy("block").agg(F.max("distance").alias("radius")).collect()  # a row per pivot
    radius = np.full(len(pivots), -1.0)
    for r in found:
        radius[r.block] = r.radius
    return Index(placed.drop("distance"), pivots, radius)


def search(requests: DataFrame, index: Index, k: int = policy.TOP_K, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(request_id, nric, score, raw of each request's k nearest rows among those that `where` holds for;
    request_id, n_blocks, n_read: how many blocks there are and how many were read for it)."""
    spark = requests.sparkSession
    filled = np.flatnonzero(index.radius >= 0)
    shared = spark.sparkContext.broadcast((index.pivots[filled], index.radius[filled], filled))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, blocks = shared.value
        for batch in batches:
            if not (batch.num_rows and len(blocks)):
                continue
            q = _matrix(batch["query_vec"])
            nearest = np.maximum(_distances(q, pivots) - radius - SLACK, 0.0)
            # cos = (|q|^2 + |v|^2 - d^2) / 2 with |v| <= 1; an all-zero query scores 0 everywhere
            high = np.minimum(1.0, ((q * q).sum(axis=1)[:, None] + 1 - nearest ** 2) / 2) + SLACK
            high[(q == 0).all(axis=1)] = 0.0
            n, m = high.shape
            yield pa.RecordBatch.from_arrays(
                [batch["request_id"].take(pa.array(np.repeat(np.arange(n), m))), pa.array(np.tile(blocks, n), pa.int32()),
                 pa.array(high.ravel())], ["request_id", "block", "high"])

    asked = materialise(requests.select("request_id", "query_vec").filter(F.col("query_vec").isNotNull()), "asked")
    rows = index.rows if where is None else index.rows.filter(where)
    # a row per pivot; blocks without a row go
    sizes = materialise(rows.groupBy("block").agg(F.count("*").alias("size")), "sizes")
    bounds = materialise(asked.mapInArrow(bound, "request_id string, block int, high double").join(sizes, "block"), "bounds")
    promising = Window.partitionBy("request_id").orderBy(F.desc("high"), "block").rowsBetween(Window.unboundedPreceding, -1)
    first = (bounds.withColumn("_before", F.coalesce(F.sum("size").over(promising), F.lit(0)))
             .filter(F.col("_before") < k).select("request_id", "block"))
    near = materialise(_scored(asked, first, rows, sizes, k), "near")
    kth = _merge(near, k).groupBy("request_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    reach = bounds.join(kth, "request_id", "left").filter(
        F.col("n").isNull() | (F.col("n") < k) | (F.col("high") >= F.col("least"))).select("request_id", "block")
    rest = materialise(reach.join(first, ["request_id", "block"], "left_anti"), "rest")
    best = _merge(near.unionByName(_scored(asked, rest, rows, sizes, k)), k)
    read = first.unionByName(rest).groupBy("request_id").agg(F.count("*").alias("n_read"))
    report = read.withColumn("n_blocks", F.lit(len(filled)).cast("long")).select("request_id", "n_blocks", "n_read")
    return best, report


def _scored(asked: DataFrame, pairs: DataFrame, rows: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """The k best of every (request, block) pair, and of every part of a large block.

    A block's rows are cut into parts and its requests into chunks, as many as their numbers ask for, and every part meets
    every chunk in one task: a large block is no single task, and no task holds more than a part and a chunk."""
    def cuts(column: str, most: int) -> Column:
        return F.ceil(F.col(column) / most).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def some(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    met = (pairs.groupBy("block").agg(F.count("*").alias("asked")).join(sizes, "block")  # a row per pivot at most
           .select("block", cuts("asked", MEET_REQUESTS).alias("chunks"), cuts("size", MEET_ROWS).alias("parts")))
    queries = (pairs.join(met, "block").join(asked, "request_id")
               .select("block", some("request_id", "chunks").alias("chunk"), every("parts").alias("part"), "request_id", "query_vec"))
    # the join prunes folders at run time
    stored = rows.join(met, "block").select(
        "block", every("chunks").alias("chunk"), some("nric", "parts").alias("part"), "nric", "embedding")
    at = ("block", "chunk", "part")
    return queries.groupBy(*at).cogroup(stored.groupBy(*at)).applyInArrow(lambda a, b: _meet(a, b, k), _SCORED)

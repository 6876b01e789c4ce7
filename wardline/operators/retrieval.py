"""Exact cosine top-k of many requests over many stored vectors, and record assembly.

Three physical forms of the same exact answer, chosen by measured size:

* stored vectors fit the broadcast bound: each request batch is scored against the whole matrix
  and keeps its own k best. No shuffle.
* requests fit the bound, and their heaps theirs: vectors stay where they are. The splits are read by as many tasks as there are cores, one
  heap of k per request each, so k x requests x cores candidates leave the scan however many splits there are; heaps
  are merged in levels of FAN_IN.
* neither fits: both sides are cut into bounded blocks and every pair of blocks meets in one task
  (cogroup on the block pair), k candidates per request leave it, then the same merge.

No form emits the request x vector pairs. A vector's copies beyond its first k are not scored. Scores are ranked at 12 decimals, below the noise of
float64 summation order, and ties go to the smaller key, so the answer does not depend on
the form or the partitioning. `raw` is the score as computed, for comparison with a threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import policy
from wardline.functions.vectors import round_score

BROADCAST_BYTES = 256 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
COMPARE_DIGITS = 12
SCORES_IN_FLIGHT = 4_000_000
FAN_IN = 64
HEAP_ROWS = 1_000_000  # about 40 bytes each, a few times over while heaps are merged, in every task
ASKED, TILE = 1024, 2048  # requests and vectors whose scores are held at once
SLICE = 16_384  # vectors that are widened or gathered at once
_SCORED = "request_id string, nric string, score double, raw double"


def _raw(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as rows, single precision where they are stored so.

    Vectors of different lengths, or with missing elements, can't be scored: the job fails."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if not n:
        return np.zeros((0, 0))
    dims, flat = pc.unique(pc.list_value_length(vectors)), vectors.flatten()
    if vectors.null_count or flat.null_count or len(dims) != 1:
        raise ValueError("vectors must have one length and no missing elements")
    m = flat.to_numpy(zero_copy_only=False).reshape(n, -1)
    return m if m.dtype == np.float32 else m.astype(np.float64)


def _lengths(m: np.ndarray) -> np.ndarray:
    """Of the rows; 1 for an all-zero one."""
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    norms[norms == 0] = 1.0
    return norms


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit-length float64 rows; an all-zero vector stays zero, so its every score is 0."""
    m = _raw(vectors).astype(np.float64)
    return m / _lengths(m)[:, None]


class _Stored:
    """Vectors, stored or asked for, as they came, with their lengths; they are made unit vectors a tile at a time."""

    def __init__(self, raw: np.ndarray, norms: np.ndarray | None = None):
        self.raw, self.norms = raw, norms
        if norms is None:
            self.norms = np.concatenate([np.zeros(0), *(_lengths(raw[i:i + SLICE].astype(np.float64))
                                                        for i in range(0, len(raw), SLICE))])

    def __len__(self) -> int:
        return len(self.raw)

    def unit(self, rows) -> np.ndarray:
        return self.raw[rows] / self.norms[rows, None]


def _spare_copies(raw: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep: a vector's first k copies. Further ones have the same score and a later key, so they are in no k
    best."""
    words = np.ascontiguousarray(raw).view(np.uint32)
    odd = np.random.default_rng(0).integers(1, 2**63, words.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.concatenate([words[i:i + SLICE].astype(np.uint64) @ odd for i in range(0, len(raw), SLICE)])
    order = np.argsort(sums, kind="stable")  # equal rows get equal sums; the others only interrupt a run
    same = np.zeros(len(raw), dtype=bool)
    for i in range(1, len(raw), SLICE):
        part = order[i - 1:i + SLICE]
        same[i:i + len(part) - 1] = (words[part[1:]] == words[part[:-1]]).all(axis=1)
    at = np.arange(len(raw))
    start = np.maximum.accumulate(np.where(same, 0, at))
    keep = np.ones(len(raw), dtype=bool)
    keep[order] = at - start < k
    return keep


def _best_rows(queries: _Stored | np.ndarray, stored: _Stored, k: int, floor: np.ndarray | None = None):
    """(rows of queries, rows of stored, score, raw) of each query's k best, in order; stored rows are in key order, so that
    position breaks ties. queries: an array is of unit vectors. floor: a score per query below which nothing is wanted.

    Scores are first computed in single precision. Only those that its error allows to reach the k-th best found so far are
    computed in double precision, so the result is that of double precision throughout.
    """
    k = min(k, len(stored))
    if isinstance(queries, np.ndarray):
        queries = _Stored(queries, np.ones(len(queries)))
    found = [_best_of(queries.unit(slice(i, i + ASKED)), stored, k, None if floor is None else floor[i:i + ASKED])
             for i in range(0, len(queries), ASKED)] if k else []
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    rows = np.concatenate([f[0] + i * ASKED for i, f in enumerate(found)])
    return rows, *(np.concatenate(c) for c in list(zip(*found, strict=True))[1:])


def _best_of(queries: np.ndarray, stored: _Stored, k: int, floor: np.ndarray | None):
    n, size, dims = len(queries), len(stored), queries.shape[1]
    error = (dims + 16) * 2.0 ** -23  # above twice what rounding can do to the product of two unit vectors
    score, raw = np.full((n, k), -np.inf), np.zeros((n, k))
    col = np.full((n, k), size)
    zero = ~queries.any(axis=1)
    score[zero], col[zero] = 0.0, np.arange(k)  # every score of an all-zero query is 0
    single, space = queries.astype(np.float32), np.empty(n * min(TILE, size), np.float32)
    for a in range(0, size, TILE):
        tile = stored.unit(slice(a, a + TILE))
        s = np.matmul(single, tile.astype(np.float32).T, out=space[:n * len(tile)].reshape(n, -1))
        width, cut = s.shape[1], score[:, -1]
        limit = cut - error
        known = cut if floor is None else np.maximum(cut, floor)
        if k <= width and np.isneginf(known).any():
            limit = np.maximum(limit, np.partition(s, width - k, axis=1)[:, width - k] - 2 * error)
        if floor is not None:
            limit = np.maximum(limit, floor - error)
        limit[zero] = np.inf
        limit = limit.astype(np.float32)
        some = np.flatnonzero(s.max(axis=1) >= limit)  # far fewer than all, but for the first tiles
        r, c = np.nonzero(s[some] >= limit[some, None])
        if not len(r):
            continue
        r = some[r]
        if len(r) * 16 > s.size:
            exact = (queries @ tile.T)[r, c]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", queries[r[i:i + SLICE]], tile[c[i:i + SLICE]])
                                    for i in range(0, len(r), SLICE)])
        value = np.round(exact, COMPARE_DIGITS)
        better = value > cut[r]  # an equal one has a later key
        if floor is not None:
            better &= value >= floor[r]
        if not better.any():
            continue
        r, c, value, exact = r[better], c[better] + a, value[better], exact[better] + 0.0
        hit = np.unique(r)
        r, c = np.concatenate([np.repeat(hit, k), r]), np.concatenate([col[hit].ravel(), c])
        value, exact = np.concatenate([score[hit].ravel(), value]), np.concatenate([raw[hit].ravel(), exact])
        order = np.lexsort((c, -value, r))
        order = order[np.arange(len(r)) - np.searchsorted(r[order], r[order], side="left") < k]
        shape = (len(hit), k)
        score[hit], col[hit], raw[hit] = value[order].reshape(shape), c[order].reshape(shape), exact[order].reshape(shape)
    rows, place = np.nonzero(col < size)
    return rows, col[rows, place], score[rows, place], raw[rows, place]


def _best(request_ids: pa.Array, queries: _Stored | np.ndarray, keys: pa.Array, stored: _Stored, k: int) -> pa.RecordBatch:
    """Each request's k best keys; `keys` must be sorted."""
    rows, cols, score, raw = _best_rows(queries, stored, k)
    return pa.RecordBatch.from_arrays(
        [request_ids.take(pa.array(rows)), keys.take(pa.array(cols)), pa.array(score), pa.array(raw)],
        names=["request_id", "nric", "score", "raw"])


def _sorted_keys(keys: pa.Array, vectors: pa.Array, k: int) -> tuple[pa.Array, _Stored]:
    """The vectors in key order, without copies that are in no k best."""
    order = pc.array_sort_indices(keys)
    raw = _raw(vectors)[order.to_numpy()]
    if not len(raw):
        return keys, _Stored(raw)
    keep = _spare_copies(raw, k)
    if keep.all():
        return keys.take(order), _Stored(raw)  # no second copy of what is held
    kept = np.flatnonzero(keep)
    return keys.take(order.take(pa.array(kept))), _Stored(raw[kept])


def _meet(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best of each request among the rows, both held whole."""
    if not (asked.num_rows and rows.num_rows):
        return pa.table({"request_id": pa.array([], pa.string()), "nric": pa.array([], pa.string()),
                         "score": pa.array([], pa.float64()), "raw": pa.array([], pa.float64())})
    keys, stored = _sorted_keys(rows["nric"].combine_chunks(), rows["embedding"].combine_chunks(), k)
    queries = _Stored(_raw(asked["query_vec"]))
    return pa.Table.from_batches([_best(asked["request_id"].combine_chunks(), queries, keys, stored, k)])


def _ids(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


def topk(requests: DataFrame, vectors: DataFrame, k: int = policy.TOP_K, where: Column | None = None,
         broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(request_id, nric, score, raw): each request's k nearest stored vectors.

    requests: request_id, query_vec. vectors: nric, embedding. `where` filters the vectors first.
    A missing vector on either side takes no part.
    """
    if where is not None:
        vectors = vectors.filter(where)
    left = requests.select("request_id", "query_vec").filter(F.col("query_vec").isNotNull())
    right = vectors.select("nric", "embedding").filter(F.col("embedding").isNotNull())
    stored_bytes = _bytes(right, "embedding")
    if stored_bytes <= broadcast_bytes:
        return _score_against_vectors(left, right, k)
    asked_bytes, n_asked = _measured(left, "query_vec")
    if asked_bytes <= broadcast_bytes and n_asked * k <= HEAP_ROWS:
        return _merge_levels(_score_against_requests(left, right, k), k, _slots(right))
    return _merge(_score_blocks(left, right, k, -(-asked_bytes // block_bytes),
                                -(-stored_bytes // block_bytes)), k)


def _bytes(df: DataFrame, vector: str) -> int:
    return _measured(df, vector)[0]


def _measured(df: DataFrame, vector: str) -> tuple[int, int]:
    """What the vectors take as float64, and some for each key: summed over all rows, none stands for the others. And the
    number of rows."""
    found = df.agg(F.coalesce(F.sum(F.size(vector).cast("long") * 8 + 64), F.lit(0)).alias("taken"), F.count("*").alias("n")).first()
    return found.taken, found.n


def _slots(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _merge(candidates: DataFrame, k: int, *groups: str) -> DataFrame:
    best = Window.partitionBy("request_id", *groups).orderBy(F.desc("score"), "nric")
    return (candidates.withColumn("_n", F.row_number().over(best))
            .filter(F.col("_n") <= k).drop("_n"))


def _merge_levels(candidates: DataFrame, k: int, slots: int) -> DataFrame:
    """Heaps of `slots` tasks, merged FAN_IN at a time: no task reads more than k x FAN_IN rows of a request."""
    while slots > FAN_IN:
        slots = -(-slots // FAN_IN)
        candidates = _merge(candidates.withColumn("slot", F.pmod("slot", F.lit(slots))), k, "slot")
    return _merge(candidates.drop("slot"), k)


def _score_against_vectors(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    table = right.toArrow()  # within the broadcast bound, checked by the caller
    keys, stored = _sorted_keys(table["nric"].combine_chunks(), table["embedding"].combine_chunks(), k)
    shared = left.sparkSession.sparkContext.broadcast((keys, stored.raw, stored.norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, raw, norms = shared.value
        stored = _Stored(raw, norms)
        for batch in batches:
            if batch.num_rows and len(stored):
                yield _best(batch["request_id"], _Stored(_raw(batch["query_vec"])), keys, stored, k)

    return left.mapInArrow(run, _SCORED)


def _score_against_requests(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    table = left.toArrow()  # within the broadcast bound, checked by the caller
    asked = _Stored(_raw(table["query_vec"]))
    shared = left.sparkSession.sparkContext.broadcast((table["request_id"].combine_chunks(), asked.raw, asked.norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, norms = shared.value
        queries = _Stored(raw, norms)
        slot = TaskContext.get().partitionId()
        best, come = None, []  # the task's k best per request when last merged, and what came since
        floor = np.full(len(ids), -np.inf)
        for batch in batches:
            if not (batch.num_rows and len(ids)):
                continue
            keys, stored = _sorted_keys(batch["nric"], batch["embedding"], k)
            rows, cols, score, raw = _best_rows(queries, stored, k, floor)
            come.append(pa.table({"row": rows, "nric": keys.take(pa.array(cols)), "score": score, "raw": raw}))
            if best is None or sum(c.num_rows for c in come) * 4 > best.num_rows:
                best, come = _keep(pa.concat_tables([*([best] if best else []), *come]), k, floor), []
        if come:
            best = _keep(pa.concat_tables([best, *come]), k, floor)
        for part in best.to_batches(max_chunksize=10_000) if best is not None else []:
            yield pa.RecordBatch.from_arrays(
                [ids.take(part["row"]), part["nric"], part["score"], part["raw"], pa.array(np.full(part.num_rows, slot), pa.int32())],
                ["request_id", "nric", "score", "raw", "slot"])

    # several splits per task, without a shuffle
    return right.coalesce(_slots(right)).mapInArrow(run, _SCORED + ", slot int")


def _keep(candidates: pa.Table, k: int, floor: np.ndarray) -> pa.Table:
    """Each row's k best; floor gets the k-th score of those that have k."""
    ranked = candidates.sort_by([("row", "ascending"), ("score", "descending"), ("nric", "ascending")])
    owner = ranked["row"].to_numpy()
    position = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    last = np.flatnonzero(position == k - 1)
    floor[owner[last]] = ranked["score"].to_numpy()[last]
    return ranked.filter(pa.array(position < k)).combine_chunks()


def _score_blocks(left: DataFrame, right: DataFrame, k: int, n_left: int, n_right: int) -> DataFrame:
    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    requests = left.select("*", block("request_id", n_left).alias("lb"), every(n_right).alias("rb"))
    vectors = right.select("*", block("nric", n_right).alias("rb"), every(n_left).alias("lb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return _meet(a, b, k)

    return (requests.groupBy("lb", "rb").cogroup(vectors.groupBy("lb", "rb"))
            .applyInArrow(meet, _SCORED))


def score_profile(requests: DataFrame, vectors: DataFrame, low: float = policy.LOW_SIMILARITY,
                  broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each request scored against every stored vector, summed up without emitting the pairs:
    n_scored, n_low (rounded score below the threshold), top_score, bottom_score.

    Requests within the broadcast bound are sent to the vectors, which are read in place by as many tasks as there are
    cores, each with one running row per request. Beyond it both sides are cut into bounded blocks that meet
    in pairs by a shuffle. A request without stored vectors has no row.
    """
    left = requests.select("request_id", "query_vec").filter(F.col("query_vec").isNotNull())
    right = vectors.select("nric", "embedding").filter(F.col("embedding").isNotNull())
    asked_bytes = _bytes(left, "query_vec")
    if asked_bytes <= broadcast_bytes:
        scored = _profile_in_place(left, right, low)
    else:
        scored = _profile_blocks(left, right, low, -(-asked_bytes // block_bytes),
                                 max(1, -(-_bytes(right, "embedding") // block_bytes)))
    return scored.groupBy("request_id").agg(
        F.sum("n_scored").alias("n_scored"), F.sum("n_low").alias("n_low"),
        F.max("top_score").alias("top_score"), F.min("bottom_score").alias("bottom_score"))


_PROFILE = "request_id string, n_scored long, n_low long, top_score double, bottom_score double"


class _Profile:
    """Running sums of some requests."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, low: float):
        self.ids, self.queries, self.low, self.n = ids, queries, low, 0
        self.n_low = np.zeros(len(ids), np.int64)
        self.top, self.bottom = np.full(len(ids), -np.inf), np.full(len(ids), np.inf)

    def add(self, stored: np.ndarray) -> None:
        self.n += len(stored)
        step = max(1, SCORES_IN_FLIGHT // max(1, len(stored)))
        for i in range(0, len(self.ids) if len(stored) else 0, step):
            s = np.rint(self.queries[i:i + step] @ stored.T * 1e4) / 1e4
            part = slice(i, i + step)
            self.n_low[part] += (s < self.low).sum(axis=1)
            self.top[part] = np.maximum(self.top[part], s.max(axis=1))
            self.bottom[part] = np.minimum(self.bottom[part], s.min(axis=1))

    def rows(self) -> pa.Table:
        keep = np.full(len(self.ids), self.n > 0)
        return pa.table({
            "request_id": pa.array(self.ids[keep], pa.string()), "n_scored": pa.array(np.full(int(keep.sum()), self.n), pa.int64()),
            "n_low": pa.array(self.n_low[keep]), "top_score": pa.array(self.top[keep]), "bottom_score": pa.array(self.bottom[keep])})


def _profile_in_place(left: DataFrame, right: DataFrame, low: float) -> DataFrame:
    table = left.toArrow()  # within the broadcast bound, checked by the caller
    shared = left.sparkSession.sparkContext.broadcast((_ids(table["request_id"]), _matrix(table["query_vec"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile = _Profile(*shared.value, low)
        for batch in batches:
            if batch.num_rows and len(profile.ids):
                profile.add(_matrix(batch["embedding"]))
        yield from profile.rows().to_batches(max_chunksize=10_000)

    return right.coalesce(_slots(right)).mapInArrow(run, _PROFILE)


def _profile_blocks(left: DataFrame, right: DataFrame, low: float, n_left: int, n_right: int) -> DataFrame:
    requests = left.select("*", F.pmod(F.xxhash64("request_id"), F.lit(n_left)).alias("lb"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))).alias("rb"))
    stored = right.select("*", F.pmod(F.xxhash64("nric"), F.lit(n_right)).cast("int").alias("rb"),
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_left - 1).cast("long"))).alias("lb"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        profile = _Profile(_ids(a["request_id"]), _matrix(a["query_vec"]), low)
        if a.num_rows and b.num_rows:
            profile.add(_matrix(b["embedding"]))
        return profile.rows()

    return requests.groupBy("lb", "rb").cogroup(stored.groupBy("lb", "rb")).applyInArrow(meet, _PROFILE)


def retrieve(top: DataFrame, employees: DataFrame) -> DataFrame:
    """Full records of the top keys with _similarity_score, rounded to 4 digits.

    A key stored twice inside one top-k keeps its lowest score; a key without a record vanishes.
    """
    keyed = top.groupBy("request_id", "nric").agg(F.min("score").alias("score"))
    return (keyed.join(employees, "nric")
            .withColumn("_similarity_score", round_score(F.col("score"))).drop("score"))


def top_score(requests: DataFrame, top: DataFrame) -> DataFrame:
    """(request_id, top_score): highest unrounded score, 0 when nothing is stored."""
    best = top.groupBy("request_id").agg(F.max("raw").alias("best"))
    return requests.select("request_id").join(best, "request_id", "left").select(
        "request_id", F.coalesce("best", F.lit(0.0)).alias("top_score"))


def low_similarity_warning(score: Column) -> Column:
    """Request-level warning text; compares the unrounded score, strictly."""
    return F.when(score < policy.LOW_SIMILARITY, F.concat(
        F.lit("Low similarity warning — top score "), score_text(round_score(score))))


def score_text(score: Column) -> Column:
    """At most four decimals, trailing zeros dropped, never in exponent form."""
    return F.regexp_replace(score.cast("decimal(10,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def rank_records(records: DataFrame) -> DataFrame:
    """Adds record_no from 1 in final order: rounded score descending, then key.

    A request holds at most k records here, so its group is small.
    """
    order = Window.partitionBy("request_id").orderBy(F.desc("_similarity_score"), "nric")
    return records.withColumn("record_no", F.row_number().over(order).cast("long"))

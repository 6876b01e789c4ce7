"""Shared helpers: reading tables, Arrow batches of bounded size, per-worker memos, word shingles."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SHINGLE = 5
PIECE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_memo(name: str, make: Callable):
    """One object per Python worker and name. Workers outlive tasks, so a memo spares later tasks the
    same work; it never changes a result. It hangs on a module of its own because functions sent by
    value start with fresh globals. A worker holds the last one asked for, so memos don't add up."""
    home = sys.modules.setdefault("_wardline_worker", types.ModuleType("_wardline_worker"))
    if not hasattr(home, name):
        for other in [n for n in vars(home) if not n.startswith("__")]:
            delattr(home, other)
        setattr(home, name, make())
    return getattr(home, name)


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `limit` bytes or one row, so long texts don't add up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        each = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        if batch.nbytes <= limit:
            yield batch
            continue
        sizes = np.zeros(batch.num_rows, np.int64)
        for col in batch.columns:
            kind = col.type
            if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind):
                sizes += np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), np.int64)
            else:
                sizes += 16
        if each == 1 and batch.num_rows == 1:
            yield batch
            continue
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null reads as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


class WordHashes(dict):
    """Word to a 64-bit hash, memoised; emptied when it holds 400,000 words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised (wrap-around is meant)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(docs: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles (white-space words) of every text, with the text's index.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    memo = worker_memo("word_hashes", WordHashes)
    flat, lengths = [], np.empty(len(docs), np.int64)
    for i, doc in enumerate(docs):
        words = doc.split()
        lengths[i] = len(words)
        flat.extend(map(memo.__getitem__, words))
    words = np.array(flat, np.uint64)
    rows = np.repeat(np.arange(len(docs)), lengths)
    if not len(words):
        return words, rows
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))  # words from here to the text's end
    rolled = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = words[j:] if j else words
            fits = left[: len(part)] > j
            step = mix(part + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF))
            rolled[: len(part)] += np.where(fits, step * np.uint64(2 * j + 1), np.uint64(0))
        starts = np.arange(len(words)) == np.repeat(ends - lengths, lengths)
        keep = (left >= k) | starts & (np.repeat(lengths, lengths) < k)
        return mix(rolled[keep]), rows[keep]


def shingle_counts(docs: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, times) of every distinct shingle per text, ordered by both."""
    hashes, rows = shingles(docs, k)
    if not len(hashes):
        return rows, hashes, np.zeros(0, np.int64)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])))
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(hashes)))


def bounded_batches(spark: SparkSession, limit: int = 32 << 20) -> None:
    """Arrow batches of the session end at `limit` bytes as well as at their number of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) > limit:
        spark.conf.set(key, str(limit))

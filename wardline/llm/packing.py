"""Best-fit packing by sums of squares: token sequences of whole documents with little padding.

Documents become pieces of at most `size` ids. Pieces are dealt by a hash of their key into groups of bounded
size; every group packs its own pieces, so no task sees more than a group and only a few half-full
sequences remain per group. Within a group pieces are placed longest first, ties by key. With N(g) open
sequences of free room g, a piece of length s goes where the sum of squared N becomes smallest: into a
sequence of room g it changes by 2 (N(g - s) - N(g) + 1), into a fitting one (g = s) by 1 - 2 N(s), and a
new one is opened only when none has room.

Null and empty texts hold the end id alone. Repeated rows are packed as often as they occur. Empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces
from wardline.llm.wordtokens import batch_ids

SIZE = 2048
GROUP_CHARS = 40_000_000
PIECES = "doc_id long, piece int, start long, length long, ids binary"
PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE) -> DataFrame:
    """One row per piece; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, sizes = batch_ids(b.column(1), tokenizer)
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
            sizes = sizes + 1
            n = -(-sizes // size)
            doc = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(sizes[doc] - start, size)
            cut = np.concatenate(([0], np.cumsum(length))) * 4
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                pa.BinaryArray.from_buffers(pa.binary(), len(doc), [
                    None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(ids)]),
            ], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def place(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int]]:
    """(sequence, offset) of every length, in the given order."""
    open_by_room: list[list[int]] = [[] for _ in range(size + 1)]
    count = np.zeros(size + 1, np.int64)
    sequence, offset, used = [], [], 0
    for s in lengths:
        at, room = used, size
        if s < size:
            # Change of the sum for each room from s upward; a full sequence counts for nothing.
            change = count[: size - s] - count[s:size]
            change[0] = -count[s]
            change = 2 * change + 2
            change[0] -= 1
            change[count[s:size] == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
            if count[s + best]:
                room = s + best
                at = open_by_room[room].pop()
                count[room] -= 1
        if room == size:
            used += 1
        sequence.append(at)
        offset.append(size - room)
        if room > s:
            open_by_room[room - s].append(at)
            count[room - s] += 1
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Every piece with its ids, its sequence and its place there."""
    chars = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    groups = max(1, math.ceil(chars / GROUP_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        # Sorted, so that a task that runs again after a lost executor decides alike.
        order = pa.compute.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                                               ("ids", "ascending")])
        sequence, offset = place(rows["length"].take(order).to_pylist(), size)
        back = np.empty(len(order), np.int64)
        back[order.to_numpy()] = np.arange(len(order))
        first = TaskContext.get().partitionId() << 40
        rows = rows.append_column("sequence_id", pa.array((np.array(sequence, np.int64) + first)[back]))
        rows = rows.append_column("offset", pa.array(np.array(offset, np.int64)[back]))
        yield from pieces(iter(rows.to_batches()))

    return (cut_documents(docs, tokenizer, end_id, size)
            .repartition(groups, F.xxhash64("doc_id", "piece", "ids")).mapInArrow(run, PACKED))


def with_crc(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")

"""Token ids as a canonical, length-limited Huffman file: encode texts, write blocks, read them back.

File format, two Parquet folders under one path:
  header  one row per id in use: id, n (its global count), bits (its code length)
  blocks  one row per block, in files by ascending start: start (ids before the block), doc_id[],
          n_tokens[] and first_bit[] per document, checkpoints[] (bit offset of every CHECK-th id of
          every document), payload. Each document begins at a byte, so a block needs no other block and
          any document or checkpoint can be read alone.

Documents are in ascending doc_id order (null first, repeated ids by their ids' bytes). Null and empty texts
keep their place and hold the end id alone. An empty table gives an empty file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import pieces
from wardline.llm.wordtokens import batch_ids
from wardline.session import materialise, new_path

MAX_BITS = 18
CHECK = 1024
BLOCK_BYTES = 1 << 20
RANGE_TOKENS = 8_000_000
BLOCKS = ("start long, doc_id array<long>, n_tokens array<int>, first_bit array<long>,"
          " checkpoints array<long>, payload binary")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 16-bit where every id fits, else 32-bit)."""
    from tokenizers import Tokenizer

    width = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, sizes = batch_ids(b.column(1), tokenizer)
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id).astype(width)
            sizes = sizes + 1
            cut = np.concatenate(([0], np.cumsum(sizes))) * ids.itemsize
            values = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(sizes), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes), values.cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary")


def _width(ids: pa.Array, sizes: pa.Array) -> str:
    total = pc.sum(pc.binary_length(ids)).as_py() or 0
    return "<u2" if total == 2 * (pc.sum(sizes).as_py() or 0) else "<u4"


def _joined(column: pa.Array, width: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), width)


def id_counts(encoded: DataFrame) -> DataFrame:
    """id, n over all documents; every task sums its own rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in pieces(batches):
            n = np.bincount(_joined(b.column(1), _width(b.column(1), b.column(0))))
            if len(n) > len(total):
                total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
            total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return (encoded.select("n_tokens", "ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most max_bits by package-merge.

    Each round pairs the cheapest items of the round before and merges the pairs with the leaves; a
    leaf's length is the number of rounds that take it, and each round takes its cheapest leaves.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    rounds, items = [], leaves
    leaf = np.ones(n, bool)
    for _ in range(max_bits):
        rounds.append(leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, pairs))
        at = np.argsort(both, kind="stable")
        items, leaf = both[at], at < n
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(rounds):
        chosen = int(leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The code of each id: counted up in the order of (length, id)."""
    codes, code, last = np.zeros(len(ids), np.uint64), 0, 0
    for i in np.lexsort((ids, bits)).tolist():
        code <<= int(bits[i]) - last
        last = int(bits[i])
        codes[i] = code
        code += 1
    return codes


def encode_batch(ids: np.ndarray, sizes: np.ndarray, code: np.ndarray, bits: np.ndarray):
    """(bytes, byte offset of each document, checkpoints relative to its document, their number)."""
    width = bits[ids].astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(width)))
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    doc_bits = np.diff(ends[firsts])
    doc_at = np.concatenate(([0], np.cumsum((doc_bits + 7) >> 3)))
    inside = ends[:-1] - np.repeat(ends[firsts[:-1]], sizes)
    pos = inside + np.repeat(doc_at[:-1] * 8, sizes)
    value = code[ids] << (64 - width - (pos & 31)).astype(np.uint64)
    word = pos >> 5
    total = (int(doc_at[-1]) + 3 >> 2) + 1
    words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), total)
    words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total + 1)[:total]
    data = words.astype(np.uint64).astype(">u4").tobytes()[: int(doc_at[-1])]
    rank = np.arange(len(ids)) - np.repeat(firsts[:-1], sizes)
    marks = inside[rank % CHECK == 0]
    return data, doc_at, marks, (sizes + CHECK - 1) // CHECK


def decode_batch(data: bytes, first: np.ndarray, count: np.ndarray, symbol: np.ndarray, length: np.ndarray,
                 max_bits: int) -> np.ndarray:
    """Ids of all runs that begin at bit `first` and hold `count` ids, one after another.

    All runs go forward together, one table look-up a step; a run is a stretch between checkpoints.
    """
    raw = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]) if len(raw) > 3 else raw
    order = np.argsort(-count, kind="stable")
    pos, left, out_at = first[order].copy(), count[order], (np.cumsum(count) - count)[order]
    out = np.empty(int(count.sum()), np.uint32)
    active = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), "right")
    for step, n in enumerate(active.tolist()):
        p = pos[:n]
        x = window[p >> 3] >> (32 - max_bits - (p & 7)).astype(np.uint32) & np.uint32((1 << max_bits) - 1)
        out[out_at[:n] + step] = symbol[x]
        p += length[x]
    return out


def tables(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """symbol and length for every possible next max_bits bits."""
    top = int(bits.max()) if len(bits) else 1
    symbol, length = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.int64)
    order = np.lexsort((ids, bits))
    span = 1 << (top - bits[order])
    used = int(span.sum())
    symbol[:used] = np.repeat(ids[order], span)
    length[:used] = np.repeat(bits[order], span)
    return symbol, length, top


def _range_bounds(encoded: DataFrame, tokens: int) -> list[int]:
    """doc_ids that cut the table into ranges of about RANGE_TOKENS ids."""
    wanted = -(-tokens // RANGE_TOKENS)
    if wanted < 2:
        return []
    at = [i / wanted for i in range(1, wanted)]
    found = encoded.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * wanted)).alias("at")).first()["at"]
    return sorted(set(found or []))


def _range_totals(encoded: DataFrame, bounds: list[int]) -> list[int]:
    """Ids per range; one row per range reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            np.add.at(total, _ranges(b.column(0), bounds), b.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["range", "n"])

    rows = (encoded.select("doc_id", "n_tokens").mapInArrow(run, "range long, n long")
            .groupBy("range").agg(F.sum("n").alias("n")).collect())
    total = [0] * (len(bounds) + 1)
    for r in rows:
        total[r["range"]] = r["n"]
    return total


def _ranges(ids: pa.Array, bounds: list[int]) -> np.ndarray:
    known = pc.fill_null(ids, -(1 << 63)).to_numpy(zero_copy_only=False)
    return np.searchsorted(np.array(bounds, np.int64), known, "right")


def write_file(encoded: DataFrame, path: str, max_bits: int = MAX_BITS) -> None:
    """Write the ids of `token_ids` (stored, as it is read several times) in the file format."""
    spark = encoded.sparkSession
    counts = id_counts(encoded).toPandas().sort_values("id")  # at most one row per id of the vocabulary
    ids, n = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    bits = code_lengths(n, max_bits)
    code = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint64)
    width = np.zeros(len(code), np.uint8)
    code[ids], width[ids] = canonical_codes(ids, bits), bits
    rows = list(zip(ids.tolist(), n.tolist(), bits.tolist()))
    spark.createDataFrame(rows, "id long, n long, bits int").coalesce(1).write.parquet(f"{path}/header")
    bounds = _range_bounds(encoded, int(n.sum()))
    before = np.concatenate(([0], np.cumsum(_range_totals(encoded, bounds)))).tolist()
    tables_sent = spark.sparkContext.broadcast((code, width))  # one entry per id of the vocabulary

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, width = tables_sent.value
        for b in pieces(batches):
            sizes = b.column(1).to_numpy(zero_copy_only=False)
            flat = _joined(b.column(2), _width(b.column(2), b.column(1)))
            data, at, marks, n_marks = encode_batch(flat, sizes, code, width)
            cut = np.concatenate(([0], np.cumsum(n_marks))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(_ranges(b.column(0), bounds), pa.int32()), b.column(0), b.column(1),
                pa.ListArray.from_arrays(cut, pa.array(marks)),
                pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [
                    None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]),
            ], ["range", "doc_id", "n_tokens", "marks", "payload"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, held, size = None, [], 0
        schema = pa.schema([("start", pa.int64()), ("doc_id", pa.list_(pa.int64())),
                            ("n_tokens", pa.list_(pa.int32())), ("first_bit", pa.list_(pa.int64())),
                            ("checkpoints", pa.list_(pa.int64())), ("payload", pa.binary())])

        def block():
            nonlocal start, held, size
            at = (np.cumsum([0] + [len(h[3]) for h in held])[:-1] * 8).tolist()
            row = [[start], [[h[0] for h in held]], [[h[1] for h in held]], [at],
                   [[a + m for a, h in zip(at, held) for m in h[2]]], [b"".join(h[3] for h in held)]]
            start, held, size = start + sum(h[1] for h in held), [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema)], schema=schema)

        at_range = None
        for b in pieces(batches):
            for r, *doc in zip(*(c.to_pylist() for c in b.columns)):
                if r != at_range:
                    if held:
                        yield block()
                    start, at_range = before[r], r
                held.append(doc)
                size += len(doc[3])
                if size >= BLOCK_BYTES:
                    yield block()
        if held:
            yield block()

    (encoded.select("doc_id", "n_tokens", "ids")
     .mapInArrow(compress, "range int, doc_id long, n_tokens long, marks array<long>, payload binary")
     .repartitionById(len(bounds) + 1, "range")
     .sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "payload")
     .mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document of the file."""
    header = spark.read.schema("id long, n long, bits int").parquet(f"{path}/header").toPandas()
    known = tables(header["id"].to_numpy(np.int64), header["bits"].to_numpy(np.int64))
    sent = spark.sparkContext.broadcast(known)  # at most 2 ** MAX_BITS entries

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, length, top = sent.value
        for b in pieces(batches):
            for start, doc_id, n_tokens, _, marks, payload in zip(*(c.to_pylist() for c in b.columns)):
                sizes = np.array(n_tokens, np.int64)
                runs = (sizes + CHECK - 1) // CHECK
                count = np.full(int(runs.sum()), CHECK, np.int64)
                last = np.cumsum(runs) - 1
                count[last] = sizes - (runs - 1) * CHECK
                ids = decode_batch(payload, np.array(marks, np.int64), count, symbol, length, top)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_id, pa.int64()), pa.array(start + cut[:-1]), pa.array(sizes),
                    pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [
                        None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return (spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary"))


def with_crc(decoded: DataFrame) -> DataFrame:
    """ids replaced by their checksum (Spark's crc32 is unsigned)."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def huffman_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encode every document, write the file to the shared folder and give the rows read back from it."""
    spark = docs.sparkSession
    encoded = materialise(token_ids(docs, tokenizer, end_id), "token-ids", compression="zstd")
    path = new_path(spark, "huffman-file")
    write_file(encoded, path)
    return read_file(spark, path)

"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Each five-word shingle is hashed once. The hash picks one of BINS bins and competes there for the
minimum. An empty bin takes the value of the first non-empty bin in a fixed random sequence of its own,
the same for all documents. Of every bin BITS low-order bits of (value, bin) are kept. Two fingerprints
agree in a share m of bins; chance agreement 2**-BITS is corrected: (m - c) / (1 - c), at least 0.

A text of fewer than five words is one shingle; a text without words (also null) has the empty
fingerprint, which is like another empty one (1.0) and unlike all others (0.0).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bounded_batches, mix, pieces, shingles, texts

BINS = 512
BITS = 4
RANGE_CHARS = 16_000_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
          " near_edited double, near_next double")


def _minima(docs: list[str], bins: int) -> np.ndarray:
    hashes, rows = shingles(docs)
    table = np.full((len(docs), bins), EMPTY, np.uint64)
    slot = (hashes >> np.uint64(40)) % np.uint64(bins)
    np.minimum.at(table.reshape(-1), rows * bins + slot.astype(np.int64), mix(hashes) >> np.uint64(1))
    return table


def _densify(table: np.ndarray) -> None:
    """Fill empty bins in place; rows without any value stay as they are."""
    bins = table.shape[1]
    filled = table != EMPTY
    row, bin_ = np.nonzero(~filled & filled.any(1)[:, None])
    attempt = 0
    with np.errstate(over="ignore"):
        while len(row):
            attempt += 1
            key = bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)
            donor = ((mix(key) >> np.uint64(20)) % np.uint64(bins)).astype(np.int64)
            good = filled[row, donor]
            table[row[good], bin_[good]] = table[row[good], donor[good]]
            row, bin_ = row[~good], bin_[~good]


def fingerprints(docs: list[str], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(one row of small integers per text, whether the text has words)."""
    table = _minima(docs, bins)
    known = (table != EMPTY).any(1)
    _densify(table)
    with np.errstate(over="ignore"):
        salt = np.arange(bins, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        low = (mix(table ^ salt) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return low, known


def packed(low: np.ndarray, known: np.ndarray, bits: int = BITS) -> list[str]:
    """Lower-case hex of each text's bits, bin after bin."""
    each = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits:].reshape(len(low), low.shape[1] * bits)
    data = np.packbits(each, axis=1)
    return [row.tobytes().hex() if k else "" for row, k in zip(data, known)]


def unpacked(fingerprint: str, bits: int = BITS) -> np.ndarray:
    each = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(-1, bits)
    return each @ (1 << np.arange(bits)[::-1])


def likeness(a, a_known, b, b_known, bits: int = BITS) -> np.ndarray:
    """Bias-corrected estimates of the Jaccard similarity, row by row."""
    chance = 2.0**-bits
    share = (a == b).mean(axis=-1) if a.shape[-1] else np.ones(len(a))
    close = np.clip((share - chance) / (1 - chance), 0.0, 1.0)
    return np.where(a_known & b_known, close, np.where(a_known | b_known, 0.0, 1.0))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(packed(*fingerprints(texts(b.column(1)))), pa.string())],
                ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint string")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every text and its edited text (its last half replaced from the next document) with fingerprints.

    The table is cut at some of its doc_ids into ranges of bounded size. The documents at a cut travel to
    the range before it too, so each range knows the document that follows its last one; the first
    document also goes to the last range. Order: doc_id, null first; equal ids by text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.min("doc_id").alias("low"),
                    F.bool_or(F.col("doc_id").isNull()).alias("nulls")).first()
    wanted = max(1, math.ceil((seen["n"] or 0) / RANGE_CHARS))
    bounds: list[int] = []
    if wanted > 1:
        at = [i / wanted for i in range(1, wanted)]
        cuts = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * wanted)).alias("at")).first()["at"]
        bounds = sorted(set(cuts or []))
        if not seen["nulls"]:
            bounds = [b for b in bounds if b != seen["low"]]
    first = None if seen["nulls"] else seen["low"]
    cut, last = np.array(bounds, np.int64), len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids = pc.fill_null(b.column(0), -(1 << 63)).to_numpy(zero_copy_only=False)
            own = np.searchsorted(cut, ids, "right")
            at_cut = np.flatnonzero((own > 0) & (cut[np.maximum(own, 1) - 1] == ids)) if last else np.zeros(0, int)
            start = pc.is_null(b.column(0)) if first is None else pc.equal(b.column(0), first)
            start = np.flatnonzero(pc.fill_null(start, False).to_numpy(zero_copy_only=False))
            row = np.concatenate((np.arange(len(ids)), at_cut, start))
            to = np.concatenate((own, own[at_cut] - 1, np.full(len(start), last)))
            guest = np.concatenate((np.zeros(len(ids), int), np.full(len(at_cut), 1), np.full(len(start), 2)))
            moved = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int32()), pa.array(guest, pa.int32()), *moved.columns],
                ["range", "guest", "doc_id", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for the one after it; a range whose end was seen

        def results(rows):
            """rows: (range, guest, doc_id, text), each followed by its next; the last one is only a next."""
            own = [r[3] for r in rows]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, own[1:])]
            low, known = fingerprints(own)
            elow, eknown = fingerprints(edited)
            keep = np.flatnonzero([r[1] == 0 for r in rows[:-1]])
            near_edited = likeness(low[:-1], known[:-1], elow, eknown)
            near_next = likeness(low[:-1], known[:-1], low[1:], known[1:])
            mine, theirs = packed(low[:-1], known[:-1]), packed(elow, eknown)
            return pa.RecordBatch.from_arrays([
                pa.array([rows[i][2] for i in keep], pa.int64()),
                pa.array([len(own[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
                pa.array([mine[i] for i in keep], pa.string()),
                pa.array([theirs[i] for i in keep], pa.string()),
                pa.array(near_edited[keep]), pa.array(near_next[keep]),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for b in pieces(batches, 4 << 20):
            run = [held] if held else []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if run and run[-1][0] != r[0]:
                    if len(run) > 1:
                        yield results(run)
                    run = []
                if r[1] == 0:
                    run.append(r)
                elif r[0] != done and run:  # only the first guest follows the range's last document
                    yield results(run + [r])
                    run, done = [], r[0]
            if len(run) > 1:
                yield results(run)
            held = run[-1] if run else None

    return (docs.mapInArrow(deal, "range int, guest int, doc_id long, text string")
            .repartitionById(last + 1, "range")
            .sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "text")
            .mapInArrow(compare, RESULT))

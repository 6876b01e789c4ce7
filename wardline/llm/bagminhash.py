"""Near-duplicate classes by BagMinHash over the multiset of five-word shingles.

Signature. A shingle that occurs w times covers the weight range [0, w). The range is cut into octaves
[0, 1), [1, 2), [2, 4), [4, 8), ...; every (shingle, octave) has a Poisson process over time with rate
M x width, whose points carry a component and a position within the octave. A component's value is the
least time of its points at positions below w. Points come in ascending time, so a process stops as soon as
it passes the largest value that any component still has. Two texts agree in a component with a
probability equal to their weighted Jaccard similarity.

Classes. Equal texts are one node. Nodes that agree in a band of ROWS components share a bucket; pairs are
verified on the texts: sum of minima over sum of maxima of the shingle counts, at least `threshold`. Each
bucket's best connected member is verified against all others first, which joins most copies of one text.
Buckets whose members then still lie in different components are compared in blocks of bounded size: a task
holds two blocks' longer sketches, and pairs of different components whose sketches come within five
standard deviations of the threshold are verified too. Pairs within a component are never listed.

Result: one row per document row: doc_id, class_id (least doc_id of the class), class_size (rows), copies
(rows with the same text). Null texts read as empty. Texts without words are alike only if equal. A null
doc_id counts as a row; class_id is null only if all of the class are. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import bounded_batches, mix, pieces, shingle_counts, texts
from wardline.llm.components import components
from wardline.session import materialise

BANDS = 32
ROWS = 5
THRESHOLD = 0.8
SKETCH = 640
BLOCK = 2000
_GOLD = 0x9E3779B97F4A7C15


def signatures(docs: list[str], m: int = BANDS * ROWS) -> np.ndarray:
    """One row of m values per text; infinite for texts without words."""
    doc, item, weight = shingle_counts(docs)
    values = np.full((len(docs), m), np.inf)
    flat = values.reshape(-1)
    if not len(doc):
        return values
    # One process per octave that begins below the weight: 1 + ceil(log2(weight)) of them.
    octaves = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), octaves)
    octave = np.arange(len(at)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    doc, weight = doc[at], weight[at]
    low = np.where(octave > 0, 1 << np.maximum(octave - 1, 0), 0)
    width = np.where(octave > 0, low, 1)
    with np.errstate(over="ignore"):
        seed = mix(item[at] + octave.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        time, point = np.zeros(len(at)), 0
        while len(doc):
            point += 1
            draw = mix(seed + np.uint64(point * _GOLD & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * width)
            draw = mix(draw ^ np.uint64(0xA0761D6478BD642F))
            part = ((draw >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            spot = low + (draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width
            valid = spot < weight
            np.minimum.at(flat, doc[valid] * m + part[valid], time[valid])
            going = time < values.max(1)[doc]
            if not going.all():
                doc, seed, time, low, width, weight = (x[going] for x in (doc, seed, time, low, width, weight))
    return values


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key per text and band."""
    each = mix(np.ascontiguousarray(values).view(np.uint64)).reshape(len(values), bands, -1)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(_GOLD)
        for r in range(each.shape[2]):
            key = mix(key * np.uint64(3) + each[:, :, r])
    return key


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted (shingles, counts)."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (total - least)


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, its band keys (none for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4 << 20):
            all_texts = texts(b.column(1))
            known = {t: i for i, t in enumerate(dict.fromkeys(all_texts))}
            values = signatures(list(known))
            keys, some = band_keys(values).astype("<i8"), np.isfinite(values[:, 0])
            digest = [hashlib.md5(t.encode()).digest() for t in known]
            at = [known[t] for t in all_texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([digest[i] for i in at], pa.binary()),
                pa.array([keys[i].tobytes() if some[i] else b"" for i in at], pa.binary()),
            ], ["doc_id", "digest", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, keys binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8")
            node = np.repeat(b.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node)], ["key", "node"])

    return nodes.filter(F.length("keys") > 0).select("node", "keys").mapInArrow(run, "key long, node long")


def _texts(involved: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the given nodes."""
    wanted = involved.join(nodes, "node").select("node", "digest", "first_id")
    found = (docs.select("doc_id", "text", digest_of(F.col("text")).alias("digest"))
             .join(wanted, "digest").filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
             .select("node", "text"))
    # Repeated rows of a document give its text more than once.
    return materialise(found.groupBy("node").agg(F.first("text").alias("text")), "texts", "zstd")


def _verified(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are as alike as asked."""
    both = (pairs.join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
            .join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
            .select("a", "b", "text_a", "text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            left, right = b.column(2).to_pylist(), b.column(3).to_pylist()
            known = {t: i for i, t in enumerate(dict.fromkeys(left + right))}
            doc, item, count = shingle_counts(list(known))
            cut = np.searchsorted(doc, np.arange(len(known) + 1))
            bag = [(item[i:j], count[i:j]) for i, j in zip(cut, cut[1:])]
            near = np.array([overlap(bag[known[x]], bag[known[y]]) >= threshold for x, y in zip(left, right)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, "a long, b long")


def _sketches(found: DataFrame) -> DataFrame:
    """node, one byte of each of SKETCH components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20):
            low = mix(signatures(texts(b.column(1)), SKETCH).view(np.uint64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in low], pa.binary())], ["node", "sketch"])

    return found.mapInArrow(run, "node long, sketch binary")


def _close_pairs(split: DataFrame, nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components in a bucket whose sketches allow the threshold.

    split: key, node, comp, n (members of the bucket). A pair is given in the first band only that it shares.
    """
    members = split.select("node").distinct()
    facts = materialise(_sketches(found.join(members, "node", "left_semi").select("node", "text"))
                        .join(nodes.select("node", "keys"), "node"), "sketches")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = (split.select("key", "node", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
            .select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "comp")
            .join(facts, "node").select("key", "i", "j", "own", "node", "comp", "keys", "sketch"))
    # A byte agrees by chance once in 256; five standard deviations of the share at the threshold.
    least = threshold - 5 * (threshold * (1 - threshold) / SKETCH) ** 0.5

    def pairs_of(group: list) -> tuple[np.ndarray, np.ndarray]:
        key, i, j = group[0][:3]
        own = np.array([r[3] for r in group])
        node, comp = np.array([r[4] for r in group]), np.array([r[5] for r in group])
        keys = np.frombuffer(b"".join(r[6] for r in group), "<i8").reshape(len(group), -1)
        sketch = np.frombuffer(b"".join(r[7] for r in group), np.uint8).reshape(len(group), -1)
        first, second = [], []
        for x in range(len(group) - 1):
            y = x + 1 + np.flatnonzero(comp[x + 1:] != comp[x])
            y = y[(own[y] != own[x]) if i != j else slice(None)]
            if len(y):
                y = y[(sketch[y] == sketch[x]).mean(1) >= least]
            if len(y):
                y = y[keys[y, (keys[y] == keys[x]).argmax(1)] == key]
                first.append(np.full(len(y), node[x]))
                second.append(node[y])
        none = np.zeros(0, np.int64)
        return np.concatenate(first or [none]), np.concatenate(second or [none])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list = []
        for b in pieces(batches, 4 << 20):
            first, second = [], []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][:3] != r[:3]:
                    a, z = pairs_of(group)
                    first.append(a)
                    second.append(z)
                    group = []
                group.append(r)
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], ["a", "b"])
        if group:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(group)], ["a", "b"])

    return (rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
            .mapInArrow(run, "a long, b long"))


def digest_of(text: Column) -> Column:
    """The digest that stands for a text; null reads as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size, copies: one row per row of docs."""
    return classify(docs, threshold).drop("digest", "comp")


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """near_duplicates with the digest of the row's text and comp, which tells classes apart where ids do not."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    described = materialise(_described(docs), "described")
    nodes = described.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"),
                                            F.max("keys").alias("keys"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    buckets = _bands(nodes)
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(buckets.join(shared, "key"), "buckets")
    known = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = shared.join(known, "node").groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("best"))
    pairs = (shared.join(leaders, "key").select((-F.col("best.node")).alias("a"), F.col("node").alias("b"))
             .filter("a <> b").distinct())
    pairs = materialise(pairs, "pairs")
    found = _texts(known.select("node"), nodes, docs)
    links = materialise(_verified(pairs, found, threshold), "links")
    comps = components(links)

    placed = (shared.join(comps, "node", "left")
              .select("key", "n", "node", F.coalesce("comp", "node").alias("comp")))
    split = (placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
             .filter("low <> high").select("key"))
    split = materialise(placed.join(split, "key"), "split")
    more = materialise(_close_pairs(split, nodes, found, threshold), "pairs")
    more = materialise(_verified(more, found, threshold), "links")
    if not more.isEmpty():
        comps = components(links.union(more))

    classes = materialise(
        nodes.select("node", "digest", "first_id", "copies").join(comps, "node", "left")
        .withColumn("comp", F.coalesce("comp", "node")), "classes")
    sizes = classes.groupBy("comp").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = classes.join(sizes, "comp").select("digest", "comp", "class_id", "class_size", "copies")
    return described.select("doc_id", "digest").join(named, "digest").select(
        "doc_id", "class_id", "class_size", "copies", "digest", "comp")

"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word (lower case, outer punctuation off; longer chunks give overlapping stretches of SPAN
characters) between two fixed markers that both dictionaries know, so that a few bytes already tell. It is
compressed with either dictionary, and its evidence is read from a table calibrated on labelled rows: how much more often
windows of its byte length with these two compressed lengths stand in toxic than in ordinary rows (log ratio). A rarely seen
triple falls back on byte length and length under the toxic dictionary. A text is described by the TOP largest
pieces of evidence of its different windows and the log of their number, since a long text holds chance likenesses. A
logistic model over these, fitted on labelled rows, gives the
score; 0.5 is the calibrated threshold, a missed toxic row counting TOXIC_WEIGHT times a false alarm.

Training uses a sample of the labelled rows whose crc32(doc_id) mod 5 is not 0: at most SAMPLE_ROWS of each
label, chosen by a hash of the id, whatever their length. Grams, windows and lengths are counted in Spark
jobs, and counts, at most SAMPLE_WINDOWS different windows of each label, reach the driver. Half of the
sample trains the dictionaries, the other half the table and the logistic model, weighted back to the labels' true shares; in it
each of two folds is described by the other's table, so that no row is weighed by evidence of its own. The
toxic dictionary is trained on the windows that share a stretch of GRAM characters found far more often in toxic than in
ordinary rows, the ordinary one on the windows of ordinary rows.

Null and empty texts have no window and get the score of no evidence. Without labels of both kinds
there is no model, and every score is the smoothed share of toxic rows, 0.0 without labels. Repeated label
rows count once, as toxic if any says so; null labels count for nothing.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces, texts, worker_memo
from wardline.session import materialise

SAMPLE_ROWS = {1: 1500, 0: 2500}
SAMPLE_WINDOWS, COPIES = 200_000, 60  # different windows of a label, and the most copies of one
TOP = 4
FEATURES = TOP + 1
SPAN = 24
GRAM = 5
CONTRAST = 1.5  # least difference of the log shares of rows
TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 8192, 32768, 19
LONGEST = 20  # window bytes told apart
BACKOFF = 4.0  # windows that the coarser table is worth in the finer one
TOXIC_WEIGHT = 3.0
RIDGE = 0.5  # of least cost on training rows, models of 11 to 40 toxic rows tried on the rest
MEMO_WINDOWS = 400_000
_HEAD, _TAIL = "<window begins> ", " <the window ends>"
_OUTER = " .,!?;:|*$%&#\"'()[]{}<>«»„“”¡¿-_=+/\\"


Cell = tuple[int, int, int]  # byte length, compressed lengths with the toxic and the ordinary dictionary


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    evidence: dict[tuple, float] = field(default_factory=dict)  # of cells, and of (byte length, toxic length)
    weights: list[float] = field(default_factory=list)  # of the features, then the constant
    prior: float = 0.0


def windows(chunk: str) -> list[str]:
    word = chunk.lower().strip(_OUTER)
    if len(word) <= SPAN:
        return [word] if word else []
    return [word[i:i + SPAN] for i in range(0, len(word) - SPAN // 2, SPAN // 2)]


def _framed(window: str) -> bytes:
    return f"{_HEAD}{window}{_TAIL}".encode("utf-8", "surrogatepass")


def _grams(window: str) -> set[str]:
    padded = f" {window} "
    return {padded[i:i + GRAM] for i in range(max(1, len(padded) - GRAM + 1))}


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the joined samples where there are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or _framed("").ljust(8)


class Evidence(dict):
    """Window to its evidence, memoised."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(data: bytes):
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=128, dict_size=len(data), write_content_size=False, write_dict_id=False,
                write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            return zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(data), compression_params=how).compress

        self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)
        self.table = model.evidence

    def cell(self, window: str) -> Cell:
        framed = _framed(window)
        return (min(len(window.encode("utf-8", "surrogatepass")), LONGEST), len(self.toxic(framed)), len(self.ordinary(framed)))

    def __missing__(self, window: str) -> float:
        if len(self) > MEMO_WINDOWS:
            self.clear()
        cell = self.cell(window)
        value = self.table.get(cell)
        if value is None:
            value = self.table.get(cell[:2], 0.0)
        self[window] = value
        return value


def calibrate(cells: list[tuple[Cell, int, int]]) -> dict[tuple, float]:
    """Evidence from how many windows of ordinary and of toxic rows (n0, n1) fall into each cell."""
    coarse: dict[tuple, list[int]] = {}
    for cell, n0, n1 in cells:
        sums = coarse.setdefault(cell[:2], [0, 0])
        sums[0] += n0
        sums[1] += n1
    base = (sum(n1 for _, _, n1 in cells) + 1) / (sum(n0 for _, n0, _ in cells) + 1)
    odds = {key: (n1 + base) / (n0 + 1) for key, (n0, n1) in coarse.items()}
    out: dict[tuple, float] = {key: math.log(r / base) for key, r in odds.items()}
    for cell, n0, n1 in cells:
        r = odds[cell[:2]]
        out[cell] = math.log((n1 + BACKOFF * r / (1 + r)) / (n0 + BACKOFF / (1 + r)) / base)
    return out


def features(column: pa.Array, evidence: Evidence) -> np.ndarray:
    """The TOP largest positive pieces of evidence of each text's different windows, zero where there are fewer, and the
    log of one more than the number of these windows."""
    split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    coded = split.flatten().dictionary_encode()
    number: dict[str, int] = {}  # of each different window
    of_chunk, n_windows = [], []
    for chunk in coded.dictionary.to_pylist():
        found = [number.setdefault(w, len(number)) for w in windows(chunk)]
        of_chunk.extend(found)
        n_windows.append(len(found))
    value = np.fromiter((evidence[w] for w in number), np.float64, len(number))
    size = np.array(n_windows, np.int64)
    begin = np.cumsum(size) - size
    at = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(column)), np.diff(split.offsets.to_numpy()))
    doc, sizes = np.repeat(doc, size[at]), size[at]
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    window = np.array(of_chunk, np.int64)[np.repeat(begin[at], sizes) + inside] if len(doc) else doc
    key = np.unique(doc * max(1, len(number)) + window)
    doc, window = key // max(1, len(number)), key % max(1, len(number))
    out = np.zeros((len(column), FEATURES))
    out[:, TOP] = np.log1p(np.bincount(doc, minlength=len(column)))
    good = value[window] > 0 if len(key) else np.zeros(0, bool)
    doc, best = doc[good], value[window[good]] if len(key) else np.zeros(0)
    order = np.lexsort((-best, doc))
    doc, best = doc[order], best[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    out[doc[rank < TOP], rank[rank < TOP]] = best[rank < TOP]
    return out


def scores(described: np.ndarray, weights: list[float]) -> np.ndarray:
    z = described @ np.array(weights[:FEATURES]) + weights[FEATURES]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[float]:
    """Weighted, ridged logistic regression by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = w * (len(w) / w.sum())  # labels weigh by their shares, the ridge by the number of rows seen
    ridge = np.diag([RIDGE] * FEATURES + [0.01])
    beta = np.zeros(FEATURES + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (p - y)) + ridge @ beta
        curve = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """Train from a bounded sample of the labelled training rows; their texts stay in the executors."""
    marked = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, rows in SAMPLE_ROWS.items():
        part = marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.union(part)
    # At most sum(SAMPLE_ROWS) ids, so they can be sent to every task.
    ids = picked.collect()
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    known = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(small, "doc_id").dropDuplicates(["doc_id", "text"]), "training")
    found = known.groupBy("doc_id", "toxic").agg(F.count("*").alias("n")).collect()
    n = Counter()
    for r in found:
        n[r["toxic"]] += r["n"]
    shares = {y: total.get(y, 0) / max(1, n[y]) for y in n}
    prior = (n[1] * shares.get(1, 1) + 0.5) / (sum(n[y] * shares[y] for y in n) + 1) if found else 0.0
    if not n[0] or not n[1]:
        return Model(b"", b"", prior=prior)
    # Every other document of each label is left to the calibration, where there are enough of them.
    of_label = {y: sorted((zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]) for r in found if r["toxic"] == y) for y in (0, 1)}
    held = {d for y in (0, 1) if len(of_label[y]) >= 6 for _, d in of_label[y][1::2]}
    fit_on = known.filter(F.col("doc_id").isin(sorted(held)))
    learn = known.filter(~F.col("doc_id").isin(sorted(held)))
    if len({y for y in (0, 1) for _, d in of_label[y] if d in held}) < 2:
        fit_on = learn
    model = Model(*_dictionaries(learn), prior=prior)
    # Two folds by turns of each label: a row is described by evidence that its own windows did not enter.
    turns = {y: [d for _, d in of_label[y] if not held or fit_on is learn or d in held] for y in (0, 1)}
    first = F.col("doc_id").isin(sorted(d for y in (0, 1) for d in turns[y][::2]))
    folds = [fit_on.filter(first), fit_on.filter(~first)]
    cells = [_cells(rows, model) for rows in folds]
    model.evidence = calibrate(_summed(*cells))
    halves = zip(folds, reversed(cells)) if min(map(len, turns.values())) > 1 else [(fit_on, _summed(*cells))]
    fit = sorted(r for rows, other in halves
                 for r in described_by(rows, replace(model, evidence=calibrate(other))).collect())
    x, y = np.array([r[1:] for r in fit]), np.array([r[0] for r in fit])
    model.weights = _logistic(x, y, np.array([shares[int(v)] * (TOXIC_WEIGHT if v else 1.0) for v in y]))
    return model


def _summed(*counts: list[tuple[Cell, int, int]]) -> list[tuple[Cell, int, int]]:
    sums: dict[Cell, list[int]] = {}
    for cell, n0, n1 in itertools.chain(*counts):
        both = sums.setdefault(cell, [0, 0])
        both[0] += n0
        both[1] += n1
    return [(cell, n0, n1) for cell, (n0, n1) in sorted(sums.items())]


def _cells(rows: DataFrame, model: Model) -> list[tuple[Cell, int, int]]:
    """(cell, n0, n1): rows' different windows in each cell, by label; at most LONGEST times the pairs of compressed
    lengths of a window, which are bounded by SPAN."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model)
        cell = functools.lru_cache(MEMO_WINDOWS)(evidence.cell)
        for b in pieces(batches):
            sums: Counter = Counter()
            for text, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                sums.update((*cell(w), y) for w in {w for chunk in text.split() for w in windows(chunk)})
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], pa.int32()) for i in range(4)] + [pa.array([sums[k] for k in keys], pa.int64())],
                ["size", "toxic_size", "ordinary_size", "toxic", "n"])

    counted = rows.select("text", "toxic").mapInArrow(run, "size int, toxic_size int, ordinary_size int, toxic int, n long")
    summed = counted.groupBy("size", "toxic_size", "ordinary_size").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"))
    return sorted(((r[0], r[1], r[2]), r["n0"], r["n1"]) for r in summed.collect())


def _counted(learn: DataFrame, of: Callable[[Counter], dict[str, int]], name: str) -> DataFrame:
    """name, n0, n1: what `of` counts in the windows of the rows of each label, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sums = {0: Counter(), 1: Counter()}
            for text, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                sums[y].update(of(Counter(w for chunk in text.split() for w in windows(chunk))))
            keys = [(y, k, v) for y in (0, 1) for k, v in sums[y].items()]
            yield pa.RecordBatch.from_arrays([
                pa.array([k.encode("utf-8", "surrogatepass") for _, k, _ in keys], pa.binary()),
                pa.array([v if y == 0 else 0 for y, _, v in keys], pa.int64()),
                pa.array([v if y == 1 else 0 for y, _, v in keys], pa.int64())], [name, "n0", "n1"])

    return (learn.select("text", "toxic").mapInArrow(run, f"{name} binary, n0 long, n1 long")
            .groupBy(name).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def _dictionaries(learn: DataFrame) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, from counts over all learning rows."""
    rows = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    contrast = F.log((F.col("n1") + 0.5) / (rows[1] + 1)) - F.log((F.col("n0") + 0.5) / (rows[0] + 1))
    grams = _counted(learn, lambda bag: dict.fromkeys(set().union(*map(_grams, bag)), 1), "gram")
    telling = {bytes(r["gram"]).decode("utf-8", "surrogatepass") for r in grams.filter(
        (F.col("n1") >= min(4, max(2, rows[1] // 4))) & (contrast > CONTRAST)).select("gram").collect()}
    toxic = _counted(learn.filter("toxic = 1"), lambda bag: {
        w: k for w, k in bag.items() if not telling or _grams(w) & telling}, "window").select("window", F.col("n1").alias("n"))
    ordinary = _counted(learn.filter("toxic = 0"), dict, "window").select("window", F.col("n0").alias("n"))
    return _dictionary(_samples(toxic), TOXIC_BYTES), _dictionary(_samples(ordinary), ORDINARY_BYTES)


def _samples(counts: DataFrame) -> list[bytes]:
    """Windows as often as counted, at most COPIES times each, the frequent ones before the rare."""
    most = counts.orderBy(F.col("n").desc(), "window").limit(SAMPLE_WINDOWS).collect()
    framed = [(zlib.crc32(bytes(r["window"]) + b"%d" % i), _framed(bytes(r["window"]).decode("utf-8", "surrogatepass")))
              for r in most for i in range(min(r["n"], COPIES))]
    return [w for _, w in sorted(framed)]


def described_by(rows: DataFrame, model: Model) -> DataFrame:
    """toxic and the features of every row."""
    names = [f"d{i}" for i in range(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model)
        for b in pieces(batches):
            x = features(b.column(0), evidence)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x[:, i]) for i in range(FEATURES))], ["toxic", *names])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, " + ", ".join(f"{n} double" for n in names))


def _scorer(model: Model) -> Callable[[pa.Array], np.ndarray]:
    """The scores of a column of texts; to be called in a worker."""
    if not model.weights:
        return lambda column: np.full(len(column), model.prior)
    mark = zlib.crc32(model.toxic + model.ordinary)
    held = worker_memo("toxicity", dict)
    if mark not in held:
        held.clear()
        held[mark] = Evidence(model)
    return lambda column: scores(features(column, held[mark]), model.weights)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs scored under 0.5, whole."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(model)
        for b in pieces(batches):
            yield b.filter(pa.array(score(b.column(at).cast(pa.string())) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def with_verdict(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))

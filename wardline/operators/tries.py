"""PIN entries of requests under review, decided in one ordered pass per supervisor.

A supervisor's counter c rises with each wrong PIN, is cleared by a correct one, and locks the account at MAX. A request
may enter MAX - c PINs, c being the counter at its first entry; what another request's success gives
back does not give it more. An entry beyond that, or after the request's own success, never happens.

Entries count in the order (time, request, attempt number, wrong before right, digest of the PIN). An entry without a time
comes before all that have one. Rows equal in all of these are one entry delivered again and count once.

Plain supervisors are walked row by row, streamed from a sorted partition. A supervisor with more than
max_key_rows entries is cut by time into pieces that run side by side:

* After a certain success the counter is 0 whatever came before, so from there on a piece settles its rows by itself.
* Rows whose fate hangs on an earlier piece (those before its first certain success, and those around a
  request that began earlier) stay open, with the counter they start from where it is known.
* Open rows, a few per request that spans a cut, are then walked in order per supervisor.

The first lock over all rows ends the account, so whatever a piece settled after it counts nothing. The number of
jobs does not depend on the entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline import policy
from wardline.operators.ordered import MAX_KEY_ROWS
from wardline.operators.ratelimit import micros
from wardline.session import materialise

MAX = policy.MAX_FAILED_ATTEMPTS
NO_TIME = -(2**63)
PLACE = ["us", "request_id", "attempt_no", "ok", "digest"]
_ENTRY = ("supervisor_id string, us long, request_id string, attempt_no int, ok boolean, digest string, no int, n int, "
          "start int, shut boolean, first int")
_INPUT = [c.split()[0] for c in _ENTRY.split(", ")] + ["piece"]
_SETTLED = _ENTRY + ", failed_after int, happens boolean, locks boolean, open boolean, mark int"
_OPEN, _NEVER = object(), object()
_OUT_ROWS = 10_000


def numbered(entries: DataFrame) -> DataFrame:
    """Entries that may happen, with no (1-based position in the request) and n (the last one's): repeats, what
    follows a success of the request, and more than MAX are left out.

    entries: supervisor_id, request_id, attempt_no, ts, ok, digest and, per request, used (entries in earlier epochs).
    """
    once = (entries.withColumn("us", F.coalesce(micros(), F.lit(NO_TIME))).drop("ts")
            .withColumn("attempt_no", F.col("attempt_no").cast("int")).dropDuplicates(["request_id", *PLACE]))
    by_request = Window.partitionBy("request_id")
    in_order = by_request.orderBy("us", "attempt_no", "ok", "digest")
    few = (once.withColumn("no", F.row_number().over(in_order)).filter(F.col("no") <= MAX)
           .withColumn("no", F.col("no") + F.col("used")).filter(F.col("no") <= MAX))
    before = by_request.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return (few.withColumn("_won", F.coalesce(F.max("ok").over(before), F.lit(False))).filter(~F.col("_won")).drop("_won")
            .withColumn("n", F.max("no").over(by_request).cast("int")))


class _Piece:
    """Walks a piece's rows in order; yields (row, failed_after, locks) with _OPEN or _NEVER in place of the
    counter where it is not settled or the entry never happens, and (row, counter) marks."""

    def __init__(self, start: int, shut: bool, known: bool):
        self.c: int | None = start if known else None
        self.shut, self.locked = shut, False
        self.firsts: dict[str, int] = {}  # counter at the first entry of requests that have more to come
        self.segment: list[tuple] = []  # since the last certain success; may still turn open
        self.begun: list[str] = []  # requests begun in it
        self.since = None  # that success

    def step(self, row: dict) -> Iterator[tuple]:
        if self.shut or self.locked:
            yield row, None, False
            return
        request, no, more = row["request_id"], row["no"], row["no"] < row["n"]
        first = self.firsts.get(request, row["first"])
        if no > 1 and not more:
            self.firsts.pop(request, None)
        if no > 1 and first is None:
            yield from self._turn_open()
            yield row, _OPEN, False
        elif no > 1 and no > MAX - first:
            self.segment.append((row, _NEVER, False))
        elif row["ok"]:
            yield from self._settle()
            self.c, self.since = 0, row
            yield row, 0, False
        elif self.c is None:
            yield row, _OPEN, False
        else:
            if no == 1 and more:
                self.firsts[request] = self.c
                self.begun.append(request)
            self.c += 1
            self.segment.append((row, self.c, self.c >= MAX))
            if self.c >= MAX:
                self.locked = True
                yield from self._settle()

    def _settle(self) -> Iterator[tuple]:
        yield from self.segment
        self.segment, self.begun = [], []

    def _turn_open(self) -> Iterator[tuple]:
        if self.c is not None and self.since is not None:
            yield self.since, 0
        for row, _, _ in self.segment:
            yield row, _OPEN, False
        for request in self.begun:
            self.firsts.pop(request, None)
        self.segment, self.begun, self.c = [], [], None

    def end(self, last: dict) -> Iterator[tuple]:
        yield from self._settle()
        if self.c is not None and not self.locked and not self.shut:
            yield last, self.c


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield dict(zip(names, values, strict=True))


def _collected(found: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def batch(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], t) for n, t in zip(names, types, strict=True)], names)

    held = []
    for row in found:
        held.append(row)
        if len(held) == _OUT_ROWS:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def _verdict(out: tuple) -> dict:
    row, value = out[0], out[1]
    if len(out) == 2:
        return row | {"failed_after": value, "happens": False, "locks": False, "open": True, "mark": 1}
    return row | {"failed_after": value if isinstance(value, int) else None, "happens": value is not _NEVER, "locks": out[2],
                  "open": value is _OPEN, "mark": 0}


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (supervisor, piece, place)."""
    def walk() -> Iterator[dict]:
        key, piece, last = None, None, None
        for row in _rows(batches):
            of = (row["supervisor_id"], row["piece"])
            if of != key:
                if piece:
                    yield from map(_verdict, piece.end(last))
                key, piece = of, _Piece(row["start"], row["shut"], row["piece"] == 0)
            yield from map(_verdict, piece.step(row))
            last = row
        if piece:
            yield from map(_verdict, piece.end(last))

    yield from _collected(walk(), _SETTLED)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open rows and marks of all pieces, sorted by (supervisor, place, mark). first: the counter at the request's
    first entry where a piece or an earlier epoch settled it."""
    def walk() -> Iterator[dict]:
        supervisor, c, firsts = None, 0, {}
        for row in _rows(batches):
            if row["supervisor_id"] != supervisor:
                supervisor, c, firsts = row["supervisor_id"], row["start"], {}
            if row["mark"]:
                c = row["failed_after"]
                continue
            no, request = row["no"], row["request_id"]
            if no == 1:
                if row["n"] > 1:
                    firsts[request] = c
                first = c
            else:
                kept = firsts.pop(request, None) if no == row["n"] else firsts.get(request)
                first = row["first"] if row["first"] is not None else kept
            row["happens"] = no == 1 or first is None or no <= MAX - first
            if row["happens"] and c < MAX:
                c = 0 if row["ok"] else c + 1
                row["failed_after"], row["locks"] = c, c >= MAX
            row["open"] = False
            yield row

    yield from _collected(walk(), _SETTLED)


def _pieces(rows: DataFrame, max_key_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of plain supervisors in piece 0, rows of hot ones in pieces by time or None)."""
    sizes = rows.groupBy("supervisor_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > max_key_rows)
    found = sizes.collect()  # at most rows / max_key_rows keys
    if not found:
        return rows.withColumn("piece", F.lit(0)), None
    hot = rows.sparkSession.createDataFrame(found, sizes.schema).select("supervisor_id")
    n = 2 * -(-sum(r["_n"] for r in found) // max_key_rows)
    spread = (rows.join(hot, "supervisor_id", "left_semi").repartitionByRange(n, "supervisor_id", *PLACE)
              .withColumn("_part", F.spark_partition_id()))
    spread = materialise(spread, "pieces")  # the number depends on sampled bounds: fix it before it is used
    first = spread.groupBy("supervisor_id").agg(F.min("_part").alias("_first"))
    cut = spread.join(F.broadcast(first), "supervisor_id").withColumn("piece", F.col("_part") - F.col("_first")).drop("_part", "_first")
    return rows.join(hot, "supervisor_id", "left_anti").withColumn("piece", F.lit(0)), cut


def played(entries: DataFrame, supervisors: DataFrame, at_most: int, max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """Entries that happen, with the counter they leave behind, in the columns of the lockout operator plus position.

    entries: supervisor_id, request_id, attempt_no, ts, ok, digest, and where requests began in an earlier epoch used
    and first (entries so far, and the counter at the first). supervisors: the snapshot with failed_attempts and
    is_locked. at_most: a bound on the number of entries, so that a small table needs no count per supervisor. seq
    orders a supervisor's rows. Rows after the lock stay, not counted.
    """
    seed = supervisors.select(
        "supervisor_id", F.coalesce("failed_attempts", F.lit(0)).cast("int").alias("start"),
        (F.coalesce("is_locked", F.lit(False)) | (F.coalesce("failed_attempts", F.lit(0)) >= MAX)).alias("shut"))
    for name, value in (("used", 0), ("first", None)):
        if name not in entries.columns:
            entries = entries.withColumn(name, F.lit(value).cast("int"))
    rows = numbered(entries).join(seed, "supervisor_id").select(*_INPUT[:-1])
    plain, hot = rows.withColumn("piece", F.lit(0)), None
    if at_most > max_key_rows:
        plain, hot = _pieces(materialise(rows, "entries"), max_key_rows)
    order = ["supervisor_id", "piece", *PLACE]
    settled = plain.repartition("supervisor_id").sortWithinPartitions(*order).select(_INPUT).mapInArrow(_settle, _SETTLED)
    if hot is not None:
        cut = materialise(hot.repartition("supervisor_id", "piece").sortWithinPartitions(*order).select(_INPUT)
                          .mapInArrow(_settle, _SETTLED), "settled")
        begun = cut.filter("NOT open AND no = 1 AND NOT ok AND failed_after IS NOT NULL").select(
            "request_id", (F.col("failed_after") - 1).alias("_begun"))
        walked = (cut.filter("open").join(begun, "request_id", "left").withColumn("first", F.coalesce("first", "_begun"))
                  .drop("_begun").repartition("supervisor_id")
                  .sortWithinPartitions("supervisor_id", *PLACE, "mark").mapInArrow(_resolve, _SETTLED))
        settled = settled.unionByName(cut.filter("NOT open")).unionByName(walked)
    settled = materialise(settled.filter("mark = 0").drop("mark", "open", "start", "n", "first"), "played")
    place = F.struct(*PLACE)
    ends = settled.filter("locks").groupBy("supervisor_id").agg(F.min(place).alias("lock_at"))
    after = F.col("lock_at").isNotNull() & (place > F.col("lock_at"))
    return (settled.join(ends, "supervisor_id", "left").withColumn("_after", after)
            .filter(F.col("happens") | F.col("_after"))
            .withColumn("counted", ~F.col("shut") & ~F.col("_after"))
            .withColumn("failed_after", F.when(F.col("counted"), F.col("failed_after").cast("long")))
            .select("supervisor_id", "request_id", "attempt_no",
                    F.when(F.col("us") != NO_TIME, F.timestamp_micros("us")).alias("ts"), "ok", "failed_after",
                    (MAX - F.col("failed_after")).alias("remaining"),
                    (F.col("counted") & F.coalesce(place == F.col("lock_at"), F.lit(False))).alias("locks"), "counted",
                    place.alias("seq"), F.col("no").cast("long").alias("position")))

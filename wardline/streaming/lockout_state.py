"""The lockout counters as keyed state: PIN results of a bucket of supervisors wait for their time and are applied in order."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from wardline import policy
from wardline.operators.ratelimit import micros

STORE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BUCKETS = 2048  # keys of the state; a checkpoint holds for this number only
_RESULT = ("supervisor_id", "us", "request_id", "attempt_no", "ok")
_OUT = ("supervisor_id string, request_id string, attempt_no int, us long, ok boolean, failed_after long, locks boolean, "
        "counted boolean, late boolean")


class Accounts(StatefulProcessor):
    """State of a bucket of supervisors: each one's counter with the place of the result applied last, and the results that wait.

    The counters of a bucket are one value, and the waiting results that came together one entry, both as JSON: a call of the
    state store and every row of it cost far more than the text. One timer stands at the first waiting result, and when the
    clock has passed it, all waiting ones before the clock are applied by (supervisor, time, request, attempt number). An id that
    no supervisor holds, a locked account or a full counter counts nothing.
    """

    def __init__(self, about: list[str], max_failed: int = policy.MAX_FAILED_ATTEMPTS):
        self.names, self.max_failed = [*_RESULT, *about], max_failed
        self.about = about
        # read here, as a worker has no session to read it with
        self.texts = StructType.fromDDL("rows string")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accounts = handle.getValueState("accounts", self.texts)
        self.waiting = handle.getListState("waiting", self.texts)

    def _known(self) -> dict[str | None, tuple]:
        """supervisor_id -> (supervisor_id, failed, shut, locked, us, request_id, attempt_no)."""
        text = self.accounts.get()
        return {at[0]: tuple(at) for at in json.loads(text[0])} if text else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, before, wait = None, 0, []
        for r in rows:
            if r.request_id is None:
                continue
            if known is None:
                known = self._known()
                before = len(known)
            at = known.get(r.supervisor_id)
            if at is None:
                at = known[r.supervisor_id] = (r.supervisor_id, r.failed_before, r.shut, False, None, None, None)
            if r.us is None or at[4] is not None and (r.us, r.request_id, r.attempt_no) < at[4:7]:
                yield self._out(r, None, False, False, True)
                continue
            wait.append([r[c] for c in self.names])
        if known and len(known) > before:
            self.accounts.update((json.dumps(list(known.values())),))
        if wait:
            self.waiting.appendValue((json.dumps(wait),))
            self.handle.registerTimer(min(r[1] for r in wait) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        due, later = [], []
        for (text,) in self.waiting.get():
            for r in json.loads(text):
                (due if r[1] // 1000 <= until else later).append(r)
        if not due:
            return
        known = self._known()
        due.sort(key=lambda r: (r[0] or "", *r[1:5]))
        as_row = Row(*self.names)
        for r in map(lambda r: as_row(*r), due):
            _, failed, shut, locked, *_ = known[r.supervisor_id]
            if shut or locked:
                yield self._out(r, None, False, False, False)
            else:
                failed = 0 if r.ok else failed + 1
                locked = failed >= self.max_failed
                yield self._out(r, failed, locked, True, False)
            known[r.supervisor_id] = (r.supervisor_id, failed, shut, locked, r.us, r.request_id, r.attempt_no)
        self.accounts.update((json.dumps(list(known.values())),))
        if later:
            self.waiting.put([(json.dumps(later),)])
            self.handle.registerTimer(min(r[1] for r in later) // 1000)
        else:
            self.waiting.clear()

    def _out(self, r, failed, locks, counted, late) -> Row:
        return Row(supervisor_id=r.supervisor_id, request_id=r.request_id, attempt_no=r.attempt_no, us=r.us, ok=r.ok,
                   failed_after=failed, locks=locks, counted=counted, late=late, **{c: r[c] for c in self.about})

    def close(self) -> None:
        pass


def decided(pins: DataFrame, supervisors: DataFrame, about: list[str], delay: int) -> DataFrame:
    """The stream of decided results: the columns of the lockout operator, late, and user_role and query for the alert.

    The clock runs on a column that goes no further: rows behind it must reach the state, not vanish.
    """
    seed = supervisors.select(
        "supervisor_id", F.coalesce("failed_attempts", F.lit(0)).cast("int").alias("failed_before"),
        (F.coalesce("is_locked", F.lit(False)) | (F.coalesce("failed_attempts", F.lit(0)) >= policy.MAX_FAILED_ATTEMPTS)).alias("shut"))
    rows = (pins.withColumn("clock", F.col("ts")).withWatermark("clock", f"{delay} seconds").drop("clock")
            .join(seed, "supervisor_id", "left")
            .withColumn("bucket", F.pmod(F.xxhash64("supervisor_id"), F.lit(BUCKETS)))
            .select("bucket", "supervisor_id", "request_id", F.col("attempt_no").cast("int").alias("attempt_no"), micros().alias("us"), "ok",
                    F.coalesce("failed_before", F.lit(0)).alias("failed_before"), F.coalesce("shut", F.lit(True)).alias("shut"), *about))
    schema = _OUT + "".join(f", {c} string" for c in about)
    out = rows.groupBy("bucket").transformWithState(Accounts(about), StructType.fromDDL(schema), "append", "EventTime")
    told = [F.col(c) if c in about else F.lit("").alias(c) for c in ("user_role", "query")]
    return out.select("supervisor_id", "request_id", "attempt_no", F.timestamp_micros("us").alias("ts"), "ok", "failed_after",
                      (policy.MAX_FAILED_ATTEMPTS - F.col("failed_after")).alias("remaining"), "locks", "counted", "late", *told)

"""Structured Streaming forms of the controls.

Stateless controls are plain projections. The stateful ones run the batch operators on each
micro-batch, with a small state table per epoch as their history: the newest allowed attempts per
role, and the supervisor snapshot. A hot role or supervisor is therefore spread over tasks in the
stream as well, and batch and stream share one definition. Each epoch overwrites only its own
folder, so a replayed epoch after a failure leaves the same files.

Event time decides. With a delay, rows wait in a hold-back table until the clock (the newest event time seen, less the
delay) has passed them, so that arrival may be out of order by that much; rows behind the clock are late. A row
without a request id is a heartbeat: it moves the clock and decides nothing. Without a delay rows are decided as they
come, and an attempt older than what its role has already been decided for is late. Late rows go to the late table, and a
governed request among them is refused with an audit row.

The lockout is keyed state: a supervisor's PIN results wait in its state and are applied in time order by event-time timers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline import policy, schemas
from wardline.operators import audit, gate
from wardline.operators.guard import gated_guard
from wardline.operators.ratelimit import Limits, micros, rate_limit, ratelog
from wardline.plans.governed import governed_retrieval
from wardline.sources.tables import manager_contact
from wardline.streaming import lockout_state

LATE, LATE_REASON = "LATE", "Request arrived after later ones of its role had been decided."
HIGH_WATER = "user_role string, high_us long"
CLOCK = "released_us long, high_us long"


def stream_guard(requests: DataFrame) -> DataFrame:
    """Role gate, cleaning and injection scan of each arriving request."""
    return gated_guard(requests)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
        available_now: bool = True, conf: dict[str, str] | None = None):
    """Start a query that hands every micro-batch to `each`, which may read it several times. conf: settings of the query."""
    def held(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            each(batch, epoch)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(held).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    settings = stream.sparkSession.conf
    held_before = {k: settings.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        settings.set(k, v)
    try:
        return writer.start()  # a query keeps the settings it started with
    finally:
        for k, v in held_before.items():
            settings.unset(k) if v is None else settings.set(k, v)


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append-only file sink, exactly once through its checkpoint."""
    return (stream.writeStream.format("parquet").option("path", path).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _epoch(df: DataFrame, root: str, name: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")


def _state(spark: SparkSession, root: str, name: str, epoch: int, schema) -> DataFrame:
    """State left by the epoch before; empty at the start."""
    if epoch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}/epoch={epoch - 1}")


def newest_allowed(log: DataFrame, limit: int = policy.RATE_LIMIT) -> DataFrame:
    """The newest `limit` allowed rows per role: all the history a later attempt can depend on."""
    newest = Window.partitionBy("user_role").orderBy(F.desc("timestamp"), F.desc("request_id"))
    return (log.filter(~F.col("blocked")).withColumn("_n", F.row_number().over(newest))
            .filter(F.col("_n") <= limit).drop("_n"))


def _admit(batch: DataFrame, root: str, epoch: int) -> tuple[DataFrame, DataFrame]:
    """(attempts that can still be placed, late ones), and the new high-water marks written."""
    seen = _state(batch.sparkSession, root, "high_water", epoch, HIGH_WATER)
    # one row per role; the join broadcasts when it is small
    marked = batch.join(seen, "user_role", "left").withColumn(
        "late", F.coalesce(micros() < F.col("high_us"), F.lit(False)))
    now = marked.groupBy("user_role").agg(F.max(micros()).alias("high_us"))
    _epoch(seen.unionByName(now).groupBy("user_role").agg(F.max("high_us").alias("high_us")),
           root, "high_water", epoch)
    return (marked.filter(~F.col("late")).drop("late", "high_us"),
            marked.filter("late").drop("late", "high_us"))


def hold_back(batch: DataFrame, root: str, epoch: int, delay: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows whose time has come, late rows, the clock in microseconds).

    Rows at or after the clock are written to the pending table, from which the next epoch takes them on. Rows
    without a time come at once.
    """
    spark = batch.sparkSession
    before = _state(spark, root, "clock", epoch, CLOCK).first()
    least = -(2**63)
    released, high = (before.released_us, before.high_us) if before else (least, least)
    newest = batch.agg(F.max(micros()).alias("us")).first().us  # one number
    high = max(high, newest if newest is not None else least)
    clock = max(released, high - delay * 1_000_000) if high > least else released
    _epoch(spark.createDataFrame([(clock, high)], CLOCK), root, "clock", epoch)
    rows = batch.filter(F.col("request_id").isNotNull())
    is_late = F.coalesce(micros() < released, F.lit(False))
    waiting = _state(spark, root, "pending", epoch, batch.schema).unionByName(rows.filter(~is_late))
    due = F.coalesce(micros() < clock, F.lit(True))
    _epoch(waiting.filter(~due), root, "pending", epoch)
    return waiting.filter(due), rows.filter(is_late), clock


def rate_limit_stream(attempts: DataFrame, root: str, limits: Limits | None = None, delay: int | None = None):
    """request_id, user_role, ts -> rate_limit_log rows under root/ratelog, late ones under root/late.

    delay: seconds by which arrival may be out of order."""
    lim = limits or Limits()

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        on_time, late = _admit(batch, root, epoch) if delay is None else hold_back(batch, root, epoch, delay)[:2]
        prior = _state(spark, root, "allowed", epoch, schemas.RATE_LIMIT_LOG)
        _epoch(ratelog(rate_limit(on_time, prior, lim)), root, "ratelog", epoch)
        _epoch(late, root, "late", epoch)
        written = spark.read.schema(schemas.RATE_LIMIT_LOG).parquet(f"{root}/ratelog/epoch={epoch}")
        _epoch(newest_allowed(prior.unionByName(written), lim.limit), root, "allowed", epoch)

    return run(attempts, each, f"{root}/checkpoint")


def lockout_stream(pins: DataFrame, supervisors: DataFrame, managers: DataFrame, root: str,
                   fallback_contact: str = "", delay: int = 0):
    """PIN results -> decided attempts under root/attempts, alerts under root/outbox, late results under root/late, and
    the supervisor table after each epoch under root/supervisors.

    pins: supervisor_id, request_id, attempt_no, ts, ok, and optionally user_role and query for the alert. delay:
    seconds by which arrival may be out of order; a supervisor's results are held in its keyed state until the
    clock has passed them, and one that comes behind a newer applied one, or has no time, is late and counts nothing.
    """
    about = [c for c in ("user_role", "query") if c in pins.columns]

    def each(decided: DataFrame, epoch: int) -> None:
        spark = decided.sparkSession
        before = supervisors if epoch == 0 else spark.read.schema(supervisors.schema).parquet(
            f"{root}/supervisors/epoch={epoch - 1}")
        _epoch(decided.filter("NOT late").drop("late"), root, "attempts", epoch)
        _epoch(decided.filter("late").drop("late"), root, "late", epoch)
        placed = decided.filter("NOT late").withColumn("seq", F.struct("ts", "request_id", "attempt_no"))
        _epoch(gate.supervisor_state(before, placed), root, "supervisors", epoch)
        locks = (placed.filter("locks").withColumnRenamed("failed_after", "failed_attempts")
                 .join(before.select("supervisor_id", F.col("name").alias("supervisor_name")), "supervisor_id"))
        _epoch(gate.escalations(locks, manager_contact(managers, fallback_contact)), root, "outbox", epoch)

    return run(lockout_state.decided(pins, supervisors, about, delay), each, f"{root}/checkpoint",
               conf=lockout_state.STORE)


def refused_late(late: DataFrame) -> DataFrame:
    """Audit rows of requests that came too late for the limiter. Role and content controls go first."""
    judged = gated_guard(late)
    open_ = F.col("role_error").isNull() & (F.col("flag") == "")
    none = {"records_returned": "long", "top_score": "double", "gate_decision": "string", "hitl_decision": "string",
            "supervisor_id": "string"}
    return audit.build(
        judged.withColumn("block_reason", F.when(open_, LATE_REASON).otherwise(F.col("block_reason")))
        .withColumn("flag", F.when(open_, LATE).otherwise(F.col("flag")))
        .withColumns({"has_vector": F.lit(False), "triggered": F.lit(False)}
                     | {c: F.lit(None).cast(kind) for c, kind in none.items()}))


def audit_stream(requests: DataFrame, employees: DataFrame, embeddings: DataFrame,
                 supervisors: DataFrame, managers: DataFrame, attempts: DataFrame, root: str):
    """Decide requests as they arrive: root/audit has a row of every request, root/released the records
    of approved ones, root/ratelog the limiter's verdicts, root/outbox the alerts.

    Each epoch starts from the limiter history and the supervisor table the one before left behind.
    attempts: the PIN entries recorded so far for these requests.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        on_time, late = _admit(batch, root, epoch)
        prior = _state(spark, root, "allowed", epoch, schemas.RATE_LIMIT_LOG)
        before = supervisors if epoch == 0 else spark.read.schema(supervisors.schema).parquet(
            f"{root}/supervisors/epoch={epoch - 1}")
        out = governed_retrieval(on_time, employees, embeddings, before, managers, attempts, prior, check_ids=False)
        _epoch(out.audit.unionByName(refused_late(late)), root, "audit", epoch)
        _epoch(out.released, root, "released", epoch)
        _epoch(out.ratelog, root, "ratelog", epoch)
        _epoch(out.escalations, root, "outbox", epoch)
        _epoch(out.supervisors, root, "supervisors", epoch)
        _epoch(newest_allowed(prior.unionByName(out.ratelog)), root, "allowed", epoch)
        _epoch(late.drop("query_vec"), root, "late", epoch)

    return run(requests, each, f"{root}/checkpoint")

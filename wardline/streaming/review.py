"""Governed requests and the PIN entries that follow them, as two streams.

Both go through one hold-back clock. A request is guarded, limited and searched when the clock reaches it; if it needs no
second person it is decided then. Otherwise it waits, open, and PIN entries are applied to it in time order as the
clock reaches them, in the same ordered pass per supervisor as in a batch, with the counters, the open requests'
tries and the locks carried from epoch to epoch. It is decided by its success, by its supervisor's lock, by what
its first entry shows (unknown, locked, not authorised), or, when `window` seconds have passed, by default.

An entry that comes before its request waits for it as long; one for a request that is unknown, decided or past its window
goes to the late table then. So does, at once, an entry without a time, which has no place in a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import schemas
from wardline.functions import text
from wardline.operators import audit, gate, tries
from wardline.operators.guard import audited_query
from wardline.operators.ratelimit import micros, ratelog
from wardline.plans.governed import alerts, assess, limited, released_records
from wardline.session import materialise
from wardline.streaming.jobs import _epoch, _state, hold_back, newest_allowed, refused_late, run

_FACTS = ("request_id string, ts timestamp, user_role string, requester_id string, has_vector boolean, flag string, block_reason string, "
          "allowed_fields array<string>, role_error string, proceeds boolean, top_score double, records_returned long, "
          "triggered boolean, clean_query string")
OPEN = _FACTS + ", supervisor_id string, used int, first int"
HITS = "request_id string, nric string, _similarity_score double"
PINS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.PIN_ATTEMPTS.fields)
_NAMES = [c.strip().split()[0] for c in _FACTS.split(", ")]
_REVIEW = ("gate_decision", "hitl_decision")


def step(open_: DataFrame, pins: DataFrame, supervisors: DataFrame, expired) -> tuple[DataFrame, DataFrame]:
    """(open requests with their gate decision, NULL while it is out; decided entries).

    pins: entries of these requests, all later than those of earlier steps. expired: condition on the request.
    """
    named = gate.entered_ids(pins).withColumnRenamed("supervisor_id", "named")
    dim = supervisors.select("supervisor_id", "hashed_pin", "can_approve_roles", "is_locked", F.lit(True).alias("known"))
    faced = (open_.join(named, "request_id", "left")
             .withColumn("fresh", F.col("supervisor_id").isNull() & F.col("named").isNotNull())
             .withColumn("supervisor_id", F.coalesce("supervisor_id", "named")).join(dim, "supervisor_id", "left")
             .withColumn("known", F.coalesce("known", F.lit(False))).withColumn("is_locked", F.coalesce("is_locked", F.lit(False)))
             .withColumn("own", gate.requester_is_approver(F.col("requester_id"), F.col("supervisor_id")))
             .withColumn("authorised", F.col("known") & ~F.col("own") & F.coalesce(
                 gate.may_approve(F.col("can_approve_roles"), F.col("user_role")), F.lit(False))))
    faced = materialise(faced.drop("named", "can_approve_roles"), "faced")
    digest = text.pin_hash(F.col("pin"))
    entries = (pins.select("request_id", "attempt_no", "ts", digest.alias("digest"))
               .join(faced.filter("authorised").select("request_id", "supervisor_id", "hashed_pin", "used", "first"), "request_id")
               .withColumn("ok", F.coalesce(F.col("digest") == F.col("hashed_pin"), F.lit(False)))
               .withColumn("digest", F.coalesce("digest", F.lit(""))).drop("hashed_pin"))
    decided = tries.played(entries, supervisors, pins.count())
    counted = F.col("counted")
    outcome = decided.groupBy("request_id").agg(
        F.max(F.col("ok") & counted).alias("pin_ok"), F.max("locks").alias("locked_now"), F.max("position").cast("int").alias("_used"),
        F.max(F.when(counted & (F.col("position") == 1) & ~F.col("ok"), F.col("failed_after") - 1)).cast("int").alias("_first"))
    lock_at = decided.filter("locks").select("supervisor_id", F.struct(
        "seq.us", F.col("seq.request_id"), F.col("seq.attempt_no")).alias("lock_at"))
    place = F.struct(F.col("first_us").alias("us"), "request_id", F.col("first_no").cast("int").alias("attempt_no"))
    fresh, sup = F.col("fresh"), F.col("supervisor_id")

    def about(texts: tuple[str, str]):
        return F.concat(F.lit(texts[0]), sup, F.lit(texts[1]))

    locked_before = F.col("is_locked") | F.coalesce(place > F.col("lock_at"), F.lit(False))
    decision = (F.when(fresh & ~F.col("known"), about(gate.NOT_FOUND)).when(fresh & locked_before, about(gate.LOCKED))
                .when(fresh & F.col("own"), gate.OWN_REQUEST)
                .when(fresh & ~F.col("authorised"), F.concat(F.lit(gate.NOT_AUTHORISED), "user_role"))
                .when(F.coalesce("locked_now", F.lit(False)), about(gate.LOCKED_NOW))
                .when(F.coalesce("pin_ok", F.lit(False)), audit.APPROVED)
                .when(expired & sup.isNull(), gate.NO_ID).when(expired, gate.UNVERIFIED))
    out = (faced.join(lock_at, "supervisor_id", "left").join(outcome, "request_id", "left")
           .withColumn("gate_decision", decision)
           .withColumn("hitl_decision", F.when(F.col("gate_decision") == audit.APPROVED, "approve")
                       .when(F.col("gate_decision").isNotNull(), "reject"))
           .withColumn("used", F.coalesce("_used", "used")).withColumn("first", F.coalesce("first", "_first")))
    return out.select(*_NAMES, "supervisor_id", "used", "first", *_REVIEW), decided


def audit_stream(requests: DataFrame, pins: DataFrame, employees: DataFrame, embeddings: DataFrame, supervisors: DataFrame,
                 managers: DataFrame, root: str, delay: int, window: int, fallback_contact: str = ""):
    """Decide requests and apply PIN entries as they arrive: root/audit has a row of every decided request, root/released the
    records of approved ones, root/ratelog the limiter's verdicts, root/outbox the alerts, root/late what came
    too late.

    requests, pins: streams with the columns of these tables; a row without a request id is a heartbeat. delay:
    seconds by which arrival may be out of order. window: seconds that a request waits for its PINs.
    """
    if "requester_id" not in requests.columns:
        requests = requests.withColumn("requester_id", F.lit(None).cast("string"))
    asked = requests.select("request_id", "ts", "user_role", "query", "query_vec", "requester_id")
    entered = pins.select("request_id", "supervisor_id", F.col("attempt_no").cast("int").alias("attempt_no"), "ts", "pin")
    events = asked.withColumn("entry", F.lit(False)).unionByName(entered.withColumn("entry", F.lit(True)), allowMissingColumns=True)

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        due, late, clock = hold_back(batch, root, epoch, delay)
        due = materialise(due, "due")
        prior = _state(spark, root, "allowed", epoch, schemas.RATE_LIMIT_LOG)
        before = supervisors if epoch == 0 else spark.read.schema(supervisors.schema).parquet(
            f"{root}/supervisors/epoch={epoch - 1}")
        come = due.filter("NOT entry").select(*asked.columns)
        facts, matched = assess(come, employees, embeddings, prior)
        known = facts.join(audited_query(come), "request_id").withColumn("requester_id", F.col("requester_id").cast("string"))
        new = known.filter("triggered").select(*_NAMES).withColumns(
            {"supervisor_id": F.lit(None).cast("string"), "used": F.lit(0), "first": F.lit(None).cast("int")})
        waiting = materialise(_state(spark, root, "open", epoch, OPEN).unionByName(new), "open")
        hits = materialise(_state(spark, root, "hits", epoch, HITS).unionByName(matched), "hits")

        timed = due.filter("entry").filter(F.col("ts").isNotNull()).select(*schemas.PIN_ATTEMPTS.names)
        entries = materialise(_state(spark, root, "entries", epoch, PINS).unionByName(timed), "entries")
        until = waiting.select(F.col("request_id").alias("of"), (micros() + window * 1_000_000).alias("until_us"))
        in_time = (F.col("request_id") == F.col("of")) & (micros() < F.col("until_us"))
        mine, others = entries.join(until, in_time, "left_semi"), entries.join(until, in_time, "left_anti")
        over = clock - window * 1_000_000
        reviewed, tried = step(waiting, mine, before, micros() < over)
        reviewed = materialise(reviewed, "reviewed")
        none = {c: F.lit(None).cast("string") for c in (*_REVIEW, "supervisor_id")}
        concluded = reviewed.filter(F.col("gate_decision").isNotNull()).select(*_NAMES, *none)
        log = materialise(audit.build(known.filter("NOT triggered").select(*_NAMES).withColumns(none).unionByName(concluded)), "audit")

        too_late = (late.filter("entry").unionByName(due.filter("entry").filter(F.col("ts").isNull())).select(*schemas.PIN_ATTEMPTS.names)
                    .unionByName(others.filter(micros() < over)))
        _epoch(log.unionByName(refused_late(late.filter("NOT entry").select(*asked.columns))), root, "audit", epoch)
        _epoch(released_records(log, hits, employees), root, "released", epoch)
        _epoch(ratelog(limited(facts)), root, "ratelog", epoch)
        about = log.select("request_id", "user_role", "query")
        _epoch(alerts(tried, about, before, managers, fallback_contact), root, "outbox", epoch)
        _epoch(gate.supervisor_state(before, tried), root, "supervisors", epoch)
        _epoch(newest_allowed(prior.unionByName(ratelog(limited(facts)))), root, "allowed", epoch)
        still = reviewed.filter(F.col("gate_decision").isNull()).drop(*_REVIEW)
        _epoch(still, root, "open", epoch)
        _epoch(hits.join(still.select("request_id"), "request_id", "left_semi"), root, "hits", epoch)
        _epoch(others.filter(micros() >= over), root, "entries", epoch)
        _epoch(late.filter("NOT entry").drop("query_vec", "entry", *[c for c in entered.columns if c not in asked.columns]), root, "late", epoch)
        _epoch(too_late, root, "late_entries", epoch)

    return run(events, each, f"{root}/checkpoint")

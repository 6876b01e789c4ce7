"""Registered queries: one per operator, each over the whole benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import policy, schemas
from wardline.functions import text, vectors
from wardline.operators import access, gate, ingest, pivots, ratelimit, retrieval
from wardline.operators import audit as audit_ops
from wardline.operators import guard as guard_ops
from wardline.plans import governed
from wardline.session import materialise, new_path
from wardline.sources import mapping as m
from wardline.sources import tables as t
from wardline.streaming import jobs, review

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# ---- sources ----

@query
def src_personnel(spark, d):
    """The sheet lands as CSV and is read back by header."""
    path = new_path(spark, "personnel")
    m.personnel(spark, d).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    df = t.read_personnel(spark, path, "csv")
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


@query
def scan_embeddings(spark, d):
    path = new_path(spark, "employee_embeddings")
    m.embeddings(spark, d).withColumn("content", F.lit("")).select(*schemas.EMPLOYEE_EMBEDDINGS.names).write.parquet(path)
    return t.scan_embeddings(spark, path).select(
        "nric", F.size("embedding").cast("long").alias("dims"),
        vectors.round_score(vectors.norm(F.col("embedding"))).alias("norm"))


@query
def fetch_by_keys(spark, d):
    return t.fetch_by_keys(m.employees(spark, d), m.embeddings(spark, d))


@query
def lookup_supervisor(spark, d):
    asked = gate.entered_ids(m.pin_attempts(spark, d)).select("request_id", "supervisor_id")
    return t.lookup_supervisor(asked, m.supervisors(spark, d)).select(
        "request_id", "supervisor_id", "supervisor_name", "supervisor_is_locked",
        "supervisor_failed_attempts")


@query
def lookup_manager_email(spark, d):
    return t.manager_contact(m.managers(spark, d), "fallback@example.com")


@query
def collection_count(spark, d):
    return t.collection_count(m.table(spark, d, "documents"))


@query
def collection_peek(spark, d):
    return t.collection_peek(m.table(spark, d, "documents"), "doc_id")


@query
def vector_search_filtered(spark, d):
    index = pivots.build(m.embeddings(spark, d), n_pivots=16)
    top = pivots.search(m.requests(spark, d), index, 2, F.col("label") == 3)[0]
    return top.select("request_id", "nric", vectors.round_score(F.col("score")).alias("score"))


# ---- ingestion and table maintenance ----

@query
def ingest_normalise(spark, d):
    return ingest.normalise(m.personnel(spark, d))


@query
def ingest_key_filter(spark, d):
    stored, skipped = ingest.split_by_key(ingest.normalise(m.personnel(spark, d), "nan"))
    return stored.withColumn("stored", F.lit(True)).unionByName(skipped.withColumn("stored", F.lit(False)))


@query
def embed_content(spark, d):
    return ingest.ingest(m.personnel(spark, d))[2]


def letter_counts(texts):
    """A stand-in model: a few letter counts. It refuses texts about Machinery."""
    if any("MACHINERY" in x for x in texts):
        raise ValueError("refused")
    return [[len(x), x.count("E"), x.count("0")] for x in texts]


@query
def embed_with(spark, d):
    return ingest.embed_with(ingest.ingest(m.personnel(spark, d))[2], "content", letter_counts)


def _fresh_tables(spark):
    """(folder, database) of newly made empty tables."""
    root, database = new_path(spark, "tables"), f"wardline_{uuid.uuid4().hex}"
    t.ensure_tables(spark, root, database)
    return root, database


@query
def ingest_counts(spark, d):
    """The whole ingestion: both tables written, the model asked once per row."""
    root, database = _fresh_tables(spark)
    return ingest.ingest_job(m.personnel(spark, d), letter_counts, database, root)


@query
def full_refresh(spark, d):
    """Written twice: the second write replaces the first."""
    root, database = _fresh_tables(spark)
    for _ in range(2):
        t.full_refresh({f"{database}.employee_data": ingest.ingest(m.personnel(spark, d))[0]}, root)
    return spark.table(f"{database}.employee_data")


@query
def ensure_tables(spark, d):
    """Created twice without effect, then filled; a keyless row is refused."""
    root, database = _fresh_tables(spark)
    sheet = ingest.normalise(m.personnel(spark, d))
    t.append(sheet, f"{root}/employee_data", schemas.EMPLOYEE_DATA)
    t.ensure_tables(spark, root, database)
    spark.catalog.refreshTable(f"{database}.employee_data")
    return spark.table(f"{database}.employee_data")


@query
def seed_dims(spark, d):
    return t.hash_supervisors(m.supervisor_seed(spark, d))


@query
def verify_readback(spark, d):
    sup, man = t.verify_readback(m.supervisors(spark, d), m.managers(spark, d))
    return sup.select(
        F.col("supervisor_id").alias("id"), "name", F.array_join("roles", "|").alias("detail"),
        F.col("is_locked").alias("flag")).unionByName(man.select(
            F.col("manager_id").alias("id"), "name", F.col("email").alias("detail"),
            F.col("can_unlock_supervisors").alias("flag")))


# ---- guard ----

@query
def default_query(spark, d):
    return m.requests(spark, d).select("request_id", text.default_query(F.col("query")).alias("query"))


@query
def role_gate(spark, d):
    return guard_ops.role_gate(m.requests(spark, d)).select(
        "request_id", "user_role", F.array_join("allowed_fields", "|").alias("allowed"), "role_error")


def _all_texts(spark, d):
    """id, text: documents, web pages, benchmark items, the requests made of user turns, and all other turns."""
    def of(name, letter, key, column):
        return m.table(spark, d, name).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.col(column).alias("text"))

    others = m.table(spark, d, "conversations").filter("role IS DISTINCT FROM 'user'").select(
        F.concat_ws("-", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    asked = m.requests(spark, d).select(F.concat(F.lit("r"), "request_id").alias("id"), F.col("query").alias("text"))
    return (of("documents", "d", "doc_id", "text").unionByName(of("pages", "p", "page_id", "html"))
            .unionByName(of("benchmark", "b", "item_id", "text")).unionByName(asked).unionByName(others))


@query
def sanitise(spark, d):
    """Every text of the corpus as a query."""
    return guard_ops.sanitise(t.balanced(_all_texts(spark, d)), "text").select(
        "id", "valid", "clean_query", "reject_reason")


@query
def injection_detect(spark, d):
    """The rules over every whole text of the corpus."""
    return guard_ops.scan_injection(t.balanced(_all_texts(spark, d)), "text").select("id", "rule", "rule_description")


def _guarded(spark, d):
    return guard_ops.guard(m.requests(spark, d).drop("query_vec"))


@query
def guard_decide(spark, d):
    return _guarded(spark, d).select("request_id", "clean_query", "flag", "block_reason", "proceeds")


# ---- retrieval ----

def _top(spark, d, k=policy.TOP_K):
    return retrieval.topk(m.requests(spark, d), m.embeddings(spark, d), k)


@query
def dot_norm_cosine(spark, d):
    """Each stored vector against the next one."""
    v = m.table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", vectors.round_score(
        vectors.cosine(F.col("embedding"), F.col("other"))).alias("score"))


@query
def similarity_pairs(spark, d):
    return retrieval.score_profile(m.requests(spark, d), m.embeddings(spark, d))


@query
def similarity_topk(spark, d):
    return _top(spark, d).select("request_id", "nric", vectors.round_score(F.col("score")).alias("score"))


@query
def retrieve_records(spark, d):
    return retrieval.retrieve(_top(spark, d), m.employees(spark, d))


def _records(spark, d):
    return retrieval.retrieve(_top(spark, d), m.employees(spark, d)).join(
        m.requests(spark, d).select("request_id", "user_role"), "request_id")


@query
def result_rank(spark, d):
    return retrieval.rank_records(retrieval.retrieve(_top(spark, d), m.employees(spark, d))).select(
        "request_id", "record_no", "nric", "_similarity_score")


@query
def result_order(spark, d):
    """All results of the batch in final order, with that order as a column."""
    ranked = retrieval.rank_records(retrieval.retrieve(_top(spark, d), m.employees(spark, d)))
    return ranked.select("request_id", "record_no", "_similarity_score", "nric").orderBy(
        "request_id", "record_no")


@query
def top_score(spark, d):
    r = m.requests(spark, d)
    return retrieval.top_score(r, retrieval.topk(r, m.embeddings(spark, d))).select(
        "request_id", vectors.round_score(F.col("top_score")).alias("top_score"))


@query
def low_similarity_flag(spark, d):
    best = retrieval.top_score(m.requests(spark, d), _top(spark, d))
    return best.select("request_id", retrieval.low_similarity_warning(F.col("top_score")).alias("warning"),
                       (vectors.round_score(F.col("top_score")) < policy.LOW_SIMILARITY).alias("record_mark"))


# ---- access ----

@query
def rbac_project(spark, d):
    out = access.project_mixed(retrieval.rank_records(_records(spark, d)))
    return out.withColumn("fields", F.array_join("fields", "|"))


@query
def rbac_project_role(spark, d):
    return access.project_role(retrieval.retrieve(_top(spark, d), m.employees(spark, d)), "Finance_Lead")


@query
def records_returned(spark, d):
    return access.records_returned(
        m.requests(spark, d).select("request_id"), retrieval.retrieve(_top(spark, d), m.employees(spark, d)))


@query
def fields_union(spark, d):
    return access.fields_union(access.project_mixed(_records(spark, d))).select(
        "request_id", F.array_join("fields_in_results", "|").alias("fields"))


@query
def sensitive_trigger(spark, d):
    r = m.requests(spark, d).select("request_id", "user_role")
    recs = access.project_mixed(_records(spark, d))
    known = access.records_returned(r, recs).join(access.fields_union(recs), "request_id", "left")
    return known.select(
        "request_id", F.array_join(access.triggered_fields(F.col("fields_in_results")), "|").alias("triggered"),
        access.needs_review(F.col("fields_in_results"), F.col("records_returned")).alias("needs_review"))


@query
def gate_preview(spark, d):
    out = access.gate_preview(access.project_mixed(_records(spark, d)))
    return out.select("request_id", "records_pending", F.array_join("fields_in_results", "|").alias("fields"),
                      F.array_join("sensitive_fields", "|").alias("sensitive"))


@query
def policy_any(spark, d):
    """For each stored field: does any role seen in the requests allow it?"""
    seen = m.requests(spark, d).groupBy("user_role").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "allowed_fields", F.coalesce(policy.allowed_fields(F.col("user_role")), policy.string_array([])))
    return seen.agg(*[policy.any_allows(f).alias(f) for f in policy.EMPLOYEE_FIELDS], F.sum("n").alias("n_requests"))


@query
def policy_denied_fields(spark, d):
    """Per supervisor the roles it may not approve; per requesting role the fields it may not see."""
    sup = m.supervisors(spark, d).select("supervisor_id", F.array_join(F.array_except(
        policy.string_array(list(policy.ROLE_FIELDS)), text.parse_list(F.col("can_approve_roles"))), "|")
        .alias("denied"))
    per_role = policy.denied_fields(policy.role_policy(spark))
    asked = m.requests(spark, d).groupBy("user_role").agg(F.count(F.lit(1)).alias("n"))
    return (asked.join(per_role, asked.user_role == per_role.role)
            .select(F.col("user_role").alias("id"), F.array_join("denied_fields", "|").alias("denied"))
            .unionByName(sup.withColumnRenamed("supervisor_id", "id")))


# ---- rate limit ----

@query
def attempts_trailing(spark, d):
    return ratelimit.attempts_trailing(m.event_attempts(spark, d)).select("request_id", "n_trailing")


@query
def rate_limit(spark, d):
    return ratelimit.rate_limit(m.event_attempts(spark, d)).select("request_id", "user_role", "blocked")


@query
def ratelog_append(spark, d):
    path = new_path(spark, "ratelog")
    log = ratelimit.ratelog(ratelimit.rate_limit(m.event_attempts(spark, d)))
    for _ in range(2):  # a replay of the batch leaves one copy
        t.append(log, path, schemas.RATE_LIMIT_LOG, "first")
    return t.read_log(spark, path, schemas.RATE_LIMIT_LOG).select(
        F.unix_micros("timestamp").alias("us"), "user_role", "request_id", "blocked")


def _event_log(spark, d):
    return ratelimit.ratelog(ratelimit.rate_limit(m.event_attempts(spark, d)))


def _noon(spark, d):
    """The end of the counted window: the last event's time."""
    return m.event_attempts(spark, d).agg(F.max("ts").alias("x")).scalar()


@query
def rate_count(spark, d):
    return ratelimit.rate_count(_event_log(spark, d), _noon(spark, d))


@query
def ratelog_split(spark, d):
    return ratelimit.ratelog_split(_event_log(spark, d), _noon(spark, d), 60 * 24 * 30)


# ---- gate ----

@query
def supervisor_id_norm(spark, d):
    return m.pin_attempts(spark, d).select(
        "request_id", "attempt_no", text.supervisor_id(F.col("supervisor_id")).alias("supervisor_id"))


@query
def limit_one(spark, d):
    """First supervisor by id that may still be asked."""
    return m.supervisors(spark, d).filter("NOT is_locked").orderBy("supervisor_id").limit(1).select(
        "supervisor_id", "name", "email")


def _asked(spark, d):
    return m.requests(spark, d).select("request_id", "user_role")


@query
def gate_authorise(spark, d):
    ids = gate.entered_ids(m.pin_attempts(spark, d))
    dim = m.supervisors(spark, d).select("supervisor_id", "can_approve_roles")
    return (_asked(spark, d).join(ids, "request_id").join(dim, "supervisor_id", "left")
            .select("request_id", "supervisor_id", F.coalesce(gate.may_approve(
                F.col("can_approve_roles"), F.col("user_role")), F.lit(False)).alias("authorised")))


@query
def pin_verify(spark, d):
    tried = m.pin_attempts(spark, d).withColumn("supervisor_id", text.supervisor_id(F.col("supervisor_id")))
    dim = m.supervisors(spark, d).select("supervisor_id", "hashed_pin")
    return tried.join(dim, "supervisor_id", "left").select(
        "request_id", "attempt_no",
        F.coalesce(text.pin_hash(F.col("pin")) == F.col("hashed_pin"), F.lit(False)).alias("ok"))


@query
def lockout(spark, d):
    return gate.lockout(m.event_pins(spark, d), m.supervisors(spark, d)).select(
        "supervisor_id", "request_id", "ok", "failed_after", "locks", "counted")


@query
def pin_remaining(spark, d):
    decided = gate.gate(_asked(spark, d), m.pin_attempts(spark, d), m.supervisors(spark, d))[1]
    return decided.filter("counted").select(
        "supervisor_id", "request_id", "remaining", F.col("position").alias("attempt_position"))


@query
def supervisor_state(spark, d):
    snapshot = m.supervisors(spark, d)
    decided = materialise(gate.lockout(m.event_pins(spark, d), snapshot), "decided")
    return gate.supervisor_state(snapshot, decided).select(
        "supervisor_id", "is_locked", "failed_attempts", "locked_by_session")


@query
def gate_decide(spark, d):
    return gate.gate(_asked(spark, d), m.pin_attempts(spark, d), m.supervisors(spark, d))[0]


def _locks(spark, d):
    decisions, decided = gate.gate(_asked(spark, d), m.pin_attempts(spark, d), m.supervisors(spark, d))
    about = m.requests(spark, d).select("request_id", "user_role", "query")
    names = m.supervisors(spark, d).select("supervisor_id", F.col("name").alias("supervisor_name"))
    return (decided.filter("locks").withColumnRenamed("failed_after", "failed_attempts")
            .join(about, "request_id").join(names, "supervisor_id"))


@query
def escalation_contact(spark, d):
    out = gate.escalations(_locks(spark, d), t.manager_contact(m.managers(spark, d)))
    return out.select("request_id", "supervisor_id", "send_to")


@query
def escalation_build(spark, d):
    out = gate.escalations(_locks(spark, d), t.manager_contact(m.managers(spark, d)))
    return out.select("request_id", "subject", "body")


# ---- decisions and audit ----

def _governed(spark, d):
    return governed.governed_retrieval(
        m.requests(spark, d), m.employees(spark, d), m.embeddings(spark, d), m.supervisors(spark, d),
        m.managers(spark, d), m.pin_attempts(spark, d))


def _flat(audit):
    return audit.withColumn("us", F.unix_micros("timestamp")).drop("timestamp")


@query
def governed_retrieval(spark, d):
    """Audit row of every request beside what it released."""
    out = _governed(spark, d)
    released = out.released.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_released"), F.count("nric").alias("n_nric"),
        F.count("financial_info").alias("n_financial"), F.count("medical_info").alias("n_medical"),
        F.max("_similarity_score").alias("best_score"))
    return (_flat(out.audit).join(released, "request_id", "left")
            .fillna(0, ["n_released", "n_nric", "n_financial", "n_medical"]))


@query
def audit_build(spark, d):
    return _flat(_governed(spark, d).audit)


@query
def audit_decision(spark, d):
    return _governed(spark, d).audit.groupBy("user_role", "decision", "hitl_decision").agg(
        F.count(F.lit(1)).alias("n"))


@query
def audit_append(spark, d):
    path = new_path(spark, "audit_log")
    log = _governed(spark, d).audit
    for _ in range(2):  # a replay of the batch leaves one copy
        t.append(log, path, schemas.AUDIT_LOG, "first")
    return _flat(t.read_log(spark, path, schemas.AUDIT_LOG))


@query
def lookup_audit_entry(spark, d):
    """From the stored log: it is made once per session and table folder, and a lookup opens one bucket of it."""
    return _flat(t.find_audit_entry(spark, _stored_audit(spark, d), "6-2"))


_stored: dict[tuple[str, str], str] = {}


def _stored_audit(spark, d) -> str:
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        path = new_path(spark, "audit_by_key")
        t.write_clustered(_governed(spark, d).audit, path, "request_id", 16)
        _stored[key] = path
    return _stored[key]


@query
def audit_link(spark, d):
    out = _governed(spark, d)
    return audit_ops.link(out.audit, out.ratelog)


@query
def output_view(spark, d):
    out = _governed(spark, d)
    return governed.output_view(out.released, out.audit)


# ---- streaming: each drains the table as a stream and returns what the sink holds ----

@query
def stream_guard(spark, d):
    path = new_path(spark, "stream-guard")
    live = m.requests(spark, d, m.stream(spark, d, "conversations")).drop("query_vec")
    jobs.append_stream(jobs.stream_guard(live), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("request_id", "clean_query", "flag", "block_reason", "role_error")


DELAY, EPOCHS = 600, 3  # seconds by which rows arrive out of order, and in how many epochs
WINDOW = 9000  # seconds that a streamed request waits for its PINs


def _replayed(spark, path, start, beat, epochs=EPOCHS, **tables) -> None:
    """Feed the tables to a stream out of order, epoch by epoch; the stream is started anew for each, from its checkpoint."""
    us = F.unix_micros("ts")
    spans = [df.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).first() for df in tables.values()]
    lo, hi = min(s.lo for s in spans), max(s.hi for s in spans)
    come = {name: materialise(m.arrivals(df, lo, hi, DELAY, epochs, beat), name) for name, df in tables.items()}
    for epoch in range(epochs):
        for name, df in come.items():
            df.filter(F.col("epoch") == epoch).drop("epoch").write.mode("append").parquet(f"{path}/in/{name}")
        live = {name: spark.readStream.schema(df.drop("epoch").schema).parquet(f"{path}/in/{name}") for name, df in come.items()}
        start(**live).awaitTermination()


@query
def stream_rate_limit(spark, d):
    path = new_path(spark, "stream-rate")
    _replayed(spark, path, lambda attempts: jobs.rate_limit_stream(attempts, path, delay=DELAY), 2 * DELAY,
              attempts=m.event_attempts(spark, d))
    return spark.read.parquet(f"{path}/ratelog").select("request_id", "user_role", "blocked")


def _lockout_stream(spark, d):
    path = new_path(spark, "stream-lockout")
    _replayed(spark, path, lambda pins: jobs.lockout_stream(pins, m.supervisors(spark, d), m.managers(spark, d), path, delay=DELAY),
              2 * DELAY, pins=m.event_pins(spark, d))
    return path


@query
def stream_lockout(spark, d):
    return spark.read.parquet(f"{_lockout_stream(spark, d)}/attempts").select(
        "supervisor_id", "request_id", "ok", "failed_after", "locks", "counted")


@query
def stream_escalation(spark, d):
    return spark.read.parquet(f"{_lockout_stream(spark, d)}/outbox").select(
        "request_id", "supervisor_id", "send_to", "subject", "body")


@query
def stream_audit(spark, d):
    """Requests and the PINs that follow them, both out of order. Entries without a time are no part of a stream."""
    path = new_path(spark, "stream-audit")
    asked = m.requests(spark, d).drop("conv_id", "turn")
    _replayed(spark, path, lambda requests, pins: review.audit_stream(
        requests, pins, m.employees(spark, d), m.embeddings(spark, d), m.supervisors(spark, d), m.managers(spark, d), path,
        DELAY, WINDOW), 2 * WINDOW, 2, requests=asked, pins=m.pin_attempts(spark, d).filter("ts IS NOT NULL"))
    return _flat(spark.read.parquet(f"{path}/audit").drop("epoch"))

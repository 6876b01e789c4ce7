"""The whole control path as one job: guard, retrieval, field filter, release gate, audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import policy
from wardline.functions import text
from wardline.functions.vectors import round_score
from wardline.operators import access, audit, gate, retrieval
from wardline.operators.guard import audited_query, verdict
from wardline.operators.ratelimit import ratelog
from wardline.session import materialise
from wardline.sources.tables import manager_contact


@dataclass(frozen=True)
class Outcome:
    audit: DataFrame
    released: DataFrame
    ratelog: DataFrame
    escalations: DataFrame
    supervisors: DataFrame


def governed_retrieval(requests: DataFrame, employees: DataFrame, embeddings: DataFrame,
                       supervisors: DataFrame, managers: DataFrame, attempts: DataFrame,
                       prior_log: DataFrame | None = None, k: int = policy.TOP_K,
                       where: Column | None = None, fallback_contact: str = "",
                       typed: bool = False, check_ids: bool = True) -> Outcome:
    """Decide every request. typed: requests were typed in by hand, so roles are stripped and an
    empty query becomes the stock question. A requester_id column keeps a requester from approving
    the own request.

    Denied requests leave before the vector search. Until a request is approved only keys are
    matched; field values are read for approved requests alone, and a field that no role may see
    is never read. Decisions are taken on narrow tables (a row or k rows per request, no text and
    no vector), each written once for the branches that read it; the query text is read a
    second time for the audit rows instead of travelling along.

    Every join goes by request_id, so a batch with a repeated or missing one is refused as a whole. check_ids:
    False where the caller answers for them, as a stream must not stop at a request delivered twice.
    """
    if check_ids:
        require_ids(requests)
    if typed:
        requests = (requests.withColumn("user_role", text.strip(F.col("user_role")))
                    .withColumn("query", text.default_query(F.col("query"))))
    facts, matched = assess(requests, employees, embeddings, prior_log, k, where)
    under_review = facts.filter("triggered").select(
        *[c for c in ("request_id", "user_role", "requester_id") if c in facts.columns])
    decisions, tried = gate.gate(under_review, attempts, supervisors)
    # the only place where query texts are shuffled
    log = materialise(audit.build(
        facts.join(decisions, "request_id", "left").join(audited_query(requests), "request_id")), "audit")
    return Outcome(
        audit=log, released=released_records(log, matched, employees), ratelog=ratelog(limited(facts)),
        escalations=alerts(tried, log, supervisors, managers, fallback_contact),
        supervisors=gate.supervisor_state(supervisors, tried))


def require_ids(requests: DataFrame) -> None:
    """ValueError naming some request ids that are held by several rows or are null; only ids are read."""
    bad = (requests.groupBy("request_id").agg(F.count("*").alias("n"))
           .filter((F.col("n") > 1) | F.col("request_id").isNull()).limit(5).collect())
    if bad:
        named = ", ".join(f"{r['request_id']!r} ({r['n']} rows)" for r in bad)
        raise ValueError(f"request_id must be unique and present in every row: {named}")


def assess(requests: DataFrame, employees: DataFrame, embeddings: DataFrame, prior_log: DataFrame | None = None,
           k: int = policy.TOP_K, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Everything up to the gate: (one narrow row per request, keys and scores of the records it may get)."""
    bare = requests.withColumn("has_vector", F.col("query_vec").isNotNull()).drop("query_vec")
    guarded = verdict(bare, prior_log)
    searching = requests.select("request_id", "query_vec").join(
        guarded.filter(F.col("proceeds") & F.col("has_vector")).select("request_id"),
        "request_id", "left_semi")
    top = retrieval.topk(searching, embeddings, k, where)
    # a key stored twice inside one top-k keeps its lowest score; found: it has a record
    hits = materialise(
        top.groupBy("request_id", "nric").agg(F.min("score").alias("score"), F.max("raw").alias("best"))
        .join(employees.select("nric").withColumn("found", F.lit(True)), "nric", "left"), "hits")
    matched = hits.filter("found").select(
        "request_id", "nric", round_score(F.col("score")).alias("_similarity_score"))
    per_request = hits.groupBy("request_id").agg(
        F.max("best").alias("top_score"), F.count("found").alias("records_returned"))
    facts = (guarded.join(per_request, "request_id", "left")
             .withColumn("triggered", F.col("proceeds") & access.needs_review(
                 F.col("allowed_fields"), F.coalesce("records_returned", F.lit(0)))))
    return materialise(facts, "facts"), matched


def released_records(log: DataFrame, matched: DataFrame, employees: DataFrame) -> DataFrame:
    """The fields that approved requests may see of their records."""
    approved = log.filter(F.col("decision") == audit.APPROVED).select("request_id", "user_role")
    return access.project_mixed(
        retrieval.rank_records(matched.join(approved, "request_id")).join(employees, "nric"))


def alerts(tried: DataFrame, log: DataFrame, supervisors: DataFrame, managers: DataFrame, fallback_contact: str = "") -> DataFrame:
    """The outbox rows of the locks among decided PIN entries."""
    locks = (tried.filter("locks")
             .select("request_id", "supervisor_id", "ts", F.col("failed_after").alias("failed_attempts"))
             .join(log.select("request_id", "user_role", "query"), "request_id")
             .join(supervisors.select("supervisor_id", F.col("name").alias("supervisor_name")),
                   "supervisor_id"))
    return gate.escalations(locks, manager_contact(managers, fallback_contact))


def limited(facts: DataFrame) -> DataFrame:
    """The requests that reached the limiter."""
    return (facts.filter(F.col("role_error").isNull() & F.col("flag").isin("", "RATE_LIMITED"))
            .select("request_id", "user_role", "ts", (F.col("flag") == "RATE_LIMITED").alias("blocked")))


def output_view(released: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Released records as shown: numbered from 1, labelled, internal columns hidden, with the
    record-level low-similarity mark (rounded score, strict). With the audit rows, every refused
    request has one row that holds the refusal in `message` and no record."""
    shown = released.select(
        "request_id", "record_no", *[c for c in released.columns if c in policy.EMPLOYEE_FIELDS],
        F.col("_similarity_score").alias("similarity_score"),
        (F.col("_similarity_score") < policy.LOW_SIMILARITY).alias("low_similarity"),
        F.lit("[AI-GENERATED]").alias("label"), F.lit(None).cast("string").alias("message"))
    if log is None:
        return shown
    refused = log.filter(F.col("decision") != audit.APPROVED).select(
        "request_id", F.concat(F.lit("ACCESS DENIED: "), "error").alias("message"))
    return shown.unionByName(refused, allowMissingColumns=True)

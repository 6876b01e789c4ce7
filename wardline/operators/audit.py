"""Audit rows: one per request, allowed or denied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.access import fields_exposed, rule_applied
from wardline.operators.retrieval import low_similarity_warning

# --- fixed values: decision texts of the pipeline ---
INVALID_ROLE = "DENIED - Invalid role"
EMBEDDING_ERROR = "DENIED - Embedding error"
APPROVED = "APPROVED"
NOT_SENSITIVE = "N/A - No sensitive fields"
# --- end of fixed values ---
NO_VECTOR = "Embedding failed — query has no vector"


def decision(reached: Column) -> Column:
    """First failing control decides. reached: the request got through the field filter.

    Reads role_error, flag, block_reason and gate_decision (NULL when the gate was not asked).
    """
    return (F.when(F.col("role_error").isNotNull(), INVALID_ROLE)
            .when(F.col("flag") != "", F.concat(F.lit("DENIED - "), "flag", F.lit(": "), "block_reason"))
            .when(~reached, EMBEDDING_ERROR)
            .otherwise(F.coalesce("gate_decision", F.lit(APPROVED))))


def build(decided: DataFrame) -> DataFrame:
    """The 13 audit columns.

    decided: one row per request with request_id, ts, user_role, clean_query, allowed_fields,
    role_error, flag, block_reason, has_vector, records_returned, top_score (NULL when nothing is
    stored), triggered, gate_decision, hitl_decision, supervisor_id. A gate rejection keeps the
    counts and rule that were set before it, and its decision is also its error.
    """
    reached = F.col("role_error").isNull() & (F.col("flag") == "") & F.col("has_vector")
    approved_by = F.when(F.col("hitl_decision") == "approve",
                         F.concat(F.lit(" | HITL approved by "), "supervisor_id")).otherwise("")
    rejected = F.coalesce(F.col("hitl_decision") == "reject", F.lit(False))
    error = (F.when(F.col("role_error").isNotNull(), F.col("role_error"))
             .when(F.col("flag") != "", F.col("block_reason"))
             .when(~reached, NO_VECTOR)
             .when(rejected, F.col("gate_decision"))
             .otherwise(low_similarity_warning(F.col("top_score"))))
    return decided.select(
        "request_id", F.col("ts").alias("timestamp"), "user_role", F.col("clean_query").alias("query"),
        decision(reached).alias("decision"),
        F.when(reached, F.coalesce("records_returned", F.lit(0))).otherwise(0).cast("long")
        .alias("records_returned"),
        F.when(reached, fields_exposed(F.col("allowed_fields"))).otherwise("[]").alias("fields_exposed"),
        (reached & F.coalesce("triggered", F.lit(False))).alias("hitl_triggered"),
        F.when(reached, F.coalesce("hitl_decision", F.lit(NOT_SENSITIVE))).alias("hitl_decision"),
        F.lit(False).alias("hitl_timeout"),
        F.when(reached, F.concat(rule_applied(F.col("user_role"), F.col("allowed_fields")), approved_by))
        .alias("rbac_rule_applied"),
        F.col("flag").alias("injection_flag"), error.alias("error"))


def link(audit: DataFrame, ratelog: DataFrame) -> DataFrame:
    """Reconcile both logs by request: in_audit, in_ratelog, blocked."""
    a = audit.select("request_id", "decision", F.lit(True).alias("in_audit"))
    r = ratelog.select("request_id", "blocked", F.lit(True).alias("in_ratelog"))
    return (a.join(r, "request_id", "full")
            .withColumn("in_audit", F.coalesce("in_audit", F.lit(False)))
            .withColumn("in_ratelog", F.coalesce("in_ratelog", F.lit(False))))

"""Input guard: role gate, cleaning, injection scan. Map-only; no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import policy
from wardline.functions import injection, text
from wardline.operators.ratelimit import rate_limit
from wardline.session import materialise


def role_gate(requests: DataFrame, role_col: str = "user_role") -> DataFrame:
    """Adds allowed_fields (NULL for an unknown role) and role_error."""
    return (requests
            .withColumn("allowed_fields", policy.allowed_fields(F.col(role_col)))
            .withColumn("role_error", F.when(
                F.col("allowed_fields").isNull(),
                F.concat(F.lit("Unknown role '"), F.coalesce(role_col, F.lit("None")),
                         F.lit("'. Access denied.")))))


def sanitise(df: DataFrame, query_col: str = "query") -> DataFrame:
    """Adds valid, clean_query and reject_reason. A missing query counts as empty."""
    raw = F.coalesce(F.col(query_col), F.lit(""))
    return (df
            .withColumn("clean_query", text.clean_text(raw))
            .withColumn("reject_reason", text.rejection(raw, F.col("clean_query")))
            .withColumn("valid", F.col("reject_reason") == "")
            .withColumn("clean_query", F.substring("clean_query", 1, policy.MAX_QUERY_LENGTH)))


def scan_injection(df: DataFrame, text_col: str, when=None) -> DataFrame:
    """Adds rule (first matching rule or NULL) and rule_description; only where `when` holds."""
    rule = injection.injection_rule(F.col(text_col), F.col("_low"))
    return (df.withColumn("_low", injection.folded(F.col(text_col)))
            .withColumn("rule", rule if when is None else F.when(when, rule)).drop("_low")
            .withColumn("rule_description", injection.rule_description(F.col("rule"))))


def content_guard(requests: DataFrame, query_col: str = "query", when=None) -> DataFrame:
    """The two controls that need only the row: flag and block_reason before rate limiting. Rules are
    tried only where `when` holds."""
    scanned = F.col("valid") if when is None else F.col("valid") & when
    checked = scan_injection(sanitise(requests, query_col), "clean_query", scanned)
    return (checked
            .withColumn("flag", F.when(~F.col("valid"), "INVALID_QUERY")
                        .when(F.col("rule").isNotNull(), "INJECTION").otherwise(""))
            .withColumn("block_reason", F.when(~F.col("valid"), F.col("reject_reason"))
                        .when(F.col("rule").isNotNull(),
                              F.concat(F.lit("Prompt injection detected — "), "rule_description"))
                        .otherwise(""))
            .drop("valid", "reject_reason", "rule", "rule_description"))


def gated_guard(requests: DataFrame) -> DataFrame:
    """Role gate and content guard. An unknown role is not judged further and keeps its raw query."""
    known = F.col("allowed_fields").isNotNull()
    checked = content_guard(role_gate(requests), when=known)
    return (checked
            .withColumn("clean_query", F.when(known, F.col("clean_query")).otherwise(F.col("query")))
            .withColumn("flag", F.when(known, F.col("flag")).otherwise(""))
            .withColumn("block_reason", F.when(known, F.col("block_reason")).otherwise("")))


def rate_reason(role: str, count: str | int = policy.RATE_LIMIT):
    """Text of a rate-limit block; a block always finds the window exactly full."""
    return F.concat(
        F.lit("Rate limit exceeded — role '"), F.col(role), F.lit("' has made "),
        F.lit(str(count)), F.lit(f" queries in the last {policy.RATE_WINDOW_MINUTES} minutes "
                                 f"(limit: {policy.RATE_LIMIT})."))


def verdict(requests: DataFrame, prior_log: DataFrame | None = None) -> DataFrame:
    """(request_id, user_role, ts[, has_vector, requester_id], flag, block_reason, allowed_fields, role_error,
    proceeds), one row per request and no query text.

    Order: unknown role, then invalid query, then injection, then rate limit. Only requests that
    pass the first three reach the limiter, so attack traffic never uses up a role's allowance.
    Texts are judged where they are read; only this narrow table is shuffled and written.
    """
    kept = [c for c in ("request_id", "user_role", "ts", "has_vector", "requester_id") if c in requests.columns]
    # Two branches read this, and a filter on `flag` pushed below it would repeat all the patterns.
    checked = materialise(
        gated_guard(requests.select(*kept, "query")).select(*kept, "flag", "block_reason"), "checked")
    known = policy.allowed_fields(F.col("user_role")).isNotNull()
    attempts = checked.filter(known & (F.col("flag") == "")).select("request_id", "user_role", "ts")
    limited = materialise(
        rate_limit(attempts, prior_log).filter("blocked").select("request_id", "blocked"), "blocked")
    over = F.coalesce(F.col("blocked"), F.lit(False))
    return (role_gate(checked.join(limited, "request_id", "left"))
            .withColumn("flag", F.when(over, "RATE_LIMITED").otherwise(F.col("flag")))
            .withColumn("block_reason", F.when(over, rate_reason("user_role"))
                        .otherwise(F.col("block_reason")))
            .withColumn("proceeds", F.col("role_error").isNull() & (F.col("flag") == ""))
            .drop("blocked"))


def audited_query(requests: DataFrame) -> DataFrame:
    """(request_id, clean_query): the text that is searched and logged; raw for an unknown role."""
    known = policy.allowed_fields(F.col("user_role")).isNotNull()
    cleaned = sanitise(requests.select("request_id", "user_role", "query"))
    return cleaned.select("request_id", F.when(known, F.col("clean_query"))
                          .otherwise(F.col("query")).alias("clean_query"))


def guard(requests: DataFrame, prior_log: DataFrame | None = None) -> DataFrame:
    """Every request's verdict beside its cleaned query: the whole guard result."""
    return verdict(requests, prior_log).join(audited_query(requests), "request_id")


def injection_detected(flag):
    """True for any guard block, a rate-limit block included."""
    return flag != ""

"""Field-level access by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import policy
from wardline.functions.text import json_list


def project_role(records: DataFrame, role: str) -> DataFrame:
    """Records of one role's job: only its fields, in policy order, plus the score.

    The other columns are absent from the plan, so the scan never reads them.
    """
    fields = [f for f in policy.ROLE_FIELDS[role] if f in records.columns]
    return records.select("request_id", *fields, "_similarity_score")


def project_mixed(records: DataFrame, role_col: str = "user_role") -> DataFrame:
    """Records of many roles: a field the role may not see is NULL, and `fields` lists the names
    present, so that withheld and empty stay distinguishable. Other columns pass through."""
    allowed = policy.allowed_fields(F.col(role_col))
    # a field no role may see is not even read
    granted = {f for fields in policy.ROLE_FIELDS.values() for f in fields}
    present = [f for f in policy.EMPLOYEE_FIELDS if f in records.columns and f in granted]
    others = [c for c in records.columns if c not in policy.EMPLOYEE_FIELDS]
    return records.select(
        *others, *[F.when(F.array_contains(allowed, f), F.col(f)).alias(f) for f in present],
        F.coalesce(F.array_intersect(allowed, policy.string_array(present)),
                   policy.string_array([])).alias("fields"))


def records_returned(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Adds records_returned, zero for a request without records."""
    n = records.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    return (requests.join(n, "request_id", "left")
            .withColumn("records_returned", F.coalesce("n", F.lit(0))).drop("n"))


def fields_union(records: DataFrame) -> DataFrame:
    """(request_id, fields_in_results): field names over all records of a request, sorted."""
    # distinct per record list first: the set a group collects is bounded by the field names
    return (records.select("request_id", F.explode("fields").alias("f")).groupBy("request_id")
            .agg(F.array_sort(F.collect_set("f")).alias("fields_in_results")))


def triggered_fields(fields: Column) -> Column:
    """Sensitive names among fields, sorted. Names count, not values."""
    return F.array_sort(F.array_intersect(
        F.coalesce(fields, policy.string_array([])), policy.string_array(policy.SENSITIVE_FIELDS)))


def needs_review(fields: Column, n_records: Column) -> Column:
    """A request with no records releases nothing and never triggers the gate."""
    return (n_records > 0) & (F.size(triggered_fields(fields)) > 0)


def gate_preview(records: DataFrame) -> DataFrame:
    """What the approver sees: record count and field names. No value column is read."""
    named = records.select("request_id", "fields")
    counts = named.groupBy("request_id").agg(F.count(F.lit(1)).alias("records_pending"))
    return (counts.join(fields_union(named), "request_id")
            .withColumn("sensitive_fields", triggered_fields(F.col("fields_in_results"))))


def fields_exposed(allowed: Column) -> Column:
    return json_list(allowed)


def rule_applied(role: Column, allowed: Column) -> Column:
    return F.concat(role, F.lit(": "), json_list(allowed))

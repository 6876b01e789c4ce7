"""Access policy and limits. One place for every value that decides who may see what."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.schemas import ROLE_POLICY

# --- fixed values: role policy, sensitive fields and limits must equal the governed system's ---
ROLE_FIELDS: dict[str, list[str]] = {
    "General_Staff": ["name", "employment"],
    "HR_Admin": ["name", "employment", "nric", "ethnicity"],
    "Finance_Lead": ["name", "employment", "financial_info"],
    "Medical_Lead": ["name", "employment", "medical_info"],
}
ROLE_DESCRIPTIONS: dict[str, str] = {
    "General_Staff": "Access to general, non-sensitive employee data only.",
    "HR_Admin": "Access to PII including NRIC and ethnicity.",
    "Finance_Lead": "Access to financial records.",
    "Medical_Lead": "Access to medical documentation.",
}
SENSITIVE_FIELDS = ["nric", "ethnicity", "medical_info", "financial_info", "criminal_record"]
MIN_QUERY_LENGTH = 2
MAX_QUERY_LENGTH = 500
RATE_LIMIT = 10
RATE_WINDOW_MINUTES = 60
TOP_K = 5
LOW_SIMILARITY = 0.3
MAX_FAILED_ATTEMPTS = 3
DEFAULT_QUERY = "Show me employee information"
# --- end of fixed values ---

RATE_WINDOW_US = RATE_WINDOW_MINUTES * 60 * 1_000_000
EMPLOYEE_FIELDS = [
    "nric", "name", "employment", "ethnicity", "medical_info", "financial_info", "criminal_record",
]


def string_array(values: Sequence[str]) -> Column:
    """Literal array<string>; typed even when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def allowed_fields(role: Column, roles: Mapping[str, Sequence[str]] = ROLE_FIELDS) -> Column:
    """The role's fields in policy order, NULL for an unknown role.

    The policy is configuration of a few roles, so it travels as a literal map in the plan: no
    join, and Catalyst folds it away for a single known role.
    """
    entries = [c for r, fields in roles.items() for c in (F.lit(r), string_array(fields))]
    return F.try_element_at(F.create_map(*entries), role)


def role_policy(spark: SparkSession) -> DataFrame:
    rows = [(r, fields, ROLE_DESCRIPTIONS[r]) for r, fields in ROLE_FIELDS.items()]
    return spark.createDataFrame(rows, ROLE_POLICY)


def denied_fields(policy: DataFrame, all_fields: Sequence[str] = EMPLOYEE_FIELDS) -> DataFrame:
    """Per role, the fields it may not see."""
    return policy.select(
        "role", F.array_except(string_array(all_fields), "allowed_fields").alias("denied_fields"))


def any_allows(field: str) -> Column:
    """Aggregate over role rows: does any of them allow this field?"""
    return F.coalesce(F.bool_or(F.array_contains("allowed_fields", field)), F.lit(False))


def policy_any(policy: DataFrame, field: str) -> DataFrame:
    """One row: does any role allow this field?"""
    return policy.agg(any_allows(field).alias("any_role_allows"))

"""Declared schemas of the governed tables."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType,
)

_S, _B, _L, _T = StringType(), BooleanType(), LongType(), TimestampType()


def _table(*cols: tuple) -> StructType:
    return StructType([StructField(c[0], c[1], len(c) < 3) for c in cols])


# Header names of the personnel sheet; every cell arrives as text.
PERSONNEL_SOURCE = _table(
    ("NRIC", _S), ("Name", _S), ("Employment", _S), ("Ethnicity", _S), ("Medical_Info", _S),
    ("Financial_Info", _S), ("Criminal_Record", _S))

EMPLOYEE_DATA = _table(
    ("nric", _S, "required"), ("name", _S), ("employment", _S), ("ethnicity", _S),
    ("medical_info", _S), ("financial_info", _S), ("criminal_record", _S))

EMPLOYEE_EMBEDDINGS = _table(
    ("nric", _S, "required"), ("content", _S), ("embedding", ArrayType(FloatType())))

AUDIT_LOG = _table(
    ("request_id", _S, "required"), ("timestamp", _T, "required"), ("user_role", _S), ("query", _S),
    ("decision", _S), ("records_returned", _L), ("fields_exposed", _S), ("hitl_triggered", _B),
    ("hitl_decision", _S), ("hitl_timeout", _B), ("rbac_rule_applied", _S), ("injection_flag", _S),
    ("error", _S))

RATE_LIMIT_LOG = _table(
    ("timestamp", _T, "required"), ("user_role", _S, "required"), ("request_id", _S), ("blocked", _B))

SUPERVISORS = _table(
    ("supervisor_id", _S, "required"), ("name", _S), ("email", _S), ("hashed_pin", _S),
    ("can_approve_roles", _S), ("is_locked", _B), ("failed_attempts", _L), ("locked_by_session", _S))

MANAGERS = _table(
    ("manager_id", _S, "required"), ("name", _S), ("email", _S), ("can_unlock_supervisors", _B))

ROLE_POLICY = _table(
    ("role", _S, "required"), ("allowed_fields", ArrayType(_S)), ("description", _S))

REQUESTS = _table(
    ("request_id", _S, "required"), ("ts", _T), ("user_role", _S), ("query", _S),
    ("query_vec", ArrayType(FloatType())))

PIN_ATTEMPTS = _table(
    ("request_id", _S, "required"), ("supervisor_id", _S), ("attempt_no", IntegerType()), ("ts", _T),
    ("pin", _S))

TABLES = {
    "employee_data": EMPLOYEE_DATA,
    "employee_embeddings": EMPLOYEE_EMBEDDINGS,
    "audit_log": AUDIT_LOG,
    "rate_limit_log": RATE_LIMIT_LOG,
    "supervisors": SUPERVISORS,
    "managers": MANAGERS,
}

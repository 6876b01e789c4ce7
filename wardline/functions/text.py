"""Text columns: query cleaning, list encoding, identifier normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline import policy

# --- fixed values: cleaning patterns and rejection texts ---
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
WHITESPACE_RUN = r"(?U)\s+"
SYMBOLS_ONLY = r"(?U)^[^\p{L}\p{N}_\s]+$"
TOO_SHORT = f"Query too short — minimum {policy.MIN_QUERY_LENGTH} characters required."
TOO_LONG = f"Query exceeds maximum length of {policy.MAX_QUERY_LENGTH} characters. Original length: "
SYMBOLS = "Query contains only symbols — no searchable content."
# --- end of fixed values ---


def clean_text(raw: Column) -> Column:
    """Drop control characters (words merge), fold whitespace runs to one space, strip."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, CONTROL_CHARS, ""), WHITESPACE_RUN, " "))


def rejection(raw: Column, clean: Column) -> Column:
    """Why a cleaned query is unusable, '' when it is fine.

    Lengths are code points; the too-long text names the length before cleaning.
    """
    return (
        F.when(F.length(clean) < policy.MIN_QUERY_LENGTH, TOO_SHORT)
        .when(F.length(clean) > policy.MAX_QUERY_LENGTH,
              F.concat(F.lit(TOO_LONG), F.length(raw).cast("string"), F.lit(".")))
        .when(clean.rlike(SYMBOLS_ONLY), SYMBOLS)
        .otherwise(""))


def default_query(query: Column) -> Column:
    """Stripped query, or the stock question when nothing was typed."""
    stripped = strip(query)
    return F.when(F.coalesce(stripped, F.lit("")) == "", policy.DEFAULT_QUERY).otherwise(stripped)


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not only spaces."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def supervisor_id(raw: Column) -> Column:
    """Stripped, upper-cased id; NULL when nothing was entered."""
    return F.nullif(F.upper(strip(raw)), F.lit(""))


def json_list(values: Column) -> Column:
    """JSON text of a string list with a space after each comma, as the audit log stores it."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def parse_list(text: Column) -> Column:
    """Decoded string list; malformed or missing JSON is the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def pin_hash(pin: Column) -> Column:
    return F.sha2(strip(pin), 256)

"""Prompt-injection rules as one JVM expression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: (pattern, ignores case, description); order matters, the first match wins ---
RULES: list[tuple[str, bool, str]] = [
    (r"ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|constraints?)",
     True, "Instruction override attempt: 'ignore previous instructions'"),
    (r"disregard\s+(all\s+)?(previous|prior|above|earlier|your)",
     True, "Instruction override attempt: 'disregard previous'"),
    (r"forget\s+(all\s+)?(previous|prior|above|earlier|your)\s+(instructions?|prompts?|rules?)",
     True, "Instruction override attempt: 'forget previous instructions'"),
    (r"(new|your new|updated|revised)\s+(instructions?|rules?|directives?|orders?|task)\s*(are|is|follow|:)",
     True, "Instruction replacement attempt"),
    (r"(you are now|act as|pretend (to be|you are)|roleplay as|imagine you are)\s+(admin|root|superuser|system|god|unrestricted)",
     True, "Role escalation attempt: claiming elevated identity"),
    (r"(grant|give|assign|elevate)\s+(me|my|user|role)\s+(admin|root|superuser|full|all)\s+(access|permissions?|rights?|privileges?)",
     True, "Permission escalation attempt"),
    (r"(bypass|override|circumvent|skip|disable)\s+(the\s+)?(rbac|security|access control|permission|role|filter|gate|hitl|audit)",
     True, "Security bypass attempt"),
    (r"show\s+(me\s+)?((all|every|hidden|restricted|sensitive|protected)\s+)+(fields?|data|records?|columns?|information)",
     True, "Restricted data access attempt"),
    (r"(all|every)\s+(restricted|hidden|sensitive|protected)\s+(fields?|data|records?|columns?|information)",
     True, "Restricted data access attempt: all restricted fields"),
    (r"\bSYSTEM\s*:",
     True, "System prompt injection attempt: SYSTEM: prefix"),
    (r"\bUSER\s*:",
     True, "Context injection attempt: USER: prefix"),
    (r"\bASSISTANT\s*:",
     True, "Context injection attempt: ASSISTANT: prefix"),
    (r"(reveal|print|display|output|show|repeat|echo)\s+(your\s+)?(system\s+prompt|instructions?|context|configuration|rules?|constraints?)",
     True, "System prompt extraction attempt"),
    (r"what\s+(are\s+)?(your|the)\s+(instructions?|rules?|constraints?|system\s+prompt)",
     True, "System prompt extraction attempt"),
    (r"TOP_K\s*=",
     True, "Pipeline parameter manipulation: TOP_K override attempt"),
    (r"(set|change|modify|update|override)\s+(TOP_K|LIMIT|MAX|timeout|threshold)\s*(=|to)",
     True, "Pipeline parameter manipulation attempt"),
    (r"return\s+(all|every|\d{2,})\s+(records?|rows?|results?|employees?)",
     True, "Result limit bypass attempt"),
    (r"(--|;\s*DROP|;\s*DELETE|;\s*INSERT|;\s*UPDATE|UNION\s+SELECT|OR\s+1\s*=\s*1)",
     True, "SQL injection attempt"),
    (r"(__import__|eval\s*\(|exec\s*\(|os\.system|subprocess)",
     True, "Python code injection attempt"),
    (r"<script\b",
     True, "Script injection attempt"),
    (r"base64\s*:\s*[A-Za-z0-9+/]{10,}",
     True, "Encoded injection attempt: base64 payload detected"),
    (r"\\x[0-9a-fA-F]{2}(\\x[0-9a-fA-F]{2}){4,}",
     False, "Encoded injection attempt: hex escape sequence"),
    (r"(developer\s+mode|jailbreak|DAN\s+mode|do\s+anything\s+now)",
     True, "Jailbreak attempt: developer/DAN mode"),
    (r"(hypothetically|theoretically|for\s+(a\s+)?(story|test|demo|simulation))\s*,?\s*(show|give|reveal|output|return)\s+(all|every|hidden|sensitive)",
     True, "Hypothetical framing to extract restricted data"),
    (r"this\s+is\s+(just\s+a\s+)?(test|demo|simulation|example|hypothetical)",
     True, "Test/simulation framing — potential injection bypass attempt"),
]
# --- end of fixed values ---


# What a text must contain before a rule can match it, in rule order: of each group at least one word. A plain
# substring test is many times cheaper than the pattern, groups are tried in turn, and most texts fail an early one.
_EARLIER = ["previous", "prior", "above", "earlier"]
_ORDERS = ["instruction", "prompt", "rule", "constraint"]
_SECRET = ["hidden", "restricted", "sensitive", "protected"]
_DATA = ["field", "data", "record", "column", "information"]
NEEDED: list[list[list[str]]] = [
    [["ignore"], _EARLIER, _ORDERS],
    [["disregard"], [*_EARLIER, "your"]],
    [["forget"], [*_EARLIER, "your"], _ORDERS],
    [["instruction", "rule", "directive", "order", "task"], ["new", "updated", "revised"], ["are", "is", "follow", ":"]],
    [["you are now", "act as", "pretend", "roleplay as", "imagine you are"],
     ["admin", "root", "superuser", "system", "god", "unrestricted"]],
    [["access", "permission", "right", "privilege"], ["grant", "give", "assign", "elevate"], ["admin", "root", "superuser", "full", "all"]],
    [["bypass", "override", "circumvent", "skip", "disable"],
     ["rbac", "security", "access control", "permission", "role", "filter", "gate", "hitl", "audit"]],
    [["show"], ["all", "every", *_SECRET], _DATA],
    [_SECRET, ["all", "every"], _DATA],
    [[":"], ["system"]],
    [[":"], ["user"]],
    [[":"], ["assistant"]],
    [["prompt", "instruction", "context", "configuration", "rule", "constraint"],
     ["reveal", "print", "display", "output", "show", "repeat", "echo"]],
    [["what"], _ORDERS, ["your", "the"]],
    [["top_k"], ["="]],
    [["top_k", "limit", "max", "timeout", "threshold"], ["set", "change", "modify", "update", "override"], ["=", "to"]],
    [["return"], ["record", "row", "result", "employee"]],
    [["--", ";", "union", "="], ["--", "drop", "delete", "insert", "update", "select", "1"]],
    [["__import__", "eval", "exec", "os.system", "subprocess"]],
    [["<script"]],
    [["base64"], [":"]],
    [["\\x"]],
    [["mode", "jailbreak", "anything"]],
    [["hypothetically", "theoretically", "story", "test", "demo", "simulation"], ["show", "give", "reveal", "output", "return"],
     ["all", "every", "hidden", "sensitive"]],
    [["test", "demo", "simulation", "example", "hypothetical"], ["this"]],
]
# The non-ASCII letters that case-insensitive matching equates with ASCII ones.
FOLDED = ("\u017f\u212a\u0130\u0131", "skii")


def folded(text: Column) -> Column:
    """Text for the substring tests: lower case, with every letter that matches an ASCII one as that."""
    return F.lower(F.translate(text, *FOLDED))


def _possible(low: Column, groups: Sequence[Sequence[str]]) -> Column:
    found = [reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) for words in groups]
    return reduce(lambda a, b: a & b, found)


def java_pattern(pattern: str, ignore_case: bool) -> str:
    """The rules assume Unicode-aware classes and case folding; Java needs the flags spelled out."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def injection_rule(text: Column, low: Column | None = None) -> Column:
    """Position of the first matching rule, NULL when none matches.

    Rules are tried in order inside one CASE, so a row stops at its first hit. low: folded(text),
    when the caller holds it as a column of its own.
    """
    low = folded(text) if low is None else low
    chain = F
    for i, ((pattern, ignore_case, _), groups) in enumerate(zip(RULES, NEEDED, strict=True)):
        chain = chain.when(_possible(low, groups) & text.rlike(java_pattern(pattern, ignore_case)), i)
    return chain


def rule_description(rule: Column) -> Column:
    names = F.array(*[F.lit(d) for _, _, d in RULES])
    return F.when(rule.isNotNull(), F.get(names, rule))


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(i, p, c, d) for i, (p, c, d) in enumerate(RULES)]
    return spark.createDataFrame(rows, "ord int, regex string, case_insensitive boolean, description string")

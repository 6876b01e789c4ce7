"""Second-person release gate: authorisation, PIN check, three-strike lockout, escalation.

Requests and PIN attempts are tables; all requests are decided in one plan. Attempts count in the
order (time, request, attempt number), repeats of a delivered row once and those without a time first; see `tries`.
A lock is final until the supervisor table is re-seeded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import policy
from wardline.functions import text
from wardline.operators import tries
from wardline.operators.ordered import MAX_KEY_ROWS, running_marks
from wardline.operators.ratelimit import micros

# --- fixed values: decision texts of the gate ---
NO_ID = "DENIED — No supervisor ID entered"
NOT_FOUND = ("DENIED — Supervisor ", " not found")
LOCKED = ("DENIED — Supervisor ", " account is locked")
NOT_AUTHORISED = "DENIED — Supervisor not authorised for role "
LOCKED_NOW = ("DENIED — Supervisor ", f" locked after {policy.MAX_FAILED_ATTEMPTS} failed attempts")
UNVERIFIED = "DENIED — PIN verification failed"
ALERT_SUBJECT = ("Supervisor account locked (request ", ")")  # around the id's first 8 characters
ALERT_TIME = "yyyy-MM-dd HH:mm:ss 'UTC'"
# --- end of fixed values ---
OWN_REQUEST = "DENIED — Requester and supervisor are the same person"

ORDER = ["us", "request_id", "attempt_no"]


def lockout(attempts: DataFrame, supervisors: DataFrame | None = None,
            max_failed: int = policy.MAX_FAILED_ATTEMPTS, max_key_rows: int = MAX_KEY_ROWS) -> DataFrame:
    """PIN attempts with the counter they leave behind.

    attempts: supervisor_id, request_id, attempt_no, ts, ok. Adds failed_after (wrong PINs since the
    last correct one, history included), remaining, locks (this attempt locks the account) and
    counted (false for an attempt after the lock: it changes nothing and has no counter).

    The counter is a distance between positions: this row's number less the number of the last
    correct row. Later rows cannot move the first lock, so one pass is exact. supervisors: snapshot
    with failed_attempts and is_locked; an already locked account counts nothing, and neither does
    one whose counter is full although it is not locked, nor an id that the snapshot does not hold.
    """
    rows = attempts.select("supervisor_id", "request_id", "attempt_no", micros().alias("us"), "ok")
    if supervisors is not None:
        seed = supervisors.select(
            "supervisor_id", F.coalesce("failed_attempts", F.lit(0)).alias("failed_before"),
            F.coalesce("is_locked", F.lit(False)).alias("locked_before"))
        rows = rows.join(seed, "supervisor_id", "left").withColumn(
            "locked_before", F.coalesce("locked_before", F.lit(True)))
    else:
        rows = rows.withColumn("failed_before", F.lit(0)).withColumn("locked_before", F.lit(False))
    rows = (rows.withColumn("failed_before", F.coalesce("failed_before", F.lit(0)))
            .withColumn("shut", F.col("locked_before") | (F.col("failed_before") >= max_failed)))
    marked = running_marks(rows, "supervisor_id", ORDER, "ok", max_key_rows)
    streak = F.col("seq") - F.coalesce(F.col("mark_seq"), -F.col("failed_before"))
    place = F.struct(*ORDER)
    marked = marked.withColumn("failed_after", F.when(F.col("ok"), F.lit(0)).otherwise(streak))
    # first attempt that fills the counter, per supervisor: a partial aggregate, no second window
    locks = (marked.filter(~F.col("shut") & (F.col("failed_after") >= max_failed))
             .groupBy("supervisor_id").agg(F.min(place).alias("lock_at")))
    return (marked.join(locks, "supervisor_id", "left")
            .withColumn("locks", F.coalesce(place == F.col("lock_at"), F.lit(False)))
            .withColumn("counted", ~F.col("shut") & F.coalesce(place <= F.col("lock_at"), F.lit(True)))
            .withColumn("failed_after", F.when(F.col("counted"), F.col("failed_after")))
            .withColumn("remaining", max_failed - F.col("failed_after"))
            .withColumn("ts", F.timestamp_micros("us"))
            .select("supervisor_id", "request_id", "attempt_no", "ts", "ok", "failed_after",
                    "remaining", "locks", "counted", "seq"))


def supervisor_state(snapshot: DataFrame, decided: DataFrame) -> DataFrame:
    """The supervisor table after the attempts, to be written over the old snapshot. An untouched
    supervisor keeps its row."""
    last = decided.filter("counted").groupBy("supervisor_id").agg(
        F.max_by("failed_after", "seq").alias("new_failed"),
        F.max("locks").alias("now_locked"),
        F.max(F.when(F.col("locks"), F.col("request_id"))).alias("lock_request"))
    touched = F.col("now_locked").isNotNull()
    return (snapshot.join(last, "supervisor_id", "left")
            .withColumn("failed_attempts", F.when(touched, F.col("new_failed"))
                        .otherwise(F.col("failed_attempts")).cast("long"))
            .withColumn("is_locked", F.when(touched, F.col("now_locked")).otherwise(F.col("is_locked")))
            .withColumn("locked_by_session", F.when(touched, F.coalesce("lock_request", F.lit("")))
                        .otherwise(F.col("locked_by_session")))
            .select(snapshot.columns))


def may_approve(roles_json: Column, role: Column) -> Column:
    """Is the role in the supervisor's JSON list? A malformed list approves nothing."""
    return F.array_contains(text.parse_list(roles_json), role)


def requester_is_approver(requester: Column, supervisor_id: Column) -> Column:
    """The strict two-person check, for callers whose requests carry a requester id."""
    return F.coalesce(text.supervisor_id(requester) == supervisor_id, F.lit(False))


def entered_ids(attempts: DataFrame) -> DataFrame:
    """(request_id, supervisor_id, first_us, first_no): the id a request's first attempt names."""
    first = F.min(F.struct("attempt_no", micros().alias("us"),
                           text.supervisor_id(F.col("supervisor_id")).alias("sup")))
    return attempts.groupBy("request_id").agg(first.alias("f")).select(
        "request_id", F.col("f.sup").alias("supervisor_id"), F.col("f.us").alias("first_us"),
        F.col("f.attempt_no").alias("first_no"))


def gate(requests: DataFrame, attempts: DataFrame, supervisors: DataFrame,
         max_key_rows: int = MAX_KEY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(decisions, decided attempts).

    requests: request_id, user_role and optionally requester_id; those that need review. attempts:
    request_id, supervisor_id, attempt_no, ts, pin. decisions: request_id, supervisor_id,
    hitl_decision, gate_decision, locked_now. Decided attempts also have their position in the request.

    Check order: id entered, supervisor known, not locked, not the requester (where requester_id is
    given), may approve the role, PIN. A request whose PIN tries run out without an answer is not released.
    """
    asked = requests.select("request_id", "user_role", (
        F.col("requester_id") if "requester_id" in requests.columns else F.lit(None)).cast("string").alias("requester_id"))
    dim = supervisors.select(
        "supervisor_id", "hashed_pin", "can_approve_roles", "failed_attempts", "is_locked",
        F.lit(True).alias("known"))
    faced = (asked.join(entered_ids(attempts), "request_id", "left").join(dim, "supervisor_id", "left")
             .withColumn("known", F.coalesce("known", F.lit(False)))
             .withColumn("own", requester_is_approver(F.col("requester_id"), F.col("supervisor_id")))
             .withColumn("authorised", F.col("known") & ~F.col("own") & F.coalesce(
                 may_approve(F.col("can_approve_roles"), F.col("user_role")), F.lit(False))))

    # Only attempts of a request whose supervisor exists and may approve the role touch the counter.
    eligible = faced.filter(F.col("authorised")).select("request_id", "supervisor_id", "hashed_pin")
    digest = text.pin_hash(F.col("pin"))
    tried = (attempts.select("request_id", "attempt_no", "ts", digest.alias("digest")).join(eligible, "request_id")
             .withColumn("ok", F.coalesce(F.col("digest") == F.col("hashed_pin"), F.lit(False)))
             .withColumn("digest", F.coalesce("digest", F.lit(""))).drop("hashed_pin"))
    # read by the outcomes, the locks, the alerts and the new supervisor table
    decided = tries.played(tried, supervisors, attempts.count(), max_key_rows)

    outcome = decided.filter("counted").groupBy("request_id").agg(
        F.max("ok").alias("pin_ok"), F.max("locks").alias("locked_now"))
    lock_at = decided.filter("locks").select("supervisor_id", F.struct(
        "seq.us", F.col("seq.request_id"), F.col("seq.attempt_no")).alias("lock_at"))
    place = F.struct(F.coalesce("first_us", F.lit(tries.NO_TIME)).alias("us"), "request_id",
                     F.col("first_no").cast("int").alias("attempt_no"))
    sup = F.col("supervisor_id")

    def about(texts: tuple[str, str]) -> Column:
        return F.concat(F.lit(texts[0]), sup, F.lit(texts[1]))

    pin_ok, locked_now = (F.coalesce(c, F.lit(False)) for c in ("pin_ok", "locked_now"))
    decisions = (
        faced.join(lock_at, "supervisor_id", "left").join(outcome, "request_id", "left")
        .withColumn("locked_before", F.coalesce("is_locked", F.lit(False))
                    | F.coalesce(place > F.col("lock_at"), F.lit(False)))
        .withColumn("gate_decision",
                    F.when(sup.isNull(), NO_ID)
                    .when(~F.col("known"), about(NOT_FOUND))
                    .when(F.col("locked_before"), about(LOCKED))
                    .when(F.col("own"), OWN_REQUEST)
                    .when(~F.col("authorised"), F.concat(F.lit(NOT_AUTHORISED), "user_role"))
                    .when(locked_now, about(LOCKED_NOW))
                    .when(pin_ok, "APPROVED").otherwise(UNVERIFIED))
        .select("request_id", "supervisor_id", "gate_decision",
                F.when(F.col("gate_decision") == "APPROVED", "approve").otherwise("reject")
                .alias("hitl_decision"),
                (locked_now & (F.col("gate_decision") == about(LOCKED_NOW))).alias("locked_now")))
    return decisions, decided


def escalations(lock_events: DataFrame, contact: DataFrame) -> DataFrame:
    """Outbox rows, one per lockout, addressed to the manager's contact (a one-row table).

    lock_events: request_id, ts, user_role, query, supervisor_id, supervisor_name, failed_attempts.
    """
    failed = F.col("failed_attempts").cast("string")
    sent = F.coalesce(F.date_format(F.convert_timezone(None, F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), ALERT_TIME),
                      F.lit("an unrecorded time"))
    body = F.concat(
        F.coalesce("supervisor_name", F.lit("")), F.lit(" ("), F.col("supervisor_id"), F.lit(") may approve nothing more: wrong PINs "),
        failed, F.lit(f" of {policy.MAX_FAILED_ATTEMPTS}.\nThe last one came at "), sent,
        F.lit(" for request "), F.col("request_id"), F.lit(" of role "), F.coalesce("user_role", F.lit("")),
        F.lit(", which is refused; nothing was released for it.\nIt asked: \""), F.coalesce("query", F.lit("")), F.lit('"\n'))
    return lock_events.select(
        "request_id", "supervisor_id", "ts",
        contact.select("email").scalar().alias("send_to"),
        F.concat(F.lit(ALERT_SUBJECT[0]), F.substring("request_id", 1, 8), F.lit(ALERT_SUBJECT[1]))
        .alias("subject"),
        body.alias("body"))

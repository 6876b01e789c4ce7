import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import seeds
from wardline import schemas
from wardline.operators import gate, tries
from wardline.sources import tables

BASE = 1_704_067_200 * 10**6


def tries_frame(spark, rows):
    """rows: request_id, supervisor_id, attempt_no, seconds, pin"""
    return spark.createDataFrame(rows, "request_id string, supervisor_id string, attempt_no int, s long, pin string").select(
        "request_id", "supervisor_id", "attempt_no",
        F.timestamp_micros(F.lit(BASE) + F.col("s") * 1_000_000).alias("ts"), "pin")


def decide(spark, roles, rows, supervisors=None, **kw):
    sup = seeds.seed_dims(spark)[0] if supervisors is None else supervisors
    reqs = spark.createDataFrame(list(roles.items()), "request_id string, user_role string")
    decisions, tried = gate.gate(reqs, tries_frame(spark, rows), sup, **kw)
    state = {r.supervisor_id: r for r in gate.supervisor_state(sup, tried).collect()}
    return {r.request_id: r for r in decisions.collect()}, state, tried


def test_each_outcome(spark):
    roles = {"a": "HR_Admin", "b": "HR_Admin", "c": "HR_Admin", "d": "HR_Admin", "e": "Finance_Lead", "f": "Medical_Lead"}
    rows = [("b", "SUP999", 1, 1, "1234"), ("c", "SUP002", 1, 2, "5678"), ("d", " sup003 ", 1, 3, " 9999 "),
            ("e", "SUP002", 1, 4, "x"), ("e", "SUP002", 2, 5, "5678"), ("f", "SUP001", 1, 6, "x"), ("f", "  ", 2, 7, "y")]
    got, state, _ = decide(spark, roles, rows)
    said = {k: v.gate_decision for k, v in got.items()}
    assert said == {
        "a": "DENIED — No supervisor ID entered", "b": "DENIED — Supervisor SUP999 not found",
        "c": "DENIED — Supervisor not authorised for role HR_Admin", "d": "APPROVED", "e": "APPROVED",
        "f": "DENIED — PIN verification failed"}
    assert {k for k, v in got.items() if v.hitl_decision == "approve"} == {"d", "e"}
    assert state["SUP003"].failed_attempts == 0 and state["SUP003"].locked_by_session == ""
    assert state["SUP002"].failed_attempts == 0 and state["SUP001"].failed_attempts == 2


def test_three_misses_lock_within_and_across_requests(spark):
    roles = {k: "HR_Admin" for k in "abcdef"}
    rows = [("a", "SUP001", i, i, "bad") for i in (1, 2, 3)]
    rows += [("b", "SUP001", 1, 10, "1234"), ("c", "SUP003", 1, 20, "bad"), ("d", "SUP003", 1, 30, "bad"),
             ("e", "SUP003", 1, 40, "bad"), ("e", "SUP003", 2, 41, "9999"), ("f", "SUP003", 1, 50, "9999")]
    got, state, tried = decide(spark, roles, rows)
    assert got["a"].gate_decision == "DENIED — Supervisor SUP001 locked after 3 failed attempts" and got["a"].locked_now
    assert got["b"].gate_decision == "DENIED — Supervisor SUP001 account is locked"
    assert got["d"].gate_decision == "DENIED — PIN verification failed"
    assert got["e"].gate_decision == "DENIED — Supervisor SUP003 locked after 3 failed attempts"
    assert got["f"].gate_decision == "DENIED — Supervisor SUP003 account is locked"
    assert state["SUP001"].is_locked and state["SUP001"].locked_by_session == "a" and state["SUP003"].locked_by_session == "e"
    assert tried.filter("locks").count() == 2


def test_success_resets_the_counter(spark):
    roles = {k: "HR_Admin" for k in "abc"}
    rows = [("a", "SUP001", 1, 1, "bad"), ("a", "SUP001", 2, 2, "bad"), ("a", "SUP001", 3, 3, "1234"),
            ("b", "SUP001", 1, 4, "bad"), ("b", "SUP001", 2, 5, "bad"), ("b", "SUP001", 3, 6, "1234"),
            ("c", "SUP001", 1, 7, "1234"), ("c", "SUP001", 2, 8, "bad"), ("c", "SUP001", 3, 9, "bad")]
    got, state, tried = decide(spark, roles, rows)
    assert {v.gate_decision for v in got.values()} == {"APPROVED"}
    assert state["SUP001"].failed_attempts == 0 and not state["SUP001"].is_locked
    assert tried.filter("request_id = 'c'").count() == 1  # what follows a success is ignored


def test_unauthorised_requests_do_not_touch_the_counter_but_see_the_lock(spark):
    roles = {"a": "Finance_Lead", "b": "HR_Admin", "c": "HR_Admin"}
    rows = [("b", "SUP002", i, i, "bad") for i in (1, 2, 3)] + [("a", "SUP002", i, 10 + i, "bad") for i in (1, 2, 3)]
    rows += [("c", "SUP002", 1, 30, "5678")]
    got, state, _ = decide(spark, roles, rows)
    assert got["b"].gate_decision == "DENIED — Supervisor not authorised for role HR_Admin"
    assert got["a"].gate_decision == "DENIED — Supervisor SUP002 locked after 3 failed attempts"
    assert got["c"].gate_decision == "DENIED — Supervisor SUP002 account is locked"


def snapshot(spark, **changes):
    rows = [{**r.asDict(), **changes.get(r.supervisor_id, {})} for r in seeds.seed_dims(spark)[0].collect()]
    return spark.createDataFrame([tuple(r[c] for c in schemas.SUPERVISORS.names) for r in rows], schemas.SUPERVISORS)


def test_snapshot_states(spark):
    sup = snapshot(spark, SUP001={"is_locked": True}, SUP002={"failed_attempts": 3},
                   SUP003={"failed_attempts": 2, "can_approve_roles": '["HR_Admin"]'})
    roles = {"a": "HR_Admin", "b": "Finance_Lead", "c": "HR_Admin", "d": "Finance_Lead"}
    rows = [("a", "SUP001", 1, 1, "1234"), ("b", "SUP002", 1, 2, "5678"), ("c", "SUP003", 1, 3, "bad"), ("d", "SUP003", 1, 1, "9999")]
    got, state, _ = decide(spark, roles, rows, sup)
    assert got["a"].gate_decision == "DENIED — Supervisor SUP001 account is locked"
    assert got["b"].gate_decision == "DENIED — PIN verification failed"  # counter full, not locked: no try
    assert not state["SUP002"].is_locked and state["SUP002"].failed_attempts == 3
    assert got["c"].gate_decision == "DENIED — Supervisor SUP003 locked after 3 failed attempts"
    assert got["d"].gate_decision == "DENIED — Supervisor not authorised for role Finance_Lead"
    bad = snapshot(spark, SUP003={"can_approve_roles": "not json"})
    got, _, _ = decide(spark, {"x": "HR_Admin"}, [("x", "SUP003", 1, 1, "9999")], bad)
    assert got["x"].gate_decision == "DENIED — Supervisor not authorised for role HR_Admin"


def machine(rows, failed_before):
    """rows: (supervisor, us, request, ok) -> {request: (failed_after, locks, counted)}"""
    out = {}
    for sup in {r[0] for r in rows}:
        n, locked = failed_before.get(sup, 0), False
        shut = n >= 3 or sup not in failed_before
        for _, _, req, ok in sorted(r for r in rows if r[0] == sup):
            if locked or shut:
                out[req] = (None, False, False)
                continue
            n = 0 if ok else n + 1
            locked = n >= 3
            out[req] = (n, locked, True)
    return out


@pytest.mark.parametrize("max_key_rows", [10_000, 30], ids=["one window", "hot keys in pieces"])
def test_lockout_equals_state_machine(spark, max_key_rows):
    rng, rows = random.Random(11), []
    for sup, n, p in (("hot", 900, 0.9), ("hot2", 400, 0.75), ("rare", 5, 0.2), ("seeded", 40, 0.6), ("full", 40, 0.5), ("calm", 29, 0.95), ("nobody", 40, 0.2)):
        for _ in range(n):
            rows.append((sup, BASE + rng.randrange(500) * 1_000_000, f"q{len(rows):05d}", rng.random() < p))
    before = {"hot": 0, "hot2": 0, "rare": 0, "calm": 0, "seeded": 2, "full": 3}
    df = spark.createDataFrame(rows, "supervisor_id string, us long, request_id string, ok boolean").select(
        "supervisor_id", "request_id", F.lit(1).alias("attempt_no"), F.timestamp_micros("us").alias("ts"), "ok")
    sup = spark.createDataFrame([(k, False, v) for k, v in before.items()], "supervisor_id string, is_locked boolean, failed_attempts long")
    got = {r.request_id: (r.failed_after, r.locks, r.counted) for r in gate.lockout(df, sup, max_key_rows=max_key_rows).collect()}
    assert got == machine(rows, before)


def test_hot_and_plain_paths_agree_in_the_gate(spark, small):
    from wardline.sources import mapping as m
    args = m.requests(spark, small).select("request_id", "user_role"), m.pin_attempts(spark, small), m.supervisors(spark, small)
    a, b = gate.gate(*args)[0], gate.gate(*args, max_key_rows=3)[0]
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_seeds_and_contact(spark):
    sup, man = seeds.seed_dims(spark, "boss@example.com")
    rows, managers = (x.collect() for x in tables.verify_readback(sup, man))
    assert [(r.supervisor_id, r.roles) for r in rows] == [
        ("SUP001", ["HR_Admin", "Medical_Lead"]), ("SUP002", ["Finance_Lead"]),
        ("SUP003", ["HR_Admin", "Medical_Lead", "Finance_Lead", "General_Staff"])]
    assert managers[0].email == "boss@example.com"
    assert sup.filter("supervisor_id = 'SUP001'").first().can_approve_roles == '["HR_Admin", "Medical_Lead"]'
    assert tables.manager_contact(man).first().email == "boss@example.com"
    assert tables.manager_contact(man.filter("false"), "fb@example.com").first().email == "fb@example.com"


def test_strict_two_person_check(spark):
    row = spark.range(1).select(gate.requester_is_approver(F.lit(" sup001"), F.lit("SUP001")).alias("x"),
                                gate.requester_is_approver(F.lit(None).cast("string"), F.lit("SUP001")).alias("y")).first()
    assert (row.x, row.y) == (True, False)


def test_a_request_has_no_more_tries_than_at_its_first(spark):
    """Another request's success in between clears the counter but gives no further try."""
    rows = [("a", "SUP001", 1, 1, "bad"), ("a", "SUP001", 2, 2, "bad"), ("b", "SUP001", 1, 3, "1234"),
            ("a", "SUP001", 3, 4, "bad"), ("a", "SUP001", 4, 5, "1234")]
    got, state, _ = decide(spark, {"a": "HR_Admin", "b": "HR_Admin"}, rows, snapshot(spark))
    assert got["a"].gate_decision == "DENIED — PIN verification failed" and got["b"].gate_decision == "APPROVED"
    assert state["SUP001"].failed_attempts == 1
    # With one miss before, two tries are left: the third never happens.
    rows = [("a", "SUP001", 1, 1, "bad"), ("b", "SUP001", 1, 2, "1234"), ("a", "SUP001", 2, 3, "bad"), ("a", "SUP001", 3, 4, "1234")]
    got, _, _ = decide(spark, {"a": "HR_Admin", "b": "HR_Admin"}, rows, snapshot(spark, SUP001={"failed_attempts": 1}))
    assert got["a"].gate_decision == "DENIED — PIN verification failed" and got["b"].gate_decision == "APPROVED"


def test_nobody_approves_the_own_request(spark):
    reqs = spark.createDataFrame([("a", "HR_Admin", " sup001"), ("b", "HR_Admin", "SUP002"), ("c", "HR_Admin", None)],
                                 "request_id string, user_role string, requester_id string")
    rows = [(r, "SUP001", 1, i, "1234") for i, r in enumerate("abc")]
    decisions, tried = gate.gate(reqs, tries_frame(spark, rows), seeds.seed_dims(spark)[0])
    got = {r.request_id: r.gate_decision for r in decisions.collect()}
    assert got == {"a": gate.OWN_REQUEST, "b": "APPROVED", "c": "APPROVED"}
    assert sorted(r.request_id for r in tried.collect()) == ["b", "c"]


def sequential(roles, rows, before):
    """One supervisor's entries at a time, one entry at a time, as a person at the desk would. rows: request_id,
    supervisor_id, attempt_no, seconds or None, pin; before: supervisor -> (right pin, counter, locked)."""
    out = {}
    for sup, (right, c, locked) in before.items():
        shut, left, done, at_lock = locked or c >= 3, {}, set(), None
        mine = {(s, r, n, p) for r, of, n, s, p in rows if of == sup and r in roles}
        by_time = sorted(mine, key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2], e[3] == right,
                                              hashlib.sha256(e[3].encode()).hexdigest()))
        first = {}
        for s, r, n, _ in by_time:
            first[r] = min(first.get(r, (n, s is not None, s or 0)), (n, s is not None, s or 0))
        for s, r, n, pin in by_time:
            if shut or at_lock or r in done:
                continue
            left.setdefault(r, 3 - c)
            if not left[r]:
                continue
            left[r] -= 1
            if pin == right:
                c = 0
                done.add(r)
                out[r] = "APPROVED"
                continue
            c += 1
            out[r] = "DENIED — PIN verification failed"
            if c == 3:
                at_lock = (s is not None, s or 0, r, n)
                out[r] = f"DENIED — Supervisor {sup} locked after 3 failed attempts"
        for r, (n, timed, s) in first.items():
            if locked or (at_lock and (timed, s, r, n) > at_lock):
                out[r] = f"DENIED — Supervisor {sup} account is locked"
            out.setdefault(r, "DENIED — PIN verification failed")
        out[sup] = (c, bool(at_lock) or locked)
    return out


def interleaved(rng, n_requests, spread, wrong):
    """Requests of one to four entries, begun close together; some rows repeated, some without a time."""
    rows = []
    for r in range(n_requests):
        at = rng.randrange(spread)
        timeless = rng.random() < 0.03
        for n in range(1, rng.randrange(2, 6)):
            at += rng.randrange(1, 9)
            row = (f"r{r:04d}", "SUP001" if r % 9 else "SUP003", n, None if timeless else at,
                   rng.choice(["bad", "worse"]) if rng.random() < wrong else {0: "9999"}.get(r % 9, "1234"))
            rows += [row] * (2 if rng.random() < 0.1 else 1)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("max_key_rows", [10_000, 12], ids=["plain", "in pieces"])
@pytest.mark.parametrize("seed,wrong", [(1, 0.25), (2, 0.4), (3, 0.1), (4, 0.15)])
def test_gate_equals_the_desk(spark, seed, wrong, max_key_rows):
    rows = interleaved(random.Random(seed), 160, 400, wrong)
    roles = {f"r{r:04d}": "HR_Admin" for r in range(160)}
    sup = snapshot(spark, SUP003={"failed_attempts": seed % 3})
    got, state, _ = decide(spark, roles, rows, sup, max_key_rows=max_key_rows)
    expect = sequential(roles, rows, {"SUP001": ("1234", 0, False), "SUP003": ("9999", seed % 3, False)})
    assert {r: got[r].gate_decision for r in roles} == {r: expect[r] for r in roles}
    assert all((state[s].failed_attempts, state[s].is_locked) == expect[s] for s in ("SUP001", "SUP003"))


def settled_by_pieces(rows, cuts, start):
    """The walk over pieces without Spark: rows sorted, cut anywhere."""
    out, first, open_ = {}, {}, []
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        piece, last = tries._Piece(start, False, i == 0), None
        found = []
        for row in rows[a:b]:
            found += piece.step(row)
            last = row
        found += piece.end(last) if last else []
        for verdict in map(tries._verdict, found):
            if verdict["open"]:
                open_.append(verdict)
                continue
            out[verdict["at"]] = verdict
            if verdict["no"] == 1 and not verdict["ok"] and verdict["failed_after"] is not None:
                first[verdict["request_id"]] = verdict["failed_after"] - 1
    columns = tries._SETTLED.split(", ")
    names = [c.split()[0] for c in columns]
    walked = [dict(zip(names, (r.get(n) for n in names), strict=True)) | {"first": first.get(r["request_id"])}
              for r in sorted(open_, key=lambda r: (r["at"], r["mark"]))]
    if walked:
        for batch in tries._resolve(iter([pa.RecordBatch.from_pylist(walked, pa.schema(
                [(n, pa.string() if n in ("supervisor_id", "request_id", "digest") else pa.bool_() if n in (
                    "ok", "shut", "happens", "locks", "open") else pa.int64()) for n in names]))])):
            for r in batch.to_pylist():
                out[r["us"]] = r
    return out, len([r for r in open_ if not r["mark"]])


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 2), st.lists(st.integers(0, 60), max_size=6))
def test_any_cuts_settle_the_same(seed, start, cuts):
    """A supervisor's rows cut into any pieces give the verdicts of one uncut walk, up to the first lock."""
    rng = random.Random(seed)
    rows, left = [], []
    for r in range(30):
        n = rng.randrange(1, 4)
        left += [f"q{r}"] * n
    rng.shuffle(left) if seed % 2 else None
    won, no = set(), Counter()
    for request in left:
        if request in won:
            continue
        no[request] += 1
        ok = rng.random() < 0.55
        won |= {request} if ok else set()
        rows.append({"supervisor_id": "s", "request_id": request, "us": len(rows), "at": len(rows), "attempt_no": no[request], "ok": ok,
                     "digest": "", "no": no[request], "start": start, "shut": False, "first": None})
    for row in rows:
        row["n"] = no[row["request_id"]]
    whole, _ = settled_by_pieces(rows, [], start)
    cut, n_open = settled_by_pieces(rows, sorted(c for c in cuts if c <= len(rows)), start)
    def until_lock(found):
        lock = min((i for i, v in found.items() if v["locks"]), default=len(rows))
        return [(i, found[i]["failed_after"], found[i]["happens"], i == lock) for i in sorted(found) if i <= lock]

    assert until_lock(whole) == until_lock(cut)


def test_only_rows_at_the_cuts_stay_open():
    """With requests that don't interleave, a piece leaves few rows open however long it is."""
    rng = random.Random(5)
    rows = []
    for r in range(3000):
        for n, ok in enumerate([False, True][rng.random() < 0.7:], 1):
            rows.append({"supervisor_id": "s", "request_id": f"q{r}", "us": len(rows), "at": len(rows), "attempt_no": n, "ok": ok,
                         "digest": "", "no": n, "n": 0, "start": 0, "shut": False, "first": None})
    for row in rows:
        row["n"] = sum(r["request_id"] == row["request_id"] for r in rows[max(0, row["at"] - 2):row["at"] + 3])
    _, n_open = settled_by_pieces(rows, [700, 1400, 2100, 2800], 0)
    assert n_open < 30


def test_a_row_delivered_twice_counts_once_and_the_gate_ends(spark):
    rows = [("a", "SUP001", 1, 1, "bad"), ("a", "SUP001", 1, 1, "bad"), ("a", "SUP001", 2, 2, "bad"), ("a", "SUP001", 3, 3, "1234")]
    got, state, tried = decide(spark, {"a": "HR_Admin"}, rows)
    assert got["a"].gate_decision == "APPROVED" and tried.count() == 3 and state["SUP001"].failed_attempts == 0
    # another PIN under the same number and time is an entry of its own, and the wrong one comes first
    rows = [("a", "SUP001", 1, 1, "1234"), ("a", "SUP001", 1, 1, "bad")]
    got, _, tried = decide(spark, {"a": "HR_Admin"}, rows)
    assert got["a"].gate_decision == "APPROVED" and [r.failed_after for r in tried.orderBy("seq").collect()] == [1, 0]


def test_entries_without_a_time_count_before_all_others(spark):
    rows = [("a", "SUP001", i, None, "bad") for i in (1, 2, 3)] + [("b", "SUP001", 1, 5, "1234")]
    got, state, tried = decide(spark, {"a": "HR_Admin", "b": "HR_Admin"}, rows)
    assert got["a"].gate_decision == "DENIED — Supervisor SUP001 locked after 3 failed attempts"
    assert got["b"].gate_decision == "DENIED — Supervisor SUP001 account is locked"
    assert state["SUP001"].is_locked and tried.count() == 4 and tried.filter("ts IS NULL").count() == 3


def test_number_of_jobs_does_not_depend_on_the_chain(spark):
    """Chains of interleaved requests that hang on each other take as many jobs as unrelated ones."""
    def jobs(rows, group):
        spark.sparkContext.setJobGroup(group, group)
        decide(spark, {r[0]: "HR_Admin" for r in rows}, rows)
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    chain = [(f"c{i:03d}", "SUP001", n, 3 * i + 4 * n, "bad" if n < 3 else "1234") for i in range(60) for n in (1, 2, 3)]
    calm = [(f"c{i:03d}", "SUP001", 1, i, "1234") for i in range(180)]
    assert abs(jobs(chain, "chain") - jobs(calm, "calm")) <= 2

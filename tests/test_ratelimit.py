import bisect
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import ratelimit
from wardline.operators.ratelimit import Limits

W = 3600 * 10**6
BASE = 1_704_067_200 * 10**6


def model(rows, prior=(), limit=10):
    """One attempt at a time, as the rule reads."""
    out = {}
    for role in {r for r, _, _ in rows}:
        log = [u for r, u, blocked in prior if r == role and not blocked]
        for us, rid in sorted((u, i) for r, u, i in rows if r == role):
            out[rid] = sum(1 for x in log if x >= us - W) >= limit
            if not out[rid]:
                log.append(us)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_role string, us long, request_id string").select(
        "user_role", "request_id", F.timestamp_micros("us").alias("ts"))


def log_frame(spark, prior):
    rows = [(r, u, b, f"p{j}") for j, (r, u, b) in enumerate(prior)]
    return spark.createDataFrame(rows, "user_role string, us long, blocked boolean, request_id string").select(
        F.timestamp_micros("us").alias("timestamp"), "user_role", "request_id", "blocked")


def decided(spark, rows, prior=None, limits=None):
    log = None if prior is None else log_frame(spark, prior)
    return {r.request_id: r.blocked for r in ratelimit.rate_limit(frame(spark, rows), log, limits).collect()}


def timeline(seed):
    rng, rows = random.Random(seed), []
    for role, gap, n in (("sparse", 4000, 60), ("even", 380, 150), ("busy", 60, 200), ("flood", 2, 1500), ("ties", 30, 200)):
        t = BASE + rng.randrange(3 * W)
        for _ in range(n):
            step = int(rng.expovariate(1 / gap) * 1e6)
            if role == "ties":
                step -= step % 10_000_000
            t += step if rng.random() > 0.03 else rng.choice([0, W - 1, W, W + 1, 4 * W])
            rows.append((role, t, f"r{len(rows):06d}"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [Limits(), Limits(max_run_rows=40, hops=12, keep=6),
                                    Limits(max_run_rows=40, hops=200, keep=2)], ids=["grouped", "rounds", "short"])
@pytest.mark.parametrize("with_prior", [False, True])
def test_equals_sequential_model(spark, limits, with_prior):
    rows, rng = timeline(7), random.Random(8)
    prior = None
    if with_prior:
        first = {}
        for role, us, _ in rows:
            first[role] = min(us, first.get(role, us))
        prior = [(role, u - rng.randrange(2 * W), rng.random() < 0.3) for role, u in first.items() for _ in range(8)]
    got = decided(spark, rows, prior, limits)
    assert got == model(rows, prior or ())
    assert any(got.values()) and not all(got.values())


@pytest.mark.parametrize("n_prior,blocked", [(5, False), (9, False), (10, True)])
def test_prior_counts(spark, n_prior, blocked):
    rows = [("HR_Admin", BASE, "now")]
    prior = [("HR_Admin", BASE - i * 10**6, False) for i in range(1, n_prior + 1)]
    prior += [("HR_Admin", BASE - i, True) for i in range(20)] + [("Finance_Lead", BASE - i, False) for i in range(20)]
    assert decided(spark, rows, prior) == {"now": blocked}


def test_window_bounds_are_inclusive(spark):
    full = [("r", BASE + i, f"a{i}") for i in range(10)]
    assert decided(spark, full + [("r", BASE + W, "z")])["z"] is True
    assert decided(spark, full + [("r", BASE + W + 1, "z")])["z"] is False


def test_blocked_attempts_never_count_and_ties_go_by_request(spark):
    rows = [("r", BASE, f"q{i:02d}") for i in range(25)]
    got = decided(spark, rows)
    assert sorted(k for k, v in got.items() if not v) == [f"q{i:02d}" for i in range(10)]


def test_rows_are_whole_and_log_has_one_row_each(spark):
    rows = timeline(3)
    log = ratelimit.ratelog(ratelimit.rate_limit(frame(spark, rows)))
    assert log.columns == ["timestamp", "user_role", "request_id", "blocked"]
    assert log.count() == len(rows) == log.select("request_id").distinct().count()


def test_attempts_trailing(spark):
    rows = timeline(5)
    by = {}
    for role, us, _ in rows:
        by.setdefault(role, []).append(us)
    for v in by.values():
        v.sort()
    expect = {i: bisect.bisect_right(by[r], u) - bisect.bisect_left(by[r], u - W) - 1 for r, u, i in rows}
    got = {r.request_id: r.n_trailing for r in ratelimit.attempts_trailing(frame(spark, rows)).collect()}
    assert got == expect


def test_window_counts(spark):
    now = F.timestamp_micros(F.lit(BASE))
    log = log_frame(spark, [("a", BASE - W, False), ("a", BASE - W - 1, False), ("a", BASE, True), ("b", BASE, False)])
    assert {tuple(r) for r in ratelimit.rate_count(log, now).collect()} == {("a", 1), ("b", 1)}
    assert {tuple(r) for r in ratelimit.ratelog_split(log, now).collect()} == {("a", 1, 1), ("b", 0, 1)}


def test_long_runs_start_their_group_limit_before_the_shuffle(spark):
    """The kept rows per interval are cut map-side: a hot role never travels whole."""
    from pyspark.sql import Window

    from tests.conftest import plan_of
    df = frame(spark, timeline(1)).withColumn("interval", F.lit(1))
    first = Window.partitionBy("user_role", "interval").orderBy("ts", "request_id")
    plan = plan_of(df.withColumn("n", F.row_number().over(first)).filter("n <= 5"))
    assert plan.count("WindowGroupLimit") >= 2


def test_attempts_without_time_or_role_are_blocked_and_kept(spark):
    df = spark.createDataFrame([(f"n{i}", "HR_Admin" if i % 2 else None, None) for i in range(30)],
                               "request_id string, user_role string, ts timestamp")
    got = ratelimit.rate_limit(df).collect()
    assert len(got) == 30 and all(r.blocked for r in got)
    assert sorted(r.n_trailing is None for r in ratelimit.attempts_trailing(df).collect()) == [True] * 30

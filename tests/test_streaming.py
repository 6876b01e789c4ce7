import datetime as dt
import os
import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests import seeds
from wardline.operators import gate, ratelimit
from wardline.plans.governed import governed_retrieval
from wardline.sources import mapping as m
from wardline.streaming import jobs, review


def in_files(df, order, path, n):
    """The rows in time order, as n files whose names and times sort the same way."""
    rows = df.withColumn("_f", F.ntile(n).over(Window.orderBy(order)))
    rows = rows.cache()
    for i in range(1, n + 1):
        part = f"{path}/tmp{i}"
        rows.filter(F.col("_f") == i).drop("_f").coalesce(1).write.parquet(part)
        (name,) = [x for x in os.listdir(part) if x.endswith(".parquet")]
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{part}/{name}", f"{path}/in/f{i}.parquet")
        stamp = time.time() - 1000 + i
        os.utime(f"{path}/in/f{i}.parquet", (stamp, stamp))
    return f"{path}/in"


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def attempts(spark):
    rng, rows, t = random.Random(2), [], 1_704_067_200
    for i in range(600):
        t += rng.choice([1, 20, 200, 900])
        rows.append((f"r{i:05d}", rng.choice("ab"), t))
    return spark.createDataFrame(rows, "request_id string, user_role string, s long").select(
        "request_id", "user_role", F.timestamp_seconds("s").alias("ts"))


def test_rate_limit_replay_equals_batch(spark, tmp_path):
    df = attempts(spark)
    path = in_files(df, "ts", str(tmp_path), 3)
    root = str(tmp_path / "out")
    jobs.rate_limit_stream(stream_of(spark, path, df.schema), root).awaitTermination()
    log = spark.read.parquet(f"{root}/ratelog")
    assert log.select("epoch").distinct().count() == 3
    got = {r.request_id: r.blocked for r in log.collect()}
    assert got == {r.request_id: r.blocked for r in ratelimit.rate_limit(df).collect()}
    assert any(got.values()) and spark.read.parquet(f"{root}/late").count() == 0


def beat(df, seconds=10**6):
    """The table with a heartbeat: a row without a request id, long after all others."""
    last = df.agg(F.max("ts")).first()[0] + dt.timedelta(seconds=seconds)
    row = df.sparkSession.range(1).select(*[(F.lit(last) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    return df.unionByName(row)


def arrival(delay):
    """Time of arrival: up to `delay` seconds after the event, in no relation to it."""
    return F.unix_micros("ts") + F.pmod(F.xxhash64("request_id", "ts"), F.lit(delay)) * 1_000_000


def test_rate_limit_out_of_order_replay_equals_batch(spark, tmp_path):
    df = attempts(spark)
    odd = df.limit(4).select(F.concat("request_id", F.lit("x")).alias("request_id"), F.lit(None).cast("string").alias("user_role"), "ts")
    odd = odd.unionByName(df.limit(3).select(F.concat("request_id", F.lit("y")).alias("request_id"), "user_role", F.lit(None).cast("timestamp").alias("ts")))
    df = df.unionByName(odd)
    path = in_files(beat(df), arrival(7200), str(tmp_path), 5)
    root = str(tmp_path / "out")
    jobs.rate_limit_stream(stream_of(spark, path, df.schema), root, delay=7200).awaitTermination()
    log = spark.read.parquet(f"{root}/ratelog")
    assert log.select("epoch").distinct().count() == 5
    assert {r.request_id: r.blocked for r in log.collect()} == {r.request_id: r.blocked for r in ratelimit.rate_limit(df).collect()}
    assert spark.read.parquet(f"{root}/late").count() == 0 and spark.read.parquet(f"{root}/pending/epoch=4").count() == 0


def test_rows_behind_the_clock_are_late(spark, tmp_path):
    df = attempts(spark)
    path = in_files(beat(df), arrival(7200), str(tmp_path), 5)
    root = str(tmp_path / "out")
    jobs.rate_limit_stream(stream_of(spark, path, df.schema), root, delay=60).awaitTermination()
    late, log = spark.read.parquet(f"{root}/late"), spark.read.parquet(f"{root}/ratelog")
    assert late.count() > 0 and late.count() + log.count() == df.count()


def test_late_attempts_are_kept_aside(spark, tmp_path):
    df = attempts(spark)
    path = in_files(df, F.desc("ts"), str(tmp_path), 2)  # the newer half arrives first
    root = str(tmp_path / "out")
    jobs.rate_limit_stream(stream_of(spark, path, df.schema), root).awaitTermination()
    late, log = spark.read.parquet(f"{root}/late"), spark.read.parquet(f"{root}/ratelog")
    assert late.count() == 300 and late.count() + log.count() == df.count()


def test_lockout_out_of_order_replay_equals_batch(spark, small, tmp_path):
    pins, sup, man = m.event_pins(spark, small), m.supervisors(spark, small), m.managers(spark, small)
    path = in_files(beat(pins, 20 * 86400), arrival(86400), str(tmp_path), 4)
    root = str(tmp_path / "out")
    jobs.lockout_stream(stream_of(spark, path, pins.schema), sup, man, root, delay=86400).awaitTermination()
    cols = ["supervisor_id", "request_id", "failed_after", "locks", "counted"]

    def rows(df):
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)

    batch = gate.lockout(pins, sup)
    done = spark.read.parquet(f"{root}/attempts")
    assert rows(done) == rows(batch) and done.select("epoch").distinct().count() > 1
    assert spark.read.parquet(f"{root}/late").count() == 0
    alerts = spark.read.parquet(f"{root}/outbox")
    assert alerts.count() == batch.filter("locks").join(sup, "supervisor_id", "left_semi").count() > 0
    assert alerts.filter("body IS NULL").isEmpty()
    state, last = ["supervisor_id", "is_locked", "failed_attempts", "locked_by_session"], max(r.epoch for r in done.select("epoch").collect())
    assert sorted(map(tuple, spark.read.parquet(f"{root}/supervisors/epoch={last}").select(*state).collect())) == sorted(
        map(tuple, gate.supervisor_state(sup, batch).select(*state).collect()))


def test_an_older_pin_is_never_applied_after_a_newer_one(spark, small, tmp_path):
    sup, man = m.supervisors(spark, small).filter("NOT is_locked AND failed_attempts = 0"), m.managers(spark, small)
    who = sup.first().supervisor_id
    given = [(who, "a", 1, 100, False), (who, "b", 1, 900, True), (who, "early", 1, 50, False), (who, "d", 1, 5000, False),
             (who, "old", 1, 60, False), (who, "none", 1, None, False), ("nobody", "c", 1, 20, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(given)], "n int, supervisor_id string, request_id string, attempt_no int, s long, ok boolean")
    df = beat(df.select("n", "supervisor_id", "request_id", "attempt_no", F.timestamp_seconds("s").alias("ts"), "ok"))
    path = in_files(df, F.col("n").asc_nulls_last(), str(tmp_path), 8)
    root = str(tmp_path / "out")
    jobs.lockout_stream(stream_of(spark, path, df.schema), sup, man, root, delay=10).awaitTermination()
    done = {r.request_id: (r.failed_after, r.counted) for r in spark.read.parquet(f"{root}/attempts").collect()}
    late = {r.request_id for r in spark.read.parquet(f"{root}/late").collect()}
    # "early" comes behind the clock, but before anything newer of its supervisor was applied
    assert late == {"old", "none"} and done == {
        "early": (1, True), "a": (2, True), "b": (0, True), "c": (None, False), "d": (1, True)}


def world_of(spark, small):
    return m.employees(spark, small), m.embeddings(spark, small), m.supervisors(spark, small), m.managers(spark, small)


def test_later_pins_out_of_order_equal_batch(spark, small, tmp_path):
    """Requests and PINs in four epochs, each out of order; most PINs come in a later epoch than their request."""
    live = m.requests(spark, small).drop("conv_id", "turn")
    pins = m.pin_attempts(spark, small).filter("ts IS NOT NULL")
    employees, embeddings, sup, man = world_of(spark, small)
    batch = governed_retrieval(live, employees, embeddings, sup, man, pins)
    asked = in_files(beat(live), arrival(600), str(tmp_path / "asked"), 4)
    entered = in_files(beat(pins), arrival(600), str(tmp_path / "pins"), 4)
    root = str(tmp_path / "out")
    review.audit_stream(stream_of(spark, asked, live.schema), stream_of(spark, entered, pins.schema), employees, embeddings,
                        sup, man, root, delay=8000, window=9000).awaitTermination()
    log = spark.read.parquet(f"{root}/audit")
    assert sorted(map(str, log.drop("epoch").collect())) == sorted(map(str, batch.audit.collect()))
    columns = batch.released.columns
    assert sorted(map(str, spark.read.parquet(f"{root}/released").select(columns).collect())) == sorted(map(str, batch.released.collect()))
    alerts = batch.escalations.columns
    assert sorted(map(str, spark.read.parquet(f"{root}/outbox").select(alerts).collect())) == sorted(map(str, batch.escalations.collect()))
    assert spark.read.parquet(f"{root}/ratelog").count() == batch.ratelog.count()
    last = max(r.epoch for r in log.select("epoch").collect())
    assert spark.read.parquet(f"{root}/open/epoch={last}").count() == 0
    assert sorted(map(str, spark.read.parquet(f"{root}/supervisors/epoch={last}").collect())) == sorted(map(str, batch.supervisors.collect()))


def test_a_pin_entered_later_releases(spark, small, tmp_path):
    """One request an epoch, its PIN in the next; one is never answered, one is answered too late."""
    employees, embeddings, _, man = world_of(spark, small)
    sup, vec = seeds.seed_dims(spark)[0], embeddings.first().embedding
    asked = spark.createDataFrame([(f"q{i}", 1000 * (i + 1), "HR_Admin", "show me the records of Ann", vec) for i in range(4)],
                                  "request_id string, s long, user_role string, query string, query_vec array<float>")
    asked = beat(asked.select("request_id", F.timestamp_seconds("s").alias("ts"), "user_role", "query", "query_vec"))
    given = [("q0", 1, 1900, "bad"), ("q0", 2, 2500, "1234"), ("q1", 1, 2600, "1234"), ("q3", 1, 9500, "1234"), ("q9", 1, 2700, "1234")]
    pins = spark.createDataFrame([(r, "SUP001", n, s, pin) for r, n, s, pin in given],
                                 "request_id string, supervisor_id string, attempt_no int, s long, pin string").select(
        "request_id", "supervisor_id", "attempt_no", F.timestamp_seconds("s").alias("ts"), "pin")
    root = str(tmp_path / "out")
    review.audit_stream(stream_of(spark, in_files(asked, "ts", str(tmp_path / "asked"), 5), asked.schema),
                        stream_of(spark, in_files(beat(pins), "ts", str(tmp_path / "pins"), 6), pins.schema),
                        employees, embeddings, sup, man, root, delay=1, window=3000).awaitTermination()
    log = {r.request_id: (r.decision, r.epoch) for r in spark.read.parquet(f"{root}/audit").collect()}
    assert {k: v[0] for k, v in log.items()} == {
        "q0": "APPROVED", "q1": "APPROVED", "q2": gate.NO_ID, "q3": gate.NO_ID}
    assert len(spark.read.parquet(f"{root}/open").filter("request_id = 'q0' AND used = 1").collect()) > 0
    assert {r.request_id for r in spark.read.parquet(f"{root}/released").collect()} == {"q0", "q1"}
    assert {r.request_id for r in spark.read.parquet(f"{root}/late_entries").collect()} == {"q3", "q9"}


def test_audit_replay_equals_batch(spark, small, tmp_path):
    live = m.requests(spark, small).drop("conv_id", "turn")
    world = (m.employees(spark, small), m.embeddings(spark, small), m.supervisors(spark, small),
             m.managers(spark, small), m.pin_attempts(spark, small))
    batch = governed_retrieval(live, *world)
    path = in_files(live, "ts", str(tmp_path), 2)
    root = str(tmp_path / "out")
    jobs.audit_stream(stream_of(spark, path, live.schema), *world, root).awaitTermination()
    got = spark.read.parquet(f"{root}/audit").drop("epoch")
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.audit.collect()))
    columns = batch.released.columns
    assert sorted(map(str, spark.read.parquet(f"{root}/released").select(columns).collect())) == sorted(
        map(str, batch.released.collect()))
    assert spark.read.parquet(f"{root}/ratelog").count() == batch.ratelog.count()


def test_late_requests_are_refused_with_an_audit_row(spark, small, tmp_path):
    live = m.requests(spark, small).drop("conv_id", "turn")
    path = in_files(live, F.desc("ts"), str(tmp_path), 2)
    root = str(tmp_path / "out")
    jobs.audit_stream(stream_of(spark, path, live.schema), m.employees(spark, small), m.embeddings(spark, small),
                      m.supervisors(spark, small), m.managers(spark, small), m.pin_attempts(spark, small),
                      root).awaitTermination()
    log = spark.read.parquet(f"{root}/audit")
    assert sorted(r.request_id for r in log.collect()) == sorted(r.request_id for r in live.collect())
    late = spark.read.parquet(f"{root}/late").select("request_id")
    refused = log.join(late, "request_id")
    assert refused.count() == late.count() > 0 and refused.filter("decision = 'APPROVED'").isEmpty()
    assert refused.filter("injection_flag = 'LATE'").count() > 0
    assert spark.read.parquet(f"{root}/released").join(late, "request_id").isEmpty()


def test_guard_stream_is_stateless(spark, small, tmp_path):
    live = m.requests(spark, small, m.stream(spark, small, "conversations")).drop("query_vec")
    out = str(tmp_path / "out")
    jobs.append_stream(jobs.stream_guard(live), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == m.requests(spark, small).count()

"""What larger tables bring: folders of files, many rows of a key, copies, many requests."""

import os
import tracemalloc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from wardline.operators import pivots, retrieval
from wardline.plans import catalogue
from wardline.sources import mapping as m
from wardline.streaming import lockout_state


def test_stream_guard_reads_a_folder_of_files(spark, small, tmp_path):
    where = str(tmp_path / "tables")
    os.makedirs(where)
    for name in ("conversations", "embeddings"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"{where}/{name}.parquet")
    expect = {r.request_id: r.flag for r in catalogue.stream_guard(spark, small).collect()}
    assert {r.request_id: r.flag for r in catalogue.stream_guard(spark, where).collect()} == expect
    assert len(expect) == m.requests(spark, small).count()


def test_scan_of_many_vectors_is_exact_in_little_memory():
    """Copies, all-zero queries and queries that are stored, against scores in double precision; the scan holds tiles only."""
    rng = np.random.default_rng(3)
    stored = rng.normal(size=(40_000, 16)).astype(np.float32)
    stored[rng.random(40_000) < 0.3] = stored[7]
    asked = stored[rng.integers(0, 40_000, 300)].astype(float)
    asked[::9] = 0.0
    names = pa.array([f"S{i:06d}" for i in range(40_000)])
    vectors = pa.ListArray.from_arrays(np.arange(0, stored.size + 1, 16, dtype=np.int32), pa.array(stored.ravel()))
    unit = retrieval._matrix(vectors)
    queries = asked / retrieval._lengths(asked)[:, None]
    tracemalloc.start()
    keys, kept = retrieval._sorted_keys(names, vectors, 5)
    tracemalloc.reset_peak()
    got = retrieval._best(pa.array([f"{i:03d}" for i in range(300)]), queries, keys, kept, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(kept) < 30_000 and peak < 30e6  # all scores of the 300 take 96 MB
    scores = np.round(queries @ unit.T, 12)
    for i in range(300):
        expect = np.lexsort((np.arange(40_000), -scores[i]))[:5]
        assert got["nric"].to_pylist()[i * 5:i * 5 + 5] == [names[j].as_py() for j in expect]
        assert np.allclose(got["score"].to_numpy()[i * 5:i * 5 + 5], scores[i][expect], rtol=0, atol=2e-12)


class Store:
    """A state store of one key that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.items, self.timers = 0, None, [], []

    def getValueState(self, name, schema):
        return Value(self)

    def getListState(self, name, schema):
        return Entries(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class Value:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls += 1
        self.store.value = value


class Entries(Value):
    def get(self):
        self.store.calls += 1
        return iter(self.store.items)

    def appendValue(self, value):
        self.store.calls += 1
        self.store.items.append(value)

    def put(self, values):
        self.store.calls += 1
        self.store.items = list(values)

    def clear(self):
        self.put([])


def test_lockout_state_asks_the_store_a_few_times_for_many_results(spark):
    """Results of 40 supervisors in one bucket, in two epochs and out of order, as one pass in time order would decide them."""
    rng = np.random.default_rng(5)
    rows = [Row(supervisor_id=f"SUP{s:02d}", request_id=f"r{i:03d}", attempt_no=1, us=int(rng.integers(0, 10**9)), ok=bool(rng.random() < 0.4),
                failed_before=0, shut=s == 3) for s in range(40) for i in range(25)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    store, account = Store(), lockout_state.Accounts([])
    account.init(store)
    got = []
    for epoch, part in enumerate((rows[:600], rows[600:])):
        got += account.handleInputRows((0,), iter(part), TimerValues(-1, 0))
        clock = 10**7 if epoch else 0  # in ms: nothing is due in the first epoch
        for at in sorted(t for t in store.timers if t < clock):
            got += account.handleExpiredTimer((0,), TimerValues(-1, clock), ExpiredTimerInfo(at))
    assert store.calls < 20 and not store.items and len(got) == len(rows)
    failed, locked, expect = {}, set(), {}
    for r in sorted(rows, key=lambda r: (r.us, r.request_id)):
        s = r.supervisor_id
        if r.shut or s in locked:
            expect[s, r.request_id] = (None, False)
            continue
        failed[s] = 0 if r.ok else failed.get(s, 0) + 1
        locked |= {s} if failed[s] >= 3 else set()
        expect[s, r.request_id] = (failed[s], True)
    assert {(r.supervisor_id, r.request_id): (r.failed_after, r.counted) for r in got} == expect


def test_a_task_of_the_pivot_search_holds_a_part_and_a_chunk(spark, monkeypatch, tmp_path):
    """Whatever the number of requests of a block: here 90 in chunks of about 8, and blocks in parts of about 16."""
    monkeypatch.setattr(pivots, "MEET_REQUESTS", 8)
    monkeypatch.setattr(pivots, "MEET_ROWS", 16)
    seen, meet = str(tmp_path), pivots._meet

    def noted(a, b, k):
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as out:
            out.write(f"{a.num_rows} {b.num_rows}")
        return meet(a, b, k)

    monkeypatch.setattr(pivots, "_meet", noted)
    rng = np.random.default_rng(6)
    vectors = [(f"S{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(200, 6)).astype(np.float32))]
    asked = [(f"r{i:02d}", v.tolist()) for i, v in enumerate(rng.normal(size=(90, 6)).astype(np.float32))]
    requests = spark.createDataFrame(asked, "request_id string, query_vec array<float>")
    stored = spark.createDataFrame(vectors, "nric string, embedding array<float>")
    got = pivots.search(requests, pivots.build(stored, 3), 4)[0].select("request_id", "nric").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in retrieval.topk(requests, stored, 4).select("request_id", "nric").collect()}
    sizes = [tuple(map(int, open(f"{seen}/{f}").read().split())) for f in os.listdir(seen)]
    assert max(a for a, _ in sizes) <= 24 and max(b for _, b in sizes) <= 40


def test_requests_of_a_task_are_held_as_they_came():
    """Not as unit vectors in double precision, which take 20 MB here and 20 more while they are made."""
    rng = np.random.default_rng(8)

    def table(n, key, vector):
        flat = pa.array(rng.normal(size=n * 64).astype(np.float32))
        return pa.table({key: [f"{i:06d}" for i in range(n)], vector: pa.ListArray.from_arrays(np.arange(0, n * 64 + 1, 64, dtype=np.int32), flat)})

    asked, stored = table(40_000, "request_id", "query_vec"), table(300, "nric", "embedding")
    tracemalloc.start()
    got = retrieval._meet(asked, stored, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 80_000 and peak < 25e6
    scores = retrieval._matrix(asked["query_vec"]) @ retrieval._matrix(stored["embedding"]).T
    assert np.allclose(got["score"].to_numpy()[::2], scores.max(axis=1), rtol=0, atol=2e-12)


def test_requests_whose_heaps_are_too_many_are_not_held_by_every_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    asked = spark.createDataFrame([(f"r{i:02d}", rng.normal(size=6).tolist()) for i in range(20)], "request_id string, query_vec array<float>")
    stored = spark.createDataFrame([(f"S{i:03d}", rng.normal(size=6).tolist()) for i in range(300)], "nric string, embedding array<float>")

    def found():
        top = retrieval.topk(asked, stored, 3, broadcast_bytes=10_000)
        return "CoGroup" in top._jdf.queryExecution().toString(), {tuple(r) for r in top.select("request_id", "nric").collect()}

    in_place, expect = found()
    monkeypatch.setattr(retrieval, "HEAP_ROWS", 59)
    assert not in_place and found() == (True, expect) and len(expect) == 60


def test_vectors_without_spare_copies_are_held_once():
    """Not once in key order and once more without the copies that none of them has; 26 MB each here."""
    rng = np.random.default_rng(10)
    raw = rng.normal(size=(100_000, 64)).astype(np.float32)
    order = rng.permutation(100_000)
    names = pa.array([f"S{i:06d}" for i in order])
    vectors = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, 64, dtype=np.int32), pa.array(raw.ravel()))
    tracemalloc.start()
    keys, kept = retrieval._sorted_keys(names, vectors, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
    assert keys.equals(pa.array([f"S{i:06d}" for i in range(100_000)])) and (kept.raw == raw[np.argsort(order)]).all()

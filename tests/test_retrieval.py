import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wardline.functions import vectors
from wardline.operators import pivots, retrieval

VEC = "request_id string, query_vec array<float>"
STORED = "nric string, embedding array<float>, label int"


def data(n_req=23, n_vec=157, dims=12, seed=4):
    rng = np.random.default_rng(seed)
    reqs = [(f"r{i:02d}", rng.normal(size=dims).astype("float32").tolist()) for i in range(n_req)]
    stored = [(f"S{i:04d}", rng.normal(size=dims).astype("float32").tolist(), i % 3) for i in range(n_vec)]
    stored[5] = ("S0005", [0.0] * dims, 2)
    stored += [(f"T{i}", stored[7][1], 1) for i in range(4)]  # equal vectors: ties
    reqs[3] = ("r03", [0.0] * dims)
    reqs[4] = ("r04", stored[7][1])
    return reqs, stored


def brute(reqs, stored, k):
    out = {}
    for rid, q in reqs:
        q = np.array(q, dtype=float)
        scored = []
        for key, v, _ in stored:
            v = np.array(v, dtype=float)
            norm = np.linalg.norm(q) * np.linalg.norm(v)
            scored.append((-round(float(q @ v / norm), 12) if norm else 0.0, key))
        out[rid] = [key for _, key in sorted(scored)[:k]]
    return out


def keys(df):
    out = {}
    for r in df.orderBy("request_id", F.desc("score"), "nric").collect():
        out.setdefault(r.request_id, []).append(r.nric)
    return out


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 10_000}, {"broadcast_bytes": 0, "block_bytes": 1500}],
                         ids=["vectors shared", "requests shared", "blocks"])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_every_form_is_exact(spark, sizes, k):
    reqs, stored = data()
    top = retrieval.topk(spark.createDataFrame(reqs, VEC).repartition(3),
                         spark.createDataFrame(stored, STORED).repartition(5), k, **sizes)
    assert keys(top) == brute(reqs, stored, k)


def test_where_filters_before_scoring(spark):
    reqs, stored = data()
    top = retrieval.topk(spark.createDataFrame(reqs, VEC), spark.createDataFrame(stored, STORED), 2, F.col("label") == 1)
    assert keys(top) == brute(reqs, [s for s in stored if s[2] == 1], 2)


def test_missing_vectors_and_empty_store(spark):
    reqs = spark.createDataFrame([("a", None), ("b", [1.0, 0.0])], VEC)
    stored = spark.createDataFrame([("x", [1.0, 1.0], 0), ("y", None, 0)], STORED)
    assert keys(retrieval.topk(reqs, stored)) == {"b": ["x"]}
    assert keys(retrieval.topk(reqs, stored.filter("false"))) == {}
    best = retrieval.top_score(reqs, retrieval.topk(reqs, stored.filter("false")))
    assert {r.request_id: r.top_score for r in best.collect()} == {"a": 0.0, "b": 0.0}


@pytest.mark.parametrize("a,b,expect", [
    ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0], 1.0), ([1.0, 2.0], [-1.0, -2.0], -1.0), ([1.0, 0.0], [0.0, 1.0], 0.0),
    ([0.0, 0.0], [1.0, 2.0], 0.0), ([1.0, 2.0, 3.0, 4.0, 5.0], [5.0, 4.0, 3.0, 2.0, 1.0], 35 / 55)])
def test_cosine(spark, a, b, expect):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    row = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x"), vectors.cosine(F.col("b"), F.col("a")).alias("y")).first()
    assert abs(row.x - expect) < 1e-6 and row.x == pytest.approx(row.y)


def test_cosine_of_long_vectors(spark):
    rng = np.random.default_rng(42)
    a, b = rng.normal(size=3072), rng.normal(size=3072)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).first().x
    assert -1 <= got <= 1 and got == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)


def test_score_rounding_is_scaled_half_even(spark):
    values = [0.12345, 0.12355, -0.12345, 0.00005, 0.3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.x for r in df.select("i", vectors.round_score(F.col("v")).alias("x")).orderBy("i").collect()]
    assert got == [float(np.round(np.float64(v), 4)) for v in values]


@pytest.mark.parametrize("score,warned", [(0.2, True), (0.3, False), (0.4, False), (0.29999, True)])
def test_low_similarity_is_strict_and_unrounded(spark, score, warned):
    text = spark.range(1).select(retrieval.low_similarity_warning(F.lit(score)).alias("w")).first().w
    assert (text is not None) == warned
    if score == 0.2:
        assert text == "Low similarity warning — top score 0.2"


def test_duplicate_key_keeps_lowest_and_unknown_key_vanishes(spark):
    top = spark.createDataFrame([("r", "A", 0.9), ("r", "A", 0.5), ("r", "B", 0.7), ("r", "Z", 0.8)],
                                "request_id string, nric string, score double")
    people = spark.createDataFrame([("A", "ann"), ("B", "bob")], "nric string, name string")
    ranked = retrieval.rank_records(retrieval.retrieve(top, people)).orderBy("record_no").collect()
    assert [(r.nric, r["_similarity_score"], r.record_no) for r in ranked] == [("B", 0.7, 1), ("A", 0.5, 2)]


def test_profile_counts_every_pair(spark):
    reqs, stored = data()
    rows = retrieval.score_profile(spark.createDataFrame(reqs, VEC), spark.createDataFrame(stored, STORED)).collect()
    assert {r.n_scored for r in rows} == {len(stored)} and len(rows) == len(reqs)
    zero = next(r for r in rows if r.request_id == "r03")
    assert (zero.n_low, zero.top_score, zero.bottom_score) == (len(stored), 0.0, 0.0)


def test_plans(spark, small):
    from wardline.sources import mapping
    reqs, stored = mapping.requests(spark, small), mapping.embeddings(spark, small)
    assert "WindowGroupLimit" not in plan_of(retrieval.topk(reqs, stored))
    merged = plan_of(retrieval.topk(reqs, stored, broadcast_bytes=0, block_bytes=10_000))
    assert "WindowGroupLimit" in merged and "Cartesian" not in merged and "NestedLoop" not in merged


def test_vectors_of_unequal_length_or_with_gaps_are_refused():
    for bad in ([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]], [[1.0, None]], [None, [1.0]]):
        with pytest.raises(ValueError):
            retrieval._matrix(pa.array(bad, pa.list_(pa.float32())))


@pytest.mark.parametrize("n_pivots", [1, 6, 500])
@pytest.mark.parametrize("k", [1, 5])
def test_pivot_search_is_exact(spark, n_pivots, k):
    reqs, stored = data()
    index = pivots.build(spark.createDataFrame(stored, STORED).repartition(3), n_pivots)
    asked = spark.createDataFrame([*reqs, ("none", None)], VEC)
    for where, kept in ((None, stored), (F.col("label") == 1, [s for s in stored if s[2] == 1]), (F.col("label") == 9, [])):
        top, report = pivots.search(asked, index, k, where)
        expect = brute(reqs, kept, k)
        assert keys(top) == {r: e for r, e in expect.items() if e}
        assert {r.request_id for r in report.collect()} == ({r for r, _ in reqs} if kept else set())


def test_pivot_search_skips_far_blocks(spark):
    """Clustered vectors: a request reads the blocks around it and no others, and gets the same answer."""
    rng = np.random.default_rng(2)
    centres = np.eye(16)
    stored = [(f"S{i:04d}", (centres[i % 16] + rng.normal(0, 0.02, 16)).tolist(), i % 3) for i in range(640)]
    reqs = [(f"r{i}", (centres[i] + rng.normal(0, 0.02, 16)).tolist()) for i in range(16)]
    index = pivots.build(spark.createDataFrame(stored, STORED), 64)
    top, report = pivots.search(spark.createDataFrame(reqs, VEC), index, 5)
    # single precision is what a table holds
    as_stored = [(n, np.float32(v).tolist(), x) for n, v, x in stored]
    assert keys(top) == brute([(r, np.float32(q).tolist()) for r, q in reqs], as_stored, 5)
    read = report.collect()
    assert all(r.n_read <= r.n_blocks / 4 for r in read) and read[0].n_blocks > 16
    assert pivots.search(spark.createDataFrame(reqs, VEC), pivots.build(spark.createDataFrame([], STORED)), 5)[0].collect() == []


def test_heaps_merge_in_levels(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FAN_IN", 2)
    monkeypatch.setattr(retrieval, "_slots", lambda df: 9)
    reqs, stored = data()
    asked, kept = spark.createDataFrame(reqs, VEC), spark.createDataFrame(stored, STORED).repartition(40)
    top = retrieval.topk(asked, kept, 3, broadcast_bytes=10_000)
    assert keys(top) == brute(reqs, stored, 3)
    heaps = retrieval._score_against_requests(asked, kept.select("nric", "embedding"), 3)
    assert heaps.count() <= 3 * len(reqs) * 9  # not times the splits


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_bytes": 1500}], ids=["in place", "blocks"])
def test_score_profile_forms_agree(spark, sizes):
    reqs, stored = data()
    got = retrieval.score_profile(spark.createDataFrame([*reqs, ("none", None)], VEC).repartition(3),
                                  spark.createDataFrame(stored, STORED).repartition(5), **sizes)
    unit = [np.array(v, float) / (np.linalg.norm(v) or 1) for _, v, _ in stored]
    expect = {}
    for r, q in reqs:
        s = np.rint(np.stack(unit) @ (np.array(q, float) / (np.linalg.norm(q) or 1)) * 1e4) / 1e4
        expect[r] = (len(s), int((s < 0.3).sum()), s.max(), s.min())
    assert {r.request_id: tuple(r)[1:] for r in got.collect()} == expect


def test_threshold_is_compared_with_the_unrounded_score(spark):
    """A score a hair under the threshold is low even where twelve decimals show the threshold itself."""
    top = spark.createDataFrame([("a", "x", 0.3, 0.3 - 2e-14), ("b", "x", 0.3, 0.3)], "request_id string, nric string, score double, raw double")
    best = retrieval.top_score(spark.createDataFrame([("a",), ("b",), ("c",)], "request_id string"), top)
    warned = {r.request_id: r.w for r in best.select("request_id", retrieval.low_similarity_warning(F.col("top_score")).alias("w")).collect()}
    assert warned["a"] and warned["b"] is None and warned["c"]


def test_ragged_vectors_fail_before_they_are_sent(spark):
    stored = spark.createDataFrame([("x", [1.0, 0.0], 0), ("y", [1.0] * 5, 0)], STORED)
    assert retrieval._bytes(stored, "embedding") == 7 * 8 + 2 * 64
    with pytest.raises(Exception, match="one length"):
        retrieval.topk(spark.createDataFrame([("a", [1.0, 0.0])], VEC), stored).collect()

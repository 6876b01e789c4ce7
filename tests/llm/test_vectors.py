import math

import duckdb
import numpy as np
import pytest

from wardline.llm import blocks, hardneg, vafile
from wardline.llm.queries import SQL

ROWS = ("vec_id long, embedding array<float>, label int, class long, row long, pair int, is_row boolean, v string, "
        "asked string, ids string, score string, found string, cells string")


def table(spark, given):
    return spark.createDataFrame([(*r, 1, 2, 3, True, "v", "a", "i", "s", "f", "c") for r in given], ROWS)


@pytest.fixture(scope="module")
def given():
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(0, 0.2, 12).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(420)]
    same = rows[40][1]
    rows += [(i, same, i % 3) for i in range(420, 620)]  # a third of the rows are one vector
    rows += [(100, same, 1), (200, rows[7][1], 2), (200, rows[7][1], 2), (None, rows[9][1], 1), (None, None, 1), (700, same, None),
             (800, None, 2), (900, [0.1, None] * 6, 1), (1000, [0.1, math.nan] * 6, 1), (1100, [math.inf] * 12, 1),
             (1200, [], 1), (1300, rows[3][1][:5], 0), (1400, rows[3][1] + [0.5], 2), (1500, [0.0] * 12, 3),
             (-100, rows[5][1], 3), (1600, [1e30] + [0.0] * 11, 0), (1700, [-1e30] + [0.0] * 11, 1)]
    return rows


def whole(given, scale):
    def part(x):
        return math.floor(max(-2.0**31, min(2.0**31, float(x) * scale)))

    out = []
    for vec_id, v, label in given:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        out.append((vec_id, [part(np.float32(x)) for x in v], label))
    return out


def dot(a, b):
    return max(-2**63 + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=False))))


def order(found):
    return sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def nearest(given, k):
    rows = whole(given, vafile.SCALE)
    out = []
    for i, (q, v, _) in enumerate(rows):
        if q is not None and q % vafile.EVERY == 0:
            found = order([(dot(v, w), c) for j, (c, w, _) in enumerate(rows) if j != i])
            out += [(q, n + 1, c, s) for n, (s, c) in enumerate(found[:k])]
    return sorted(out, key=str)


def mined(given):
    rows = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in whole(given, hardneg.SCALE) if label is not None]
    out = []
    for i, (a, v, label) in enumerate(rows):
        if a is None or a % hardneg.EVERY:
            continue
        found = order([(dot(v, w), c, other == label) for j, (c, w, other) in enumerate(rows) if j != i])
        for p, pos, _ in [f for f in found if f[2]][:5]:
            window = [f for f in found if not f[2] and 80 * p <= 100 * f[0] <= 100 * p][:5]
            out += [(a, pos, n + 1, neg, p, s) for n, (s, neg, _) in enumerate(window)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_asked", [8, blocks.BLOCK_ASKED])
def test_search_equals_brute_force(spark, given, block_asked):
    df = table(spark, given)
    assert rows_of(vafile.search(df, df.vec_id % vafile.EVERY == 0, block_asked=block_asked)) == nearest(given, 20)


@pytest.mark.parametrize("bits,k", [(1, 3), (3, 20), (9, 700)])
def test_any_cells_give_the_same_answer(spark, given, bits, k):
    some = [r for r in given if not r[1] or max(abs(x) for x in r[1] if x is not None) < 1e6]
    df = table(spark, some)
    assert rows_of(vafile.search(df, df.vec_id % vafile.EVERY == 0, k=k, bits=bits)) == nearest(some, k)


def test_cells_bound_products_and_prune(spark, given):
    """Every product lies in its bounds, and far vectors are not read."""
    df = table(spark, [r for r in given if r[1] and len(r[1]) == 12 and r[0] is not None and r[0] < 420])
    rows = df.select("vec_id", blocks.integer_vector(df.embedding, 64).alias("v"), (df.vec_id % 20 == 0).alias("asked")).filter("v IS NOT NULL")
    classes = vafile.classes_of(rows, 5)
    lo, width = vafile.grid_of(classes, 5)
    cells = vafile.approximate(classes, lo, width, 5)
    found = vafile.bounds(classes, cells, lo, width, 5, 5).collect()
    v = {r["class"]: r["v"] for r in classes.collect()}
    assert all(r["low2"] <= 2 * dot(v[r["asker"]], v[r["class"]]) <= r["high2"] for r in found)
    askers = classes.filter("asked").count()
    assert len(found) < 0.5 * askers * len(v)


def test_scan_hands_on_what_it_cannot_hold(monkeypatch):
    monkeypatch.setattr(vafile, "HELD", 50)
    import pyarrow as pa

    rng = np.random.default_rng(3)
    asked, rows = rng.integers(-20, 20, (4, 6)), rng.integers(-20, 20, (300, 6))
    scan = vafile._Scan(3, np.full(6, 4))
    scan.ask(pa.record_batch({"class": pa.array(range(4), pa.int64()), "v": pa.array(asked.tolist())}))
    got = []
    for at in range(0, 300, 25):
        got += list(scan.see(pa.array(range(at, at + 25), pa.int64()), 2 * rows[at:at + 25]))
    got += list(scan.left())
    pairs = {(a, c) for b in got for a, c in zip(b["asker"].to_pylist(), b["class"].to_pylist(), strict=True)}
    best = np.argsort(-(asked @ rows.T), axis=1)[:, :3]
    assert len(got) > 1 and all((i, int(c)) in pairs for i in range(4) for c in best[i])


@pytest.mark.parametrize("block_asked", [2, blocks.BLOCK_ASKED])
def test_hard_negatives_equal_brute_force(spark, given, block_asked):
    assert rows_of(hardneg.mine(table(spark, given), block_asked)) == mined(given)


def test_windows_include_their_bounds(spark):
    """Scores of exactly 80 and 100 percent are in; one below and one above are not."""
    unit = [1.0, 0.0]
    given = [(100, unit, 1), (1, [100 / 256, 0.0], 1), *((10 + i, [s / 256, 0.0], 2) for i, s in enumerate((101, 100, 100, 80, 79)))]
    got = rows_of(hardneg.mine(table(spark, given)))
    assert [(r[1], r[3], r[5]) for r in sorted(got, key=lambda r: r[2])] == [(1, 11, 25600), (1, 12, 25600), (1, 13, 20480)]
    assert got == mined(given)


def test_negative_scores_open_no_window(spark):
    given = [(100, [1.0], 1), (1, [-0.5], 1), (2, [-0.5], 2), (3, [-0.45], 2), (200, [0.0], 5), (4, [0.0], 5)]
    assert rows_of(hardneg.mine(table(spark, given))) == mined(given)


def test_empty_tables(spark):
    none = table(spark, [])
    assert vafile.production(none).collect() == [] and hardneg.mine(none).collect() == []
    one = table(spark, [(100, [0.5], 1)])
    assert vafile.production(one).collect() == [] and hardneg.mine(one).collect() == []


@pytest.mark.parametrize("name,made", [("op11_topk_search", vafile.production), ("op13_hard_negatives", hardneg.mine)])
def test_sql_agrees(spark, small, given, name, made):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert sorted(con.execute(SQL[name]).fetchall(), key=str) == rows_of(made(spark.read.parquet(f"{small}/embeddings.parquet")))


def test_best_keeps_the_first_over_any_slices():
    rng = np.random.default_rng(8)
    scores, open_ = rng.integers(-5, 5, (6, 400)), rng.random((6, 400)) < 0.7
    ids, missing, row = rng.integers(0, 50, 400), rng.random(400) < 0.1, np.arange(400)
    for step in (7, 64, 400):
        best = blocks.Best(6, 4)
        for at in range(0, 400, step):
            s = slice(at, at + step)
            best.add(scores[:, s], open_[:, s], missing[s], ids[s], row[s])
        got = [[int(r) for o, r in zip(best.rows[0], best.rows[4], strict=True) if o == i] for i in range(6)]
        expect = [sorted(np.flatnonzero(open_[i]), key=lambda j: (-scores[i, j], missing[j], ids[j], j))[:4] for i in range(6)]
        assert got == [[int(x) for x in e] for e in expect]

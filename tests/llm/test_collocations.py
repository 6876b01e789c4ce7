import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from wardline.llm import collocations as c
from wardline.llm.queries import SQL

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
        yield re.findall(r"[^\x20\x09]+", piece)


def counted(given):
    f, n = {}, Counter()
    for lang, text in given:
        lang = "und" if lang is None else lang
        for words in split(text):
            n[lang] += len(words)
            bag = f.setdefault(lang, Counter())
            for size in range(1, 5):
                bag.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return f, n


def ranked(f, n, least=30, top=2000):
    out = []
    for lang, bag in f.items():
        ok = {p: a for p, a in bag.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in ok.items():
            score, k = min((2_000_000 * a // (bag[p[:k]] + bag[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in ok.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), bag[p[:k]], bag[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score)
                for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def given():
    rows = [("en", "New York City is big. New York City, I say; San Francisco Bay"), ("en", "the the the the the the"),
            (None, "no language here at all\tthere"), ("und", "no language here at all  there"), ("", "empty lang of course"),
            ("fr", "ÉTÉ à Paris\x0bété À paris\x0cfin de  semaine\r\nfin de semaine"), ("fr", "a b\x1cc d\x85e   f g"),
            ("en", None), ("en", ""), ("en", " \t\n.,;"), ("de", "ä" * 500 + " x y"), ("en", "b a. a b. b a. a b"), ("zz", "one two"),
            ("two words\nand lines", "a b c d e a b c d e")]
    return [r for i, r in enumerate(rows) for _ in range(12 + 5 * (i % 4))] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, 3, 4, 5, "p", "w", 6) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, n long, w1 string, f long, a long, l long, r long, "
                                 "phrase string, words string, level long")


def test_equals_brute_force(spark, given):
    assert got(c.collocations(frame(spark, given))) == ranked(*counted(given))


def test_documents_and_odd_rows(docs, odd):
    for df in (docs, odd):
        rows = [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]
        assert got(c.collocations(df)) == ranked(*counted(rows))


def test_every_frequency(spark, given):
    f, n = counted(given)
    found, totals = c.phrase_counts(frame(spark, given), 5)
    assert {(r["lang"], tuple(r["words"])): r["f"] for r in found.collect()} == {
        (lang, p): a for lang, bag in f.items() for p, a in bag.items() if a >= 5}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_top_and_threshold(spark, given):
    f, n = counted(given)
    assert got(c.collocations(frame(spark, given), min_count=3, top=2)) == ranked(f, n, 3, 2)


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    f = {"en": Counter({("a",): big, ("b",): big + 7, ("c",): big - 1, ("a", "b"): big - 3, ("b", "c"): big // 2, ("a", "b", "c"): big // 2 - 5})}
    found = spark.createDataFrame([("en", list(p), " ".join(p), a) for p, a in f["en"].items()],
                                  "lang string, words array<string>, phrase string, f long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    assert got(c.best_phrases(found, totals)) == ranked(f, Counter({"en": 3 * big}))


@pytest.mark.parametrize("held_bytes,held_rows", [(1 << 20, 10**6), (300, 10**6), (300, 5)])
def test_prefix_sums_survive_any_bounds(given, monkeypatch, held_bytes, held_rows):
    """Cut or handed on as they are, the windows of a bucket give every frequent prefix its sum, and cut windows are few."""
    monkeypatch.setattr(c, "HELD_BYTES", held_bytes)
    monkeypatch.setattr(c, "HELD_ROWS", held_rows)
    texts, langs = pa.array([t or "" for _, t in given]), pa.array(["und" if lang is None else lang for lang, _ in given])
    folded = pa.concat_tables([c.count_windows(texts[at:at + 97], langs[at:at + 97], 5) for at in range(0, len(given), 97)])
    dealt = folded.sort_by([("bucket", "ascending"), ("lang", "ascending")]).combine_chunks().to_batches(max_chunksize=3)
    prefixes, rows = Counter(), 0
    for batch in c._met(iter(dealt), 30):
        for r in batch.to_pylist():
            words = [r[w] for w in ("w1", "w2", "w3", "w4") if r[w] is not None]
            assert words == [r[w] for w in ("w1", "w2", "w3", "w4")][:len(words)]
            prefixes.update({(r["lang"], *words[:i]): r["n"] for i in range(1, len(words) + 1)})
            rows += 1
    f, _ = counted(given)
    assert {k: v for k, v in prefixes.items() if v >= 30 or len(k) == 2} == {
        (lang, *p): a for lang, bag in f.items() for p, a in bag.items() if a >= 30 or len(p) == 1}


@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_windows_are_padded_and_whole(given, buckets):
    """Each position gives one window, whatever the stretches are cut into, and a pair lies in one bucket."""
    texts, langs = pa.array([t or "" for _, t in given]), pa.array(["und" if lang is None else lang for lang, _ in given])
    folded = pa.concat_tables([c.count_windows(texts[at:at + 97], langs[at:at + 97], buckets) for at in range(0, len(given), 97)])
    total, bucket = Counter(), {}
    for r in folded.to_pylist():
        for w in c.unfold(pa.array([r["windows"]])).to_pylist():
            assert bucket.setdefault((r["lang"], w["w1"], w["w2"]), r["bucket"]) == r["bucket"]
            words = [x for x in (w["w1"], w["w2"], *w["tail"].split(" ")) if x]
            total[r["lang"], *(words + [None] * 4)[:4]] += w["n"]
    expect = Counter()
    for lang, text in given:
        for words in split(text):
            expect.update(("und" if lang is None else lang, *(words[i:i + 4] + [None] * 4)[:4]) for i in range(len(words)))
    assert total == expect


def test_empty(spark, none):
    assert c.collocations(none).collect() == []


def test_sql_agrees(docs, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    rows = con.execute(SQL["op12_collocations"]).fetchall()
    assert rows and sorted(rows) == got(c.collocations(docs))

import hashlib
from collections import Counter

import numpy as np
import pytest

from wardline.llm import bagminhash, fingerprints
from wardline.llm.common import shingle_counts


def bag(text):
    w = text.split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def likeness(a, b):
    both, all_ = sum((a & b).values()), sum((a | b).values())
    return both / all_ if all_ else 0.0


def classes(given):
    bags, parent = [bag(t) for _, t in given], list(range(len(given)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(given)):
        for j in range(i):
            if given[i][1] == given[j][1] or likeness(bags[i], bags[j]) >= 0.8:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(given)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [given[i][0] for i in members if given[i][0] is not None]
        out += [(given[i][0], min(ids) if ids else None, len(members)) for i in members]
    return sorted(out, key=str)


def near(df):
    return sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in bagminhash.near_duplicates(df).collect()), key=str)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_near_duplicates_equal_brute_force(which, request):
    df = request.getfixturevalue(which)
    assert near(df) == classes([(r["doc_id"], r["text"] or "") for r in df.collect()])


def test_a_chain_and_a_large_group_keep_all_links(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 7)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    given = []
    for i in range(60):  # copies of one text, some too far from it but near each other
        w = list(words)
        for at in rng.choice(200, rng.integers(0, 9), replace=False):
            w[at] = f"x{i}{at}"
        given.append((i, " ".join(w)))
    for i in range(12):  # each near its neighbours only
        given.append((100 + i, " ".join(f"c{j}" for j in range(i * 12, i * 12 + 150))))
    df = spark.createDataFrame(given, "doc_id long, text string")
    assert near(df) == classes(given)


def test_signatures_are_unbiased():
    a, b = "a b c d e " * 9 + " ".join(f"w{i}" for i in range(40)), "a b c d e " * 5 + " ".join(f"w{i}" for i in range(10, 60))
    m = 20_000
    values = bagminhash.signatures([a, b, ""], m)
    true = likeness(bag(a), bag(b))
    assert abs((values[0] == values[1]).mean() - true) < 5 * (true * (1 - true) / m) ** 0.5
    assert np.isinf(values[2]).all()


def test_shingle_counts_match_counters():
    texts = ["a b c d e a b c d e a b c d e", "x y", "", "q " * 30]
    doc, _, n = shingle_counts(texts)
    for i, t in enumerate(texts):
        assert sorted(n[doc == i]) == sorted(bag(t).values())


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_fingerprints_of_edits(which, request, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 40_000)
    df = request.getfixturevalue(which)
    order = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = fingerprints.fingerprint_edits(df).collect()
    made = {}
    for r in got:
        made.setdefault((r["doc_id"], r["edited_sha256"]), []).append(r)
    assert len(got) == len(order)
    for i, (doc_id, text) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = made[doc_id, hashlib.sha256(edited.encode()).hexdigest()].pop()
        assert r["n_chars"] == len(text)
        sets = [set(bag(t)) for t in (text, edited, after)]
        for got_, other in ((r["near_edited"], sets[1]), (r["near_next"], sets[2])):
            true = len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0
            assert abs(got_ - true) < 0.15
    same = {}
    for r in fingerprints.fingerprint_documents(df).collect():
        text = next(t for d, t in order if d == r["doc_id"])
        assert same.setdefault(text, r["fingerprint"]) == r["fingerprint"]

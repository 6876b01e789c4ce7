import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from wardline.llm import bagminhash, queries, quality, secrets, toxicity
from wardline.session import materialise


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.REGISTRY) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "secret scans", "packing"]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_stages_keep_the_columns_and_decide(spark, small, which, request):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, small), "stage")
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == docs.columns
        before, after = docs.count(), out.count()
        if name == "quality rules":
            assert after == quality.judge(docs).filter("kept").count() or which == "odd"
        if name == "toxicity":
            assert after == toxicity.score_documents(docs, toxicity.train_on(docs, spark.read.parquet(f"{small}/labels.parquet"))).filter("score < 0.5").count()
        if name == "near-duplicates":
            assert out.dropDuplicates(["doc_id"]).count() == after <= before
        if name == "secret scans":
            assert after == before and all(not r["s"] for r in out.select(secrets.base_spans(out["text"]).alias("s")).collect())
        docs = out


def test_rows_without_or_with_repeated_ids_are_decided_one_by_one(spark, docs, small, tmp_path):
    known = [r.asDict() for r in docs.orderBy("doc_id").limit(120).collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{small}/labels.parquet").filter("toxic = 1").collect()}
    rows = [dict(r) for r in known]
    # Clean, junk and toxic rows without an id, and one id for many texts.
    rows += [dict(r, doc_id=None) for r in known[:60]] + [dict(r, doc_id=-7) for r in known[30:90]]
    rows += [dict(known[0], doc_id=i, text="too short") for i in (None, -7)]
    rows += [dict(r.asDict(), doc_id=None) for r in docs.filter(docs["doc_id"].isin(sorted(toxic)[:5])).collect()]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    clean = max((r.asDict() for r in docs.collect() if r["doc_id"] in labels), key=lambda r: len(r["text"]))
    rows = [r for r in rows if r["text"] != clean["text"]]
    rows += [dict(clean, doc_id=None, text=clean["text"] + end) for end in (" one", " two", " two", " three")]  # near copies
    schema = docs.schema
    spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    current = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def counted(df):
        return Counter((r["doc_id"], r["lang"], r["text"]) for r in df.collect())

    def single(df):
        """The rows, and the same under ids of their own."""
        held = df.collect()
        return held, spark.createDataFrame([(i, *tuple(r)[1:]) for i, r in enumerate(held)], schema)

    for name, stage in corpus_pipeline.STAGES[:3]:
        held, own = single(current)
        if name == "quality rules":
            kept = [held[r["doc_id"]] for r in quality.judge(own).filter("kept").collect()]
            assert {None, -7} <= {r["doc_id"] for r in kept}
        elif name == "toxicity":
            model = toxicity.train_on(current, spark.read.parquet(f"{small}/labels.parquet"))
            kept = [held[r["doc_id"]] for r in toxicity.score_documents(own, model).filter("score < 0.5").collect()]
        else:
            classes = {}
            for r in bagminhash.near_duplicates(own).collect():
                classes.setdefault(r["class_id"], []).append(held[r["doc_id"]])
            kept = [min(c, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5(r["text"].encode()).digest()))
                    for c in classes.values()]
            assert sum(r["text"].startswith(clean["text"]) for r in kept) == 1
        current = materialise(stage(spark, current, str(tmp_path)), "stage")
        assert counted(current) == Counter((r["doc_id"], r["lang"], r["text"]) for r in kept)
    packed = corpus_pipeline.run(spark, str(tmp_path)).filter("piece = 0")
    assert Counter(r["doc_id"] for r in packed.collect()) == Counter(r["doc_id"] for r in current.collect())

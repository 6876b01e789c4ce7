"""Documents to packed training sequences: quality, toxicity, near-duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
documents. A stage decides on the rows it gets, on each by itself: rows that share a doc_id, or have none, share
a decision only if all that the decision depends on is equal too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bagminhash, packing, quality, secrets, toxicity
from wardline.llm.common import table
from wardline.llm.queries import tokenizer_path
from wardline.session import materialise


def _digest() -> Column:
    """Of the text; null reads as empty, as in the operators."""
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go. The rules know language and text; the id keeps copies apart in the join."""
    judged = quality.judge(docs.select("doc_id", "lang", "text", _digest().alias("text_digest")), ["lang", "text_digest"])
    gone = materialise(judged.filter(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id"), F.col("lang").alias("gone_lang"), F.col("text_digest").alias("gone_text")).distinct(),
        "rejected")
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & docs["lang"].eqNullSafe(F.col("gone_lang"))
                     & (_digest() == F.col("gone_text")), "left_anti")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.5 or more go. The model learns from the labelled training rows among docs."""
    return toxicity.without_toxic(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates stays: the one with the least doc_id (a row without one only
    where its whole class has none), of several with that id the least text digest, of repeated rows any."""
    rows = materialise(bagminhash.classify(docs).select("doc_id", "digest", "comp"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n"))
    kept = materialise(rows.groupBy("comp", "doc_id", "digest").agg(F.count("*").alias("n"))
                       .groupBy("comp").agg(first.alias("first"))
                       .select(F.col("first.doc_id").alias("kept_id"), F.col("first.digest").alias("kept_text"), "first.n"),
                       "representatives")
    # A text lies in one class, so its digest names the representative.
    found = docs.select(F.struct("*").alias("row"), "doc_id", bagminhash.digest_of(F.col("text")).alias("digest"))
    same = found["doc_id"].eqNullSafe(F.col("kept_id")) & (found["digest"] == F.col("kept_text"))
    single = found.join(kept.filter("n = 1"), same, "left_semi").select("row.*")
    repeated = kept.filter("n > 1")
    if repeated.isEmpty():
        return single
    again = found.join(repeated, same, "left_semi").dropDuplicates(["digest"])
    return single.unionByName(again.select("row.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows."""
    clean = secrets.redact(secrets.scan(docs, secrets.train(secrets.labelled_samples(docs)), name="_spans"), name="_spans")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_dedup),
    ("secret scans", secret_scan),
    ("packing", best_fit_packing),
]
ORACLE_SQL = None  # the models and the packing are not SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs

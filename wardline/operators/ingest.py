"""Ingestion: normalise the personnel sheet, quarantine keyless rows, build and embed content."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from wardline import schemas
from wardline.functions.text import strip
from wardline.session import materialise
from wardline.sources.tables import full_refresh

# sheet header -> stored column, in the declared order
HEADERS = dict(zip(schemas.PERSONNEL_SOURCE.names, schemas.EMPLOYEE_DATA.names, strict=True))
MISSING_COLUMN = "N/A"


def normalise(raw: DataFrame, null_text: str | None = None) -> DataFrame:
    """Stripped text columns under their stored names; an absent column reads 'N/A'.

    An empty cell stays NULL, or becomes null_text where the text form of a missing cell matters.
    A sheet without the key column has no usable row.
    """
    def field(header: str, name: str) -> Column:
        if header not in raw.columns:
            return F.lit("" if name == "nric" else MISSING_COLUMN).alias(name)
        value = strip(F.col(header).cast("string"))
        return (F.coalesce(value, F.lit(null_text)) if null_text is not None else value).alias(name)

    return raw.select(*[field(h, n) for h, n in HEADERS.items()])


def has_key(nric: Column) -> Column:
    """False for an empty key and for the text a missing cell turns into."""
    return F.coalesce((nric != "") & (F.lower(nric) != "nan"), F.lit(False))


def split_by_key(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows skipped for want of a key)."""
    return normalised.filter(has_key(F.col("nric"))), normalised.filter(~has_key(F.col("nric")))


def embed_content(employees: DataFrame) -> DataFrame:
    """nric and the text to embed. Only the two open fields: a sensitive value must not leak
    through similarity search."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("nan"))

    return employees.select("nric", F.concat(
        F.lit("Name: "), shown("name"), F.lit(", Employment: "), shown("employment")).alias("content"))


def ingest(raw: DataFrame, null_text: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(employees, quarantine, contents)."""
    employees, quarantine = split_by_key(normalise(raw, null_text))
    return employees, quarantine, embed_content(employees)


def _ask(model: Callable[[Sequence[str]], Sequence[Sequence[float]]], texts: list[str]) -> list[list[float] | None]:
    """The model's vectors. A refused list is halved until the texts that cause it stand alone: they get None, the
    others are asked again in as few calls as that takes."""
    try:
        return [list(v) for v in model(texts)]
    except Exception:
        if len(texts) <= 1:
            return [None] * len(texts)
        half = len(texts) // 2
        return _ask(model, texts[:half]) + _ask(model, texts[half:])


def embed_with(df: DataFrame, text_col: str, model: Callable[[Sequence[str]], Sequence[Sequence[float]]],
               out_col: str = "embedding") -> DataFrame:
    """Run a caller's model over a text column, one call per Arrow batch of different texts.

    Equal texts are asked once: the model runs over the distinct ones, keyed by digest, and its written results are joined
    back. A batch the model refuses is halved, so that one bad text costs only its own vector and a few calls: it comes
    back NULL and ingest_counts reports it. A missing text has no vector and is not asked.
    """
    asked_type = StructType([StructField("_digest", StringType()), StructField(out_col, ArrayType(FloatType()))])
    digest = F.sha2(F.col(text_col).cast("binary"), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _ask(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["_digest", out_col])

    different = df.filter(F.col(text_col).isNotNull()).select(digest.alias("_digest"), F.col(text_col)).dropDuplicates(["_digest"])
    answers = materialise(different.mapInArrow(run, asked_type), "vectors")
    return (df.withColumn("_digest", digest).join(answers, "_digest", "left").select(*df.columns, out_col))


def ingest_counts(normalised: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row, from tables that are written already: stored, embedded, skipped, embed_errors."""
    stored = normalised.agg(
        F.count_if(has_key(F.col("nric"))).alias("stored"),
        F.count_if(~has_key(F.col("nric"))).alias("skipped"))
    vectors = embedded.agg(
        F.count("embedding").alias("embedded"),
        F.count_if(F.col("embedding").isNull()).alias("embed_errors"))
    return stored.unionByName(vectors, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("stored", "embedded", "skipped", "embed_errors")])


def ingest_job(raw: DataFrame, model: Callable[[Sequence[str]], Sequence[Sequence[float]]], database: str, root: str,
               null_text: str | None = None) -> DataFrame:
    """Replace employee_data and employee_embeddings of a database by a sheet's rows; returns one row of counts: stored,
    embedded, skipped, embed_errors.

    The model is asked once per text: its vectors are written before they are stored. The counts are observed while the
    two tables are written, so neither is read again for them. Both tables change only after both are written.
    """
    rows, vectors = Observation(), Observation()
    kept = has_key(F.col("nric"))
    normalised = materialise(normalise(raw, null_text).observe(
        rows, F.count_if(kept).alias("stored"), F.count_if(~kept).alias("skipped")), "normalised")
    employees = split_by_key(normalised)[0]
    embedded = materialise(embed_with(embed_content(employees), "content", model).observe(
        vectors, F.count("embedding").alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("embed_errors")), "embedded")
    full_refresh({f"{database}.employee_data": employees,
                  f"{database}.employee_embeddings": embedded.filter("embedding IS NOT NULL")}, root)
    counts = rows.get | vectors.get
    names = ("stored", "embedded", "skipped", "embed_errors")
    return raw.sparkSession.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))

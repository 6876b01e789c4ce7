"""Sources, sinks and table maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from wardline import schemas
from wardline.functions import text
from wardline.session import materialise

BATCH, BUCKET = "append_batch", "key_bucket"  # folder names


def read_personnel(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The personnel sheet, all cells as text. A missing file fails the read.

    CSV goes by header name, so absent columns stay absent and are reported as such downstream;
    a quoted cell may hold commas, line breaks and doubled quotes, and a row with another number of
    cells fails the read instead of shifting values into other columns. Columnar formats keep
    their own columns, cast to text.
    """
    if fmt == "csv":
        df = (spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True)
              .option("escape", '"').option("mode", "FAILFAST").csv(path))
    else:
        df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(c).cast("string") for c in df.columns])


def balanced(df: DataFrame) -> DataFrame:
    """Rows of a few files, spread over the cores before row-by-row text work.

    A table of at least a file per core is left as it is, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # inputs are known without planning or running anything; a table that is not read from files counts as split
    n_files = len(df.inputFiles())
    return df.repartition(cores) if 0 < n_files < cores else df


def scan_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMPLOYEE_EMBEDDINGS).parquet(path)


def decode_embeddings(df: DataFrame) -> DataFrame:
    """Vectors exported as JSON text, decoded once at the boundary."""
    return df.withColumn("embedding", F.from_json("embedding", ArrayType(schemas.FloatType())))


def encode_embeddings(df: DataFrame) -> DataFrame:
    """Vectors as JSON text for a consumer of the old layout."""
    return df.withColumn("embedding", F.to_json("embedding"))


def fetch_by_keys(records: DataFrame, keys: DataFrame, key: str = "nric") -> DataFrame:
    """Records whose key is listed. The key list shuffles or broadcasts as its size allows."""
    return records.join(keys.select(key), key, "left_semi")


def collection_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_documents"))


def collection_peek(df: DataFrame, key: str) -> DataFrame:
    """One sample document with its metadata, the first by key."""
    return df.orderBy(key).limit(1)


def lookup_supervisor(requests: DataFrame, supervisors: DataFrame) -> DataFrame:
    """Each request beside its supervisor's row; NULLs when the id is blank or unknown."""
    dim = supervisors.select(*[
        F.col(c).alias("supervisor_id" if c == "supervisor_id" else f"supervisor_{c}")
        for c in supervisors.columns])
    return (requests.withColumn("supervisor_id", text.supervisor_id(F.col("supervisor_id")))
            .join(dim, "supervisor_id", "left"))


def manager_contact(managers: DataFrame, fallback: str = "") -> DataFrame:
    """One row: e-mail of the first manager who may unlock supervisors, else the fallback."""
    return managers.filter("can_unlock_supervisors").agg(
        F.coalesce(F.min_by("email", "manager_id"), F.lit(fallback)).alias("email"))


def lookup_audit_entry(audit: DataFrame, request_id: str) -> DataFrame:
    """The audit row of one request; the key predicate reaches the Parquet scan."""
    return audit.filter(F.col("request_id") == request_id).limit(1)


def find_audit_entry(spark: SparkSession, path: str, request_id: str) -> DataFrame:
    """The same from a log stored with write_clustered: one bucket is opened."""
    return read_clustered(spark, path, schemas.AUDIT_LOG, "request_id", request_id).limit(1)


def conform(df: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows fitting the declared schema, rows whose required key is missing).

    Parquet does not enforce NOT NULL on read, so required columns are checked here.
    """
    required = [f.name for f in schema.fields if not f.nullable]
    present: Column = F.lit(True)
    for name in required:
        present = present & F.col(name).isNotNull()
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return typed.filter(present), typed.filter(~present)


def ensure_tables(spark: SparkSession, root: str, database: str = "default") -> list[str]:
    """Create the six tables under root when absent; calling it again changes nothing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for name, schema in schemas.TABLES.items():
        columns = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
            for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) "
                  f"USING parquet LOCATION '{root}/{name}'")
        names.append(f"{database}.{name}")
    return names


def full_refresh(frames: dict[str, DataFrame], root: str) -> None:
    """Replace the rows of catalog tables (database.table -> rows with at least its columns).

    All rows are written to fresh folders under root before any table points to its new one, so a
    failed write leaves every table with its old rows, and a reader that has begun keeps its files. Old
    folders are left to the storage's expiry rule.
    """
    moves = {}
    for name, df in frames.items():
        schema = df.sparkSession.table(name).schema
        moves[name] = f"{root}/{name.rpartition('.')[2]}-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.parquet(moves[name])
    for name, path in moves.items():
        spark = frames[name].sparkSession
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)


def with_request_ids(requests: DataFrame) -> DataFrame:
    """Requests without an id get one, once: random ids must not change when a task runs again, so
    the result is written before anyone reads it."""
    named = requests if "request_id" in requests.columns else requests.withColumn(
        "request_id", F.lit(None).cast("string"))
    return materialise(named.withColumn("request_id", F.coalesce("request_id", F.uuid())), "requests")


def append(df: DataFrame, path: str, schema: StructType, batch_id: str | None = None) -> int:
    """Append rows of a declared schema; returns how many were refused.

    Rows without a required value don't fit the table. None is lost: they go to the table beside it,
    `<path>-refused`, with the columns of the schema. With a batch_id both parts of the batch have a folder of their own that a
    replay of the same batch replaces, so an append that failed half way or is run twice leaves one copy;
    `read_log` reads such a table.
    """
    typed = materialise(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), "appended")
    fitting, refused = conform(typed, schema)
    n = refused.count()
    if batch_id is not None:
        fitting.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        refused.write.mode("overwrite").parquet(f"{path}-refused/{BATCH}={batch_id}")
        return n
    fitting.write.mode("append").parquet(path)
    if n:
        refused.write.mode("append").parquet(f"{path}-refused")
    return n


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a table that batches were appended to."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def write_clustered(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Store rows so that those of a key are found without reading the others: a folder per bucket of the key's hash,
    each sorted by key and with a Parquet bloom filter on it.

    A write replaces the table. buckets: folders; about one per 128 MB is right. Rows of one bucket are split over
    files by key range where there are many."""
    part = bucket_of(F.col(key), buckets)
    (df.withColumn(BUCKET, part).repartitionByRange(BUCKET, key).sortWithinPartitions(BUCKET, key)
     .write.mode("overwrite").partitionBy(BUCKET)
     .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path))
    df.sparkSession.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}-layout")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_clustered(spark: SparkSession, path: str, schema: StructType, key: str, keys: DataFrame | str) -> DataFrame:
    """The stored rows of one key, or of a table of keys.

    One key: the scan opens one bucket (a partition filter) and skips row groups by their bloom filters and bounds. A
    table of keys is joined by bucket and key, so that buckets without a wanted key are skipped at run time."""
    buckets = spark.read.schema("buckets int").parquet(f"{path}-layout").first().buckets
    stored = spark.read.schema(StructType(schema.fields + [StructField(BUCKET, IntegerType())])).parquet(path)
    if isinstance(keys, str):
        number = spark.range(1).select(bucket_of(F.lit(keys), buckets)).first()[0]
        return stored.filter((F.col(BUCKET) == number) & (F.col(key) == keys)).select(*schema.names)
    wanted = keys.select(F.col(key), bucket_of(F.col(key), buckets).alias(BUCKET)).distinct()
    return stored.join(wanted, [BUCKET, key], "left_semi").select(*schema.names)


def hash_supervisors(raw: DataFrame) -> DataFrame:
    """Supervisor rows as stored: PIN hashed, role list as JSON text, counters at zero.

    Input: supervisor_id, name, email, pin, roles.
    """
    return raw.select(
        "supervisor_id", "name", "email",
        text.pin_hash(F.col("pin")).alias("hashed_pin"),
        text.json_list(F.col("roles")).alias("can_approve_roles"),
        F.lit(False).alias("is_locked"),
        F.lit(0).cast("long").alias("failed_attempts"),
        F.lit(None).cast("string").alias("locked_by_session"))


def seed_dims(spark: SparkSession, supervisors: Sequence[tuple], managers: Sequence[tuple],
              manager_email: str = "") -> tuple[DataFrame, DataFrame]:
    """Both dimensions from configured rows: (id, name, email, pin, roles) and (id, name, email, may
    unlock). manager_email, where given, receives all escalations."""
    raw = spark.createDataFrame(
        supervisors, "supervisor_id string, name string, email string, pin string, roles array<string>")
    reached = [(i, n, manager_email or e, u) for i, n, e, u in managers]
    return hash_supervisors(raw), spark.createDataFrame(reached, schemas.MANAGERS)


def verify_readback(supervisors: DataFrame, managers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both dimensions in key order, role lists decoded."""
    return (
        supervisors.select("supervisor_id", "name",
                           text.parse_list(F.col("can_approve_roles")).alias("roles"),
                           "is_locked").orderBy("supervisor_id"),
        managers.select("manager_id", "name", "email", "can_unlock_supervisors").orderBy("manager_id"))


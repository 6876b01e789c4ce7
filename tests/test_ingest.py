import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests import seeds
from wardline import schemas
from wardline.operators import ingest
from wardline.sources import tables


@pytest.fixture()
def sheet(spark, tmp_path):
    path = tmp_path / "sheet.csv"
    path.write_text("NRIC,Name,Employment,Ethnicity,Medical_Info,Financial_Info\n"
                    " S1 , Ann ,Active,A,m1,10\nS2,Bob,,B,m2,20\n,NoKey,Active,C,m3,30\nnan,Text,Active,D,m4,40\n")
    return tables.read_personnel(spark, str(path))


def test_normalise_and_quarantine(sheet):
    stored, skipped, contents = ingest.ingest(sheet)
    rows = {r.nric: r for r in stored.collect()}
    assert stored.columns == schemas.EMPLOYEE_DATA.names
    assert set(rows) == {"S1", "S2"} and rows["S1"].name == "Ann" and rows["S2"].employment is None
    assert rows["S1"].criminal_record == "N/A"
    assert skipped.count() == 2
    assert {r.content for r in contents.collect()} == {"Name: Ann, Employment: Active", "Name: Bob, Employment: nan"}
    assert {r.employment for r in ingest.ingest(sheet, "nan")[0].collect()} == {"Active", "nan"}


def test_missing_file_fails(spark, tmp_path):
    with pytest.raises(AnalysisException):
        tables.read_personnel(spark, str(tmp_path / "none.csv")).count()


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_other_formats(spark, tmp_path, fmt, sheet):
    path = str(tmp_path / fmt)
    sheet.write.format(fmt).save(path)
    assert ingest.ingest(tables.read_personnel(spark, path, fmt))[0].count() == 2


def test_embedding_failures_cost_only_their_row(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, len(t)] for t in texts]

    df = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "fine!")], "nric string, content string").coalesce(1)
    got = {r.nric: r.embedding for r in ingest.embed_with(df, "content", model).collect()}
    assert got == {"a": [1.0, 4.0], "b": None, "c": [1.0, 5.0]}
    counts = ingest.ingest_counts(df, ingest.embed_with(df, "content", model)).first()
    assert tuple(counts) == (3, 2, 0, 1)


def test_refresh_replaces_and_ensure_is_idempotent(spark, tmp_path, sheet):
    root = str(tmp_path / "db")
    names = tables.ensure_tables(spark, root, "wl_test")
    assert tables.ensure_tables(spark, root, "wl_test") == names and len(names) == 6
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        return [[float(len(t))] for t in texts]

    assert tuple(ingest.ingest_job(sheet, model, "wl_test", root).first()) == (2, 2, 2, 0) and calls.value == 2
    assert spark.table("wl_test.employee_data").count() == spark.table("wl_test.employee_embeddings").count() == 2
    employees = ingest.ingest(sheet)[0]
    broken = employees.withColumn("name", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        tables.full_refresh({"wl_test.employee_embeddings": spark.table("wl_test.employee_embeddings").limit(1),
                             "wl_test.employee_data": broken}, root)
    assert spark.table("wl_test.employee_data").count() == spark.table("wl_test.employee_embeddings").count() == 2
    tables.full_refresh({"wl_test.employee_data": employees.filter("nric = 'S1'")}, root)
    assert [r.nric for r in spark.table("wl_test.employee_data").collect()] == ["S1"]
    for name in ("employee_data", "employee_embeddings"):
        tables.full_refresh({f"wl_test.{name}": spark.table(f"wl_test.{name}").filter("false")}, root)
    for name, schema in schemas.TABLES.items():
        assert spark.table(f"wl_test.{name}").columns == schema.names
        assert spark.table(f"wl_test.{name}").count() == 0
        spark.sql(f"DROP TABLE wl_test.{name}")
    spark.sql("DROP DATABASE wl_test")


def test_append_refuses_keyless_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("r", "x"), (None, "y")], "user_role string, request_id string").select(
        F.timestamp_seconds(F.lit(1)).alias("timestamp"), "user_role", "request_id", F.lit(True).alias("blocked"))
    tables.append(rows, path, schemas.RATE_LIMIT_LOG)
    tables.append(rows, path, schemas.RATE_LIMIT_LOG)
    assert spark.read.parquet(path).count() == 2


def test_vectors_survive_the_json_layout(spark):
    df = spark.createDataFrame([("a", "t", [0.5, -1.25])], schemas.EMPLOYEE_EMBEDDINGS)
    text = tables.encode_embeddings(df)
    assert text.first().embedding == "[0.5,-1.25]"
    assert tables.decode_embeddings(text).first().embedding == [0.5, -1.25]


def test_lookups(spark, tmp_path):
    from tests.conftest import plan_of
    spark.range(50).select(F.concat(F.lit("r"), "id").alias("request_id"), F.lit("d").alias("decision")).write.parquet(str(tmp_path / "a"))
    one = tables.lookup_audit_entry(spark.read.parquet(str(tmp_path / "a")), "r7")
    assert one.first().request_id == "r7" and "EqualTo(request_id,r7)" in plan_of(one)
    sup = seeds.seed_dims(spark)[0]
    asked = spark.createDataFrame([("a", " sup002"), ("b", "SUP999"), ("c", " ")], "request_id string, supervisor_id string")
    got = {r.request_id: r.supervisor_name for r in tables.lookup_supervisor(asked, sup).collect()}
    assert got == {"a": "Tomas Okoro", "b": None, "c": None}


def test_request_ids_are_assigned_once(spark):
    got = tables.with_request_ids(spark.range(20).select(F.lit("HR_Admin").alias("user_role")))
    first = sorted(r.request_id for r in got.collect())
    assert len(set(first)) == 20 and first == sorted(r.request_id for r in got.collect())
    kept = tables.with_request_ids(spark.createDataFrame([("a",), (None,)], "request_id string"))
    assert "a" in {r.request_id for r in kept.collect()} and kept.filter("request_id IS NULL").count() == 0


def test_append_keeps_refused_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', 'HR_Admin', 'a', false), (NULL, 'HR_Admin', 'b', false) AS t(timestamp, user_role, request_id, blocked)")
    assert tables.append(df, path, schemas.RATE_LIMIT_LOG) == 1
    assert [r.request_id for r in spark.read.parquet(path).collect()] == ["a"]
    assert [r.request_id for r in spark.read.parquet(f"{path}-refused").collect()] == ["b"]


def test_quoted_cells_of_a_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('NRIC,Name,Financial_Info\nS1,"Ann ""A"", B","line one\nline two"\n')
    rows = tables.read_personnel(spark, str(tmp_path / "s.csv")).collect()
    assert [tuple(r) for r in rows] == [("S1", 'Ann "A", B', "line one\nline two")]


def test_refused_batches_are_halved_and_equal_texts_asked_once(spark):
    asked, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        asked.add(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]

    rows = [(i, "same text") for i in range(500)] + [(500 + i, f"text {i}") for i in range(255)] + [(900, "bad"), (901, None)]
    df = spark.createDataFrame(rows, "id int, content string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r.id: r.embedding for r in ingest.embed_with(df, "content", model).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 757 and got[3] == [9.0] and got[600] == [float(len("text 100"))] and got[900] is None and got[901] is None
    # 257 different texts, one of them bad: two calls for each of the nine halvings at most
    assert calls.value <= 2 * 9 + 1 and asked.value <= 257 * 3


def test_counts_are_taken_while_writing(spark, tmp_path, sheet):
    tables.ensure_tables(spark, str(tmp_path / "db"), "wl_counts")
    counts = ingest.ingest_job(sheet, lambda texts: [[1.0] for _ in texts], "wl_counts", str(tmp_path / "db"))
    normalised = ingest.normalise(sheet)
    stored = ingest.split_by_key(normalised)[0].count()
    assert tuple(counts.first()) == (stored, stored, normalised.count() - stored, 0)


def test_a_batch_appended_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', 'HR_Admin', 'a', false), (NULL, 'HR_Admin', 'b', false) AS t(timestamp, user_role, request_id, blocked)")
    for _ in range(2):
        assert tables.append(df, path, schemas.RATE_LIMIT_LOG, "b1") == 1
    tables.append(df.withColumn("request_id", F.lit("c")), path, schemas.RATE_LIMIT_LOG, "b2")
    log = tables.read_log(spark, path, schemas.RATE_LIMIT_LOG)
    assert log.columns == schemas.RATE_LIMIT_LOG.names and sorted(r.request_id for r in log.collect()) == ["a", "c"]
    assert tables.read_log(spark, f"{path}-refused", schemas.RATE_LIMIT_LOG).count() == 2


def test_a_stored_log_is_read_by_key(spark, tmp_path):
    from tests.conftest import plan_of
    rows = spark.range(400).select(*[(F.concat(F.lit("r"), "id") if f.name == "request_id" else F.lit(None)).cast(f.dataType).alias(f.name)
                                     for f in schemas.AUDIT_LOG.fields])
    path = str(tmp_path / "log")
    tables.write_clustered(rows, path, "request_id", 8)
    one = tables.find_audit_entry(spark, path, "r77")
    assert [r.request_id for r in one.collect()] == ["r77"] and one.columns == schemas.AUDIT_LOG.names
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(key_bucket" in plan and "EqualTo(request_id,r77)" in plan
    files = tables.read_clustered(spark, path, schemas.AUDIT_LOG, "request_id", "r77")
    assert len(one.inputFiles()) <= len(files.inputFiles()) < 8 or files.count() == 1
    assert tables.find_audit_entry(spark, path, "missing").collect() == []
    wanted = spark.createDataFrame([("r3",), ("r399",), ("r3",), ("x",), (None,)], "request_id string")
    many = tables.read_clustered(spark, path, schemas.AUDIT_LOG, "request_id", wanted)
    assert sorted(r.request_id for r in many.collect()) == ["r3", "r399"]
    assert tables.read_clustered(spark, path, schemas.AUDIT_LOG, "request_id", rows.select("request_id")).count() == 400

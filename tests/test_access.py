import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_of
from wardline import policy
from wardline.operators import access

MUST_HAVE = {
    "General_Staff": ["name", "employment"],
    "HR_Admin": ["name", "employment", "nric", "ethnicity"],
    "Finance_Lead": ["name", "employment", "financial_info"],
    "Medical_Lead": ["name", "employment", "medical_info"],
}
GATED = {"General_Staff": False, "HR_Admin": True, "Finance_Lead": True, "Medical_Lead": True}


@pytest.fixture(scope="module")
def records(spark):
    row = ("q", "S1", "ann", None, "e", "m", "f", "c", 0.9)
    return spark.createDataFrame(
        [row], "request_id string, nric string, name string, employment string, ethnicity string, medical_info string, "
               "financial_info string, criminal_record string, _similarity_score double")


@pytest.mark.parametrize("role", list(MUST_HAVE))
def test_role_matrix(records, role):
    one = access.project_role(records, role)
    assert one.columns == ["request_id", *MUST_HAVE[role], "_similarity_score"]
    mixed = access.project_mixed(records.withColumn("user_role", F.lit(role))).first()
    assert mixed.fields == MUST_HAVE[role]
    for f in policy.EMPLOYEE_FIELDS:
        if f not in MUST_HAVE[role]:
            assert f not in mixed.asDict() or mixed[f] is None
    assert mixed.employment is None and "employment" in mixed.fields  # empty, not withheld
    n = access.records_returned(records.select("request_id"), records)
    row = n.select(access.needs_review(policy.allowed_fields(F.lit(role)), F.col("records_returned")).alias("x")).first()
    assert row.x == GATED[role]


def test_no_records_never_trigger(spark):
    row = spark.range(1).select(access.needs_review(policy.string_array(["nric"]), F.lit(0)).alias("x"),
                                access.needs_review(F.lit(None).cast("array<string>"), F.lit(3)).alias("y")).first()
    assert (row.x, row.y) == (False, False)


def test_unknown_role_sees_nothing(records):
    row = access.project_mixed(records.withColumn("user_role", F.lit("SuperAdmin"))).first()
    assert row.fields == [] and all(row[f] is None for f in policy.EMPLOYEE_FIELDS if f in row.asDict())


def test_policy_reports(spark):
    table = policy.role_policy(spark)
    assert not policy.policy_any(table, "criminal_record").first()[0]
    assert policy.policy_any(table, "nric").first()[0]
    denied = {r.role: r.denied_fields for r in policy.denied_fields(table).collect()}
    for role, fields in MUST_HAVE.items():
        assert sorted(denied[role] + fields) == sorted(policy.EMPLOYEE_FIELDS)


def test_scans_read_only_granted_columns(spark, tmp_path, records):
    records.write.parquet(str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))

    def read_by(df):
        return plan_of(df).split("ReadSchema: ")[1].split("\n")[0]

    finance = read_by(access.project_role(stored, "Finance_Lead"))
    assert "financial_info" in finance and "medical_info" not in finance and "nric" not in finance
    mixed = read_by(access.project_mixed(stored.withColumn("user_role", F.lit("HR_Admin"))))
    assert "criminal_record" not in mixed
    preview = read_by(access.gate_preview(stored.select("request_id", F.array(F.lit("name")).alias("fields"), "name")))
    assert "name" not in preview


def test_preview(spark):
    df = spark.createDataFrame([("a", ["name", "nric"]), ("a", ["name", "nric"]), ("b", ["name"])],
                               "request_id string, fields array<string>")
    got = {r.request_id: r for r in access.gate_preview(df).collect()}
    assert got["a"].records_pending == 2 and got["a"].sensitive_fields == ["nric"]
    assert got["b"].fields_in_results == ["name"] and got["b"].sensitive_fields == []

"""JN5, SNK9: joins that leave the stored table in place; create-if-absent; contract enforced on append."""

import uuid

import pytest

from quire.operators.vectors import VECTOR_KEYS, missing_vectors
from quire.sources import tables_by_key as by_key

COLUMNS = "team string, summary_type string, embedding array<double>"
DOCS = "team string, source_url string, metadata map<string,string>, timestamp timestamp, summaries map<string,string>"


@pytest.fixture
def table(spark, tmp_path):
    name, path = f"vectors_{uuid.uuid4().hex}", str(tmp_path / "vectors")
    assert by_key.create_vector_table(spark, name, path, COLUMNS, VECTOR_KEYS, 16, "embedding", 2)
    yield name, path
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_second_create_is_a_no_op(spark, table):
    name, path = table
    by_key.append(spark.createDataFrame([("a", "default", [1.0, 2.0])], COLUMNS), name, path)
    assert not by_key.create_vector_table(spark, name, path, COLUMNS, ["team"], 4, "embedding", 99)
    assert spark.table(name).count() == 1
    assert {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}[by_key.VECTOR_SIZE] == "2"


def test_contract_is_enforced_by_the_stored_size(spark, table):
    name, path = table
    rows = [("a", "default", [1.0, 2.0]), ("b", "default", [1.0]), ("c", "default", [0.0, 0.0]), ("d", "default", None), ("e", "x", [float("nan"), 1.0])]
    assert by_key.append(spark.createDataFrame(rows, COLUMNS), name, path) == (1, 4)
    got = {r.team: r.violation for r in spark.read.parquet(f"{path}_quarantine").collect()}
    assert got == {"b": "wrong_size", "c": "zero_norm", "d": "null", "e": "bad_value"}
    assert [r.team for r in spark.table(name).collect()] == ["a"]


def test_another_session_attaches_the_table(spark, table):
    name, path = table
    by_key.append(spark.createDataFrame([("a", "default", [1.0, 2.0])], COLUMNS), name, path)
    other = f"again_{uuid.uuid4().hex}"
    by_key.attach(spark, other, path)
    assert by_key.append(spark.createDataFrame([("b", "default", [1.0, 2.0]), ("c", "default", [1.0])], COLUMNS), other, path) == (1, 1)
    assert {r.team for r in spark.table(other).collect()} == {"a", "b"}
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {other}").collect()}
    assert described["Num Buckets"] == "16"
    spark.sql(f"DROP TABLE {other}")


def test_anti_join_leaves_the_stored_side_in_place(spark, table):
    name, path = table
    stored = [(f"t{i}", v, [1.0, float(i)]) for i in range(200) for v in ("default", "recent")]
    by_key.append(spark.createDataFrame(stored[:300], COLUMNS), name, path)
    by_key.append(spark.createDataFrame(stored[300:], COLUMNS), name, path)  # buckets of more than one file
    docs = spark.createDataFrame([(f"t{i}", "u", None, None, {"default": "x", "recent": "y", "achievements": "z"}) for i in range(190, 210)], DOCS)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = missing_vectors(docs, spark.table(name))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.team, r.summary_type) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    have = {(t, v) for t, v, _ in stored}
    assert got == sorted((f"t{i}", v) for i in range(190, 210) for v in ("default", "recent", "achievements") if (f"t{i}", v) not in have)
    assert plan.count("Exchange") == 1 and "SelectedBucketsCount: 16 out of 16" in plan
    assert "Exchange" not in plan[plan.index("ExistingRDD") :]  # what follows the documents' scan is the stored side

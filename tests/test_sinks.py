"""SNK1, SNK4 + SNK9 quarantine, AG1, AG4, TK5."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.operators.evaluate import has_scores, preview
from quire.operators.vectors import append_vectors
from quire.sources import sinks


def test_article_sink_and_text_export(spark):
    d = tempfile.mkdtemp(prefix="quire-art-")
    df = spark.createDataFrame([("A", "line1\nline2"), ("B", "x")], "team string, article string")
    sinks.write_articles(df, os.path.join(d, "pq"), os.path.join(d, "txt"))
    assert spark.read.parquet(os.path.join(d, "pq")).count() == 2
    text = spark.read.text(os.path.join(d, "txt", "team=A"), wholetext=True).first()[0]
    assert text.rstrip("\n") == "line1\nline2"


def test_vector_append_quarantines_bad_rows(spark):
    d = tempfile.mkdtemp(prefix="quire-vec-")
    rows = spark.createDataFrame(
        [("a", "default", [1.0, 0.0]), ("b", "default", [0.0, 0.0]), ("c", "recent", [1.0]), ("d", "x", None)],
        "team string, summary_type string, embedding array<double>",
    )
    path = os.path.join(d, "vectors")
    append_vectors(rows, path, dim=2)
    assert [r.team for r in spark.read.parquet(path).collect()] == ["a"]
    bad = {r.team: r.violation for r in spark.read.parquet(path + "_quarantine").collect()}
    assert bad == {"b": "zero_norm", "c": "wrong_size", "d": "null"}
    append_vectors(rows.filter(F.lit(False)), path, dim=2)  # empty batch appends nothing
    assert spark.read.parquet(path).count() == 1


def test_gates_and_preview(spark):
    w = spark.createDataFrame([("a", None), ("b", None)], "item_id string, combined_score double")
    assert w.count() == 2  # AG1
    assert not has_scores(w) and not has_scores(w.filter(F.lit(False)))
    assert has_scores(spark.createDataFrame([("a", 0.5)], "item_id string, combined_score double"))
    assert preview(spark.range(10)).count() == 5


def test_qa_pairs_round_trip_and_arrays(spark):
    from quire.sources import files

    d = tempfile.mkdtemp(prefix="quire-qa-")
    rows = [(f"q{i}\nline", None if i == 3 else f"ä {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "input string, expected_output string")
    sinks.write_qa_json(df.repartition(3), os.path.join(d, "lines"))
    assert sorted(map(tuple, files.qa_pairs(spark, os.path.join(d, "lines")).collect())) == sorted(rows)
    with open(os.path.join(d, "array.json"), "w") as f:
        f.write(' [\n {"input": "a",\n "expected_output": "b"}, {"input": "c", "expected_output": "d"}]\n')
    assert [tuple(r) for r in files.qa_pairs(spark, os.path.join(d, "array.json")).collect()] == [("a", "b"), ("c", "d")]


def test_get_or_create_keeps_null_keys_once(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="quire-set-"), "set")
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "again")], "k long, v string")
    assert sinks.append_new_rows(spark, df, path, ["k"]).count() == 2
    assert sinks.append_new_rows(spark, df, path, ["k"]).count() == 0
    assert spark.read.parquet(path).count() == 2
    os.makedirs(path + "-broken")
    with open(os.path.join(path + "-broken", "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):  # an unreadable set is no missing set
        sinks.append_new_rows(spark, df, path + "-broken", ["k"])


def test_experiment_rows_are_appended(spark):
    from quire.operators.observe import experiment_row

    path = tempfile.mkdtemp(prefix="quire-exp-")
    scores = spark.createDataFrame([("i", 0, "F1", 0.5)], "item_id string, ordinal int, name string, value double")
    for name in ("one", "two"):
        sinks.append_experiment(experiment_row(spark, name, {"k": 3}), scores, path)
    assert {r.name for r in spark.read.parquet(f"{path}/experiments").collect()} == {"one", "two"}
    assert {r.experiment for r in spark.read.parquet(f"{path}/scores").collect()} == {"one", "two"}


def test_file_names_with_spaces(spark):
    from quire.sources import files

    d = tempfile.mkdtemp(prefix="quire-names-")
    for name in ("real madrid.md", "a+b 100%.md"):
        with open(os.path.join(d, name), "w") as f:
            f.write("x")
    assert {r.filename for r in files.cached_articles(spark, d).collect()} == {"real madrid.md", "a+b 100%.md"}


def test_infinite_vectors_break_the_contract(spark):
    from quire.functions.vectors import contract_violation

    df = spark.createDataFrame([([1.0, float("inf")],), ([1.0, float("-inf")],), ([float("nan"), 1.0],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in df.select(contract_violation("v", 2)).collect()] == ["bad_value"] * 3 + [None]


def test_qa_set_as_one_json_array(spark, tmp_path):
    """SNK5 -> SRC7: one indented array in the order of the rows, read back as it was."""
    import glob
    import json

    from quire.sources import files, sinks

    rows = [(2, "two \"quoted\" é 中🎉", "line\nbreak\t\\ \u2028 /"), (1, "one", ""), (3, None, "\x01\x1f"), (4, "four", None)]
    df = spark.createDataFrame(rows, "n int, input string, expected_output string").repartition(3)
    path = str(tmp_path / "qa")
    sinks.write_qa_json_array(df, path, "n")
    [file] = glob.glob(f"{path}/part-*")
    text = open(file, encoding="utf-8").read()
    want = [{"input": i, "expected_output": o} for _, i, o in sorted(rows)]
    assert json.loads(text) == want and "é 中🎉" in text
    assert text.replace("\\u001F", "\\u001f").rstrip("\n") == json.dumps(want, indent=2, ensure_ascii=False)
    assert [tuple(r) for r in files.qa_pairs(spark, path).collect()] == [(i, o) for _, i, o in sorted(rows)]
    sinks.write_qa_json_array(df.limit(0), path)
    assert files.qa_pairs(spark, path).count() == 0
    sinks.write_qa_json_array(spark.createDataFrame([("a", "b"), ("c", "d")], "input string, expected_output string"), path)
    assert [tuple(r) for r in files.qa_pairs(spark, path).collect()] == [("a", "b"), ("c", "d")]


def test_an_experiment_run_again_replaces_its_scores(spark, tmp_path):
    from quire.operators.observe import experiment_row
    from quire.sources import sinks

    path = str(tmp_path / "experiments")
    for name, values in (("one", [0.1, 0.2]), ("two", [0.5]), ("one", [0.3])):
        sinks.append_experiment(experiment_row(spark, name, {}), spark.createDataFrame([(v,) for v in values], "score double"), path)
    assert sorted(r.name for r in spark.read.parquet(f"{path}/experiments").collect()) == ["one", "two"]
    assert sorted((r.experiment, r.score) for r in spark.read.parquet(f"{path}/scores").collect()) == [("one", 0.3), ("two", 0.5)]

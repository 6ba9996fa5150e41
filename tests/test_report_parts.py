"""AG2/AG3/OB3 over runs: parts merge to the whole, re-runs replace, sketches stay within their error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import evaluate, report_parts

SCHEMA = "item_id string, team string, summary_type string, bert_f1 double, cosine_similarity double, combined_score double"


def items(n, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        f1, cos = (None, None) if rng.random() < 0.1 else map(float, rng.random(2).round(2))
        combined = None if f1 is None else 0.6 * f1 + 0.4 * cos
        out.append((f"i{i:05}", f"t{int(rng.integers(400))}", ["default", "recent", "achievements", None][int(rng.integers(4))], f1, cos, combined))
    return out


def stored(spark, path, rows, k):
    for part in range(k):
        report_parts.store_part(spark.createDataFrame(rows[part::k], SCHEMA), path, str(part))
    return report_parts.read_parts(spark, path)


@pytest.mark.parametrize("k", [1, 4])
def test_parts_merge_to_the_whole(spark, tmp_path, k):
    rows = items(3000)
    parts, whole = stored(spark, str(tmp_path / "parts"), rows, k), spark.createDataFrame(rows, SCHEMA)
    got, want = report_parts.merged_report(parts).collect(), evaluate.type_report(whole).collect()
    assert [g.summary_type for g in got] == [w.summary_type for w in want] == ["achievements", "default", "recent"]
    for g, w in zip(got, want):
        assert np.allclose([g[c] for c in report_parts.SCORES], [w[c] for c in report_parts.SCORES], atol=1e-12) and g.line == w.line
        mine = [r for r in rows if r[2] == g.summary_type]
        assert g.n_items == len(mine)
        assert abs(g.n_teams - len({r[1] for r in mine})) <= 0.05 * g.n_teams
        scores = np.sort([r[5] for r in mine if r[5] is not None])
        for q in report_parts.QUANTILES:
            rank = np.searchsorted(scores, g[f"combined_p{round(100 * q)}"], side="right") / len(scores)
            assert abs(rank - q) < 0.05
    assert report_parts.merged_best_worst(parts).collect() == evaluate.best_worst(whole).collect()


def test_a_run_stored_again_replaces_its_part(spark, tmp_path):
    path, rows = str(tmp_path / "parts"), items(200)
    stored(spark, path, rows, 2)
    report_parts.store_part(spark.createDataFrame(rows[1::2], SCHEMA), path, "1")
    parts = report_parts.read_parts(spark, path)
    assert parts.agg(F.sum("n_items")).first()[0] == 200
    by_run = report_parts.merged_report(parts, ["run"]).collect()
    assert [(r.summary_type, r.run) for r in by_run][:2] == [("achievements", "0"), ("achievements", "1")]
    one = report_parts.read_parts(spark, path, ["1"])
    assert one.agg(F.sum("n_items")).first()[0] == 100
    # a run that lost all its items leaves nothing behind
    report_parts.store_part(spark.createDataFrame([], SCHEMA), path, "1")
    assert report_parts.read_parts(spark, path).agg(F.sum("n_items")).first()[0] == 100


def test_without_scores_or_items(spark, tmp_path):
    path = str(tmp_path / "parts")
    report_parts.store_part(spark.createDataFrame([("a", None, "default", None, None, None), ("b", None, None, 0.5, 0.5, 0.5)], SCHEMA), path, "x")
    parts = report_parts.read_parts(spark, path)
    (row,) = report_parts.merged_report(parts).collect()
    assert (row.n_items, row.n_teams, row.bert_f1, row.combined_p50) == (1, 0, None, None)
    # one score is no best and worst
    assert report_parts.merged_best_worst(parts).collect() == []
    report_parts.store_part(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), "x")
    none = report_parts.read_parts(spark, str(tmp_path / "none"))
    assert report_parts.merged_report(none).collect() == [] and report_parts.merged_best_worst(none).collect() == []

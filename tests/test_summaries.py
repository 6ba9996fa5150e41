"""JN3/JN4/ML3/ML4/AG7: incremental summarisation with stand-in and failing models."""

from pyspark.sql import functions as F

from quire.operators.models import LeadChat
from quire.operators.summaries import incremental_summaries, missing_pairs

DOCS = "_id long, team string, content string, summaries map<string,string>"


def docs(spark):
    rows = [
        (1, "t1", "alpha beta gamma", None),
        (2, "t2", "alpha beta gamma", {}),
        (3, "t3", "alpha beta gamma", {"default": "  ", "recent": "kept", "legacy": "x"}),
        (4, "t4", "   ", None),
        (5, "t5", " ".join(f"w{i}" for i in range(40)), {"default": "d", "recent": "r", "achievements": "a"}),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_missing_pairs(spark):
    got = sorted((r._id, r.variant) for r in missing_pairs(docs(spark)).collect())
    want = [(1, v) for v in ("achievements", "default", "recent")] + [(2, v) for v in ("achievements", "default", "recent")]
    want += [(3, "achievements"), (3, "default")]
    assert got == sorted(want)


def test_fill_keeps_existing_and_unknown_keys(spark):
    out = {r._id: r for r in incremental_summaries(docs(spark), LeadChat(5), 100_000).collect()}
    assert out[3].summaries["recent"] == "kept" and out[3].summaries["legacy"] == "x"
    assert out[3].summaries["default"].startswith("Create a comprehensive summary")
    assert out[4].summaries is None  # blank content is skipped
    assert out[5].summaries == {"default": "d", "recent": "r", "achievements": "a"}
    assert not out[5].summaries_changed and out[1].summaries_changed


class FailingParts:
    """Fails every per-chunk call; the combine call echoes its input length."""

    def complete(self, system, user, max_tokens=1500):
        from quire.operators.summaries import SYSTEM_PART

        value = F.when(system == F.lit(SYSTEM_PART), F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("n="), F.length(user).cast("string"))
        )
        return F.struct(value.alias("value"), F.lit(None).cast("string").alias("error"))


def test_multi_chunk_all_parts_failing_still_combines(spark):
    d = spark.createDataFrame([(9, "t9", " ".join(f"w{i}" for i in range(30)), None)], DOCS)
    out = incremental_summaries(d, FailingParts(), chunk_tokens=10).first()
    # the combine prompt is the fixed prefix over an empty concatenation
    assert set(out.summaries) == {"default", "recent", "achievements"}
    assert all(v == "n=" + str(len("Combine the following parts into a cohesive summary:\n\n")) for v in out.summaries.values())


def test_multi_chunk_prompts_are_variant_independent(spark):
    d = spark.createDataFrame([(9, "t9", " ".join(f"w{i}" for i in range(300)), None)], DOCS)
    out = incremental_summaries(d, LeadChat(40), chunk_tokens=50).first()
    vals = set(out.summaries.values())
    assert len(vals) == 1 and next(iter(vals)).startswith("Combine the following parts")


def test_model_partitions_keep_results(spark):
    a = {r._id: r.summaries for r in incremental_summaries(docs(spark), LeadChat(5), 100_000).collect()}
    b = {r._id: r.summaries for r in incremental_summaries(docs(spark), LeadChat(5), 100_000, model_partitions=3).collect()}
    assert a == b

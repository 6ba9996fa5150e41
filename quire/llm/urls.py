"""URL filter: host rules first, gradient-boosted trees on lexical features for the rest.

Only DataFrame and SQL functions, and Spark's own tree learner, are used.

* Rules are (verdict, host, path) and fit the host, all its subdomains, and
  paths that start with the rule's path.  A URL's host is tried with each of
  its suffixes, so rules of any number are an equality join, not a scan of
  rules per URL; of fitting rules the longest text wins.
* URLs that a rule decides are the labelled ones.  Features: length, depth,
  digit ratio, entropy of characters, parameter counts, host shape, and
  statistics of suffixes: how often labelled URLs with the same last host
  label, and with the same first path segment, are blocked (smoothed).
* Trees learn from a sample of about ``SAMPLE`` labelled URLs (by a hash of the
  URL); suffix statistics count all of them.

Defined results: a null URL, or one without ``://``, has an empty host and
path and no rule; each row is judged by itself; with labels of one kind only
the method gives that kind, with none ``allow``.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut_lineage

#: labelled URLs that the trees are fitted on, about
SAMPLE = 20_000
TREES, DEPTH = 20, 4
#: partitions of that sample
PARTS = 8
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "hyphens", "labels", "host_length", "path_length", "secure", "numbered", "suffix_rate", "segment_rate")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    fits = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return F.when(fits, host).otherwise(F.lit("")), F.when(fits, path).otherwise(F.lit(""))


def with_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows(host, path)`` with ``rule`` and ``ruled`` (its verdict) of the longest fitting rule, or nulls."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, []).append((path, verdict))
    # the given rules are a literal map: host -> its rules, looked up once per suffix
    entry = lambda host: F.array(*[F.struct(F.lit(len(host) + len(p)).alias("size"), F.lit(host + p).alias("rule"), F.lit(p).alias("start"), F.lit(v).alias("verdict")) for p, v in by_host[host]])
    known = F.create_map(*[x for h in by_host for x in (F.lit(h), entry(h))])
    tried = F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(known, s)), lambda s: F.element_at(known, s)))
    best = F.array_max(F.filter(tried, lambda r: F.startswith(F.col("path"), r["start"])))
    return rows.withColumn("__best", best).withColumn("rule", F.col("__best.rule")).withColumn("ruled", F.col("__best.verdict")).drop("__best")


def lexical(rows: DataFrame) -> DataFrame:
    """``rows(url, host, path)`` with the lexical features."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    entropy = F.aggregate(
        F.transform(letters, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n), F.lit(0.0), lambda t, p: t - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    )
    return rows.select(
        "*",
        F.log1p(n.cast("double")).alias("length"), count("path", "/").cast("double").alias("depth"),
        F.when(n > 0, count(url, "[0-9]") / n).otherwise(0.0).alias("digits"), entropy.alias("entropy"),
        count(url, "[&?=]").cast("double").alias("parameters"), count("host", "-").cast("double").alias("hyphens"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"), F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"), F.lower(F.substring(url, 1, 6)).eqNullSafe("https:").cast("double").alias("secure"),
        F.length(F.regexp_extract("path", "[0-9]*$", 0)).cast("double").alias("numbered"),
        F.try_element_at(F.split("host", r"\."), F.lit(-1)).alias("__suffix"), F.try_element_at(F.split("path", "/"), F.lit(2)).alias("__segment"),
    )


def _rates(rows: DataFrame, key: str, labelled: DataFrame) -> DataFrame:
    """``rows`` with the smoothed block rate of their ``key`` among the labelled rows."""
    stats = labelled.groupBy(key).agg(F.sum("label").alias("__b"), F.count("*").alias("__n"))
    rate = (F.coalesce("__b", F.lit(0.0)) + 5.0) / (F.coalesce("__n", F.lit(0)) + 10.0)
    return rows.join(stats, key, "left").withColumn({"__suffix": "suffix_rate", "__segment": "segment_rate"}[key], rate).drop("__b", "__n")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` and ``score`` (the method's block probability)."""
    own = [c for c in pages.columns]
    rows = pages.select(F.struct(*own).alias("__row"), F.col(url_col).cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = with_rules(rows.withColumn("host", host).withColumn("path", path), rules)
    rows = cut_lineage(lexical(rows).withColumn("label", F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)))
    labelled = rows.where("label is not null")
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    result = [F.col(f"__row.`{c}`").alias(c) for c in own if c not in ("host", "path", "rule", "verdict", "score")]
    if len(counts) < 2:
        rows = rows.withColumn("score", F.lit(float(next(iter(counts), 0.0))))
    else:
        rows = _rates(_rates(rows, "__suffix", labelled), "__segment", labelled)
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(rows)
        share = min(1.0, SAMPLE / sum(counts.values()))
        # a bounded sample: a few partitions serve the learner's many short jobs
        drawn = rows.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < share * (1 << 30))).select("__x", "label")
        sample = cut_lineage(drawn.repartition(PARTS))
        if sample.select("label").distinct().count() < 2:
            rows = rows.withColumn("score", F.lit(float(max(counts, key=lambda k: counts[k]))))
        else:
            model = GBTClassifier(featuresCol="__x", labelCol="label", predictionCol="__p", maxIter=TREES, maxDepth=DEPTH, seed=7).setRawPredictionCol("__r").setProbabilityCol("__q").fit(sample)
            rows = model.transform(rows).withColumn("score", vector_to_array("__q")[1])
    return rows.select(*result, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")

"""Findings scored against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPECTATION = "file string, language string, modality string, rule_id string, min_count int, package string, ecosystem string"


def modality(kind):
    return F.coalesce(kind, F.lit("sast"))


def score(findings: DataFrame, cases: DataFrame, expectations: DataFrame) -> DataFrame:
    """(file, language, modality, rule_id, outcome, n) with outcome TP, FN or FP; only files among the cases (file, language) are scored.

    An expectation holds if its file has at least min_count findings of its rule (or a dependency
    of its package); what matches it is used up either way. Other findings of the file are false positives.
    """
    f = findings.join(cases.select("file", F.col("language").alias("case_lang")).distinct(), "file")
    key = F.when(F.col("kind") == "sca", F.concat(F.lit("dep:"), "dependency.ecosystem", F.lit(":"), "dependency.package")).otherwise(F.col("rule_id"))
    f = f.withColumn("key", key)
    e = expectations.withColumn("key", F.when(F.coalesce("package", F.lit("")) != "", F.concat(F.lit("dep:"), "ecosystem", F.lit(":"), "package")).otherwise(F.col("rule_id")))
    e = e.groupBy("file", "language", "modality", "key").agg(F.max(F.greatest(F.coalesce("min_count", F.lit(1)), F.lit(1))).alias("need"))
    got = f.groupBy("file", "key").agg(F.count("*").alias("n"))
    hit = e.join(got, ["file", "key"], "left").select("file", "language", "modality", F.col("key").alias("rule_id"), F.when(F.coalesce("n", F.lit(0)) >= F.col("need"), "TP").otherwise("FN").alias("outcome"), F.lit(1).cast("long").alias("n"))
    rest = f.join(e.select("file", "key"), ["file", "key"], "left_anti")
    fp = rest.groupBy("file", F.col("case_lang").alias("language"), modality(F.col("kind")).alias("modality"), F.col("key").alias("rule_id")).agg(F.count("*").alias("n")).withColumn("outcome", F.lit("FP"))
    return hit.unionByName(fp)


def _counts():
    return [F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).cast("long").alias(o.lower()) for o in ("TP", "FP", "FN")]


def _ratio(a, b):
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.round(a / (a + b), 6))


def summary(scores: DataFrame) -> DataFrame:
    t = scores.agg(*_counts())
    return t.select("tp", "fp", "fn", _ratio(F.col("tp"), F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("fn")).alias("recall"))


def by(scores: DataFrame, column: str) -> DataFrame:
    """tp, fp, fn by language, rule_id or modality."""
    return scores.groupBy(column).agg(*_counts())


def gate(scores: DataFrame, min_recall: float = 0.90, max_fp: int = 0) -> DataFrame:
    return summary(scores).withColumn("passed", (F.col("recall") >= min_recall) & (F.col("fp") <= max_fp))

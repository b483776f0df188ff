"""Dependencies joined with advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosec.functions.text import digest

ADVISORY = "id string, ecosystem string, package string, introduced string, fixed string, severity string, summary string, aliases array<string>"


def version_key(v: Column) -> Column:
    """A version as an array of numbers that compares in order; letters and build parts after the numbers are passed over."""
    digits = F.regexp_extract_all(F.regexp_extract(F.coalesce(v, F.lit("")), r"\A[vV]?([0-9]+(?:\.[0-9]+)*)", 1), F.lit(r"([0-9]+)"))
    padded = F.transform(digits, lambda d: F.lpad(d, 12, "0"))
    return F.array_join(F.slice(F.concat(padded, F.array_repeat(F.lit("0" * 12), 6)), 1, 6), ".")


def osv_severity(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.isin("critical", "high", "low"), low).when(low == "moderate", "medium").otherwise("medium")


def vulnerable_range(introduced: Column, fixed: Column) -> Column:
    low = F.concat(F.lit(">="), F.coalesce(introduced, F.lit("0")))
    return F.when(F.coalesce(fixed, F.lit("")) != "", F.concat(low, F.lit(", <"), fixed)).otherwise(low)


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """A row for each dependency with advisories whose range holds its version; the first advisory by id gives range and severity."""
    a = advisories.withColumn("k0", version_key(F.coalesce("introduced", F.lit("0")))).withColumn("k1", version_key(F.col("fixed")))
    d = deps.withColumn("k", version_key(F.col("version")))
    j = d.join(a.select("id", "ecosystem", "package", "introduced", "fixed", F.col("severity").alias("raw"), "k0", "k1"), ["ecosystem", "package"])
    j = j.where((F.col("k") >= F.col("k0")) & ((F.coalesce("fixed", F.lit("")) == "") | (F.col("k") < F.col("k1"))))
    g = j.groupBy("ecosystem", "package", "version", "manifest", "direct").agg(F.array_sort(F.collect_set("id")).alias("advisory_ids"), F.min(F.struct("id", "introduced", "fixed", "raw")).alias("f"))
    given = F.coalesce("f.raw", F.lit("")) != ""
    return g.select(
        "ecosystem", "package", "version", "manifest", "direct", "advisory_ids", vulnerable_range(F.col("f.introduced"), F.col("f.fixed")).alias("vulnerable_range"),
        F.col("f.fixed").alias("fixed_version"), osv_severity(F.col("f.raw")).alias("severity"), F.when(given, "high").otherwise("low").alias("confidence"),
        digest(F.col("ecosystem"), F.col("package"), F.coalesce("f.id", F.lit("none"))).alias("fingerprint"),
    )

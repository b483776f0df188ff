"""One findings table for all modalities, and what is done with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argosec.functions.text import digest, glob_regex, severity_rank, squeeze

FINDING = (
    "rule_id string, rule_name string, category string, severity string, confidence string, message string, kind string, language string, file string, "
    "start_line int, start_col int, end_line int, end_col int, fingerprint string, evidence array<struct<snippet:string,start_line:int,end_line:int>>, "
    "cwe array<string>, owasp array<string>, rationale string, remediation string, references array<string>, tags array<string>, metadata map<string,string>, secret struct<redacted:string,entropy:double>, "
    "dependency struct<ecosystem:string,package:string,version:string,vulnerable_range:string,fixed_version:string,advisory_ids:array<string>,direct:boolean>, "
    "config struct<framework:string,key:string>, taint struct<source_var:string,source_expr:string,sink:string,path:array<struct<line:int,col:int>>>"
)


def _shape(df: DataFrame, kind: str) -> DataFrame:
    """Every column of FINDING, null where df has none."""
    import re

    fields = [f.split(" ", 1) for f in re.split(r", (?=[a-z_]+ )", FINDING)]
    have = set(df.columns) | {"kind"}
    df = df.withColumn("kind", F.lit(kind))
    return df.select(*((F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in fields))


def sast_findings(matches: DataFrame, files: DataFrame | None = None, symbols: DataFrame | None = None, taint: DataFrame | None = None) -> DataFrame:
    """Findings of matched nodes; the fingerprint is stable when lines move: rule, enclosing symbol, squeezed snippet.

    Nodes that bring their facts (symbol, snippet, taints) need no join; for others files, symbols and taint are joined.
    """
    m = matches.withColumn("page", F.regexp_replace("path", r"#script\d+\z", ""))
    if "snippet" in m.columns:
        t = F.try_element_at(F.filter(F.coalesce("taints", F.array()), lambda t: t["var"] == F.col("tainted_var")), F.lit(1))
        m = m.withColumn("reason", t["reason"]).withColumn("path_locs", t["path_locs"])
    else:
        m = _join_facts(m, files, symbols, taint)
    sink = F.when(F.coalesce("rule.callee", F.lit("")) != "", F.col("rule.callee")).otherwise(F.col("lhs"))
    r = m.select(
        F.col("rule.id").alias("rule_id"), F.col("rule.name").alias("rule_name"), "rule.category", "rule.severity", "rule.confidence", "rule.message", "rule.rationale", F.col("rule.fix_suggestion").alias("remediation"), "rule.references", "rule.tags", "language", F.col("page").alias("file"),
        "start_line", "start_col", "end_line", "end_col", digest(F.col("rule.id"), F.col("symbol"), squeeze(F.col("snippet"))).alias("fingerprint"),
        F.when(F.col("snippet") != "", F.array(F.struct("snippet", "start_line", "end_line"))).alias("evidence"), "rule.cwe", "rule.owasp",
        F.when(F.coalesce("tainted_var", F.lit("")) != "", F.struct(F.col("tainted_var").alias("source_var"), F.col("reason").alias("source_expr"), sink.alias("sink"), F.col("path_locs").alias("path"))).alias("taint"),
    )
    return _shape(r, "sast")


def _join_facts(m: DataFrame, files: DataFrame, symbols: DataFrame, taint: DataFrame | None) -> DataFrame:
    from argosec.operators.symbols import enclosing_symbol

    src = files.select(F.col("path").alias("page"), F.split("content", "\n").alias("src"))
    m = m.join(src, "page", "left")
    at = F.col("start_line")
    body = F.array_join(F.slice("src", F.greatest(at, F.lit(1)), F.greatest(F.col("end_line") - at + 1, F.lit(1))), "\n")
    m = m.withColumn("snippet", F.when(F.col("text") != "", F.col("text")).when((at >= 1) & (at <= F.size("src")), body).otherwise(""))
    enc = enclosing_symbol(m.select("path", at.alias("line")).distinct(), symbols)
    m = m.join(enc.withColumnRenamed("line", "start_line"), ["path", "start_line"], "left")
    if taint is None:
        return m.withColumn("reason", F.lit(None).cast("string")).withColumn("path_locs", F.lit(None).cast("array<struct<line:int,col:int>>"))
    t = taint.where("tainted").select("path", F.col("var").alias("tainted_var"), "reason", "path_locs")
    return m.join(t, ["path", "tainted_var"], "left")


def secret_findings(secrets: DataFrame) -> DataFrame:
    s = secrets.select("rule_id", "rule_name", F.lit("secrets").alias("category"), "severity", F.lit("high").alias("confidence"), F.concat("rule_name", F.lit(" found")).alias("message"), F.lit("unknown").alias("language"), F.col("path").alias("file"), F.col("line_no").alias("start_line"), F.lit(0).alias("start_col"), F.col("line_no").alias("end_line"), F.lit(0).alias("end_col"), "fingerprint", F.struct("redacted", "entropy").alias("secret"))
    return _shape(s, "secret")


def config_findings(configs: DataFrame) -> DataFrame:
    c = configs.select("rule_id", F.concat(F.lit("Insecure "), "framework", F.lit(" configuration")).alias("rule_name"), F.lit("security-misconfiguration").alias("category"), "severity", F.lit("medium").alias("confidence"), F.concat("key", F.lit(" is unsafe in "), "path").alias("message"), F.lit("unknown").alias("language"), F.col("path").alias("file"), F.col("line").alias("start_line"), F.lit(0).alias("start_col"), F.col("line").alias("end_line"), F.lit(0).alias("end_col"), "fingerprint", F.when(F.col("value") != "", F.array(F.struct(F.col("value").alias("snippet"), F.col("line").alias("start_line"), F.col("line").alias("end_line")))).alias("evidence"), F.struct("framework", "key").alias("config"))
    return _shape(c, "config")


def dependency_findings(vulnerable: DataFrame) -> DataFrame:
    d = F.struct("ecosystem", "package", "version", "vulnerable_range", "fixed_version", "advisory_ids", "direct")
    v = vulnerable.select(F.lit("ZS-SCA-001").alias("rule_id"), F.lit("Vulnerable dependency").alias("rule_name"), F.lit("dependency").alias("category"), "severity", "confidence", F.concat("package", F.lit(" "), "version", F.lit(" is vulnerable")).alias("message"), F.lit("unknown").alias("language"), F.col("manifest").alias("file"), F.lit(0).alias("start_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_line"), F.lit(0).alias("end_col"), "fingerprint", d.alias("dependency"))
    return _shape(v, "sca")


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedup(findings: DataFrame, compat: bool = False) -> DataFrame:
    """One finding for each rule, file, line and column, the first by fingerprint and message. Dependency findings are
    kept apart by fingerprint, unless compat asks for one a manifest."""
    own = F.lit("") if compat else F.when(F.col("kind") == "sca", F.col("fingerprint")).otherwise("")
    w = Window.partitionBy("rule_id", "file", "start_line", "start_col", own).orderBy("fingerprint", "message")
    return findings.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def allowlist(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(a_id, a_fp, a_rx): suppressions by fingerprint, by rule and path glob, or by rule."""
    rows = [(e.get("id"), e.get("fingerprint"), glob_regex(e["path"], True) if e.get("path") else None) for e in entries]
    return spark.createDataFrame(rows, "a_id string, a_fp string, a_rx string")


def suppressed(findings: DataFrame, allow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): anti and semi join. A fingerprint goes before all else, then rule with path, then rule; the glob may match the path or its last part."""
    base = F.regexp_extract("file", r"([^/]*)\z", 1)
    by_path = F.col("a_rx").isNotNull() & (F.rlike(F.col("file"), F.col("a_rx")) | F.rlike(base, F.col("a_rx")))
    hit = F.when(F.col("a_fp").isNotNull(), F.col("a_fp") == F.col("fingerprint")).otherwise((F.col("a_id") == F.col("rule_id")) & (F.col("a_rx").isNull() | by_path))
    a = F.broadcast(allow)
    return findings.join(a, hit, "left_anti"), findings.join(a, hit, "left_semi")


def correlate(findings: DataFrame) -> DataFrame:
    """Findings of a file that share a tainted variable get chain_id, chain_rules and chain_size in their metadata."""
    var = F.col("taint.source_var")
    use = (F.col("kind") == "sast") & (F.coalesce(var, F.lit("")) != "")
    w = Window.partitionBy("file", F.when(use, var))
    n = F.count(F.when(use, 1)).over(w)
    rules = F.array_sort(F.collect_set(F.when(use, F.col("rule_id"))).over(w))
    chain = F.create_map(F.lit("chain_id"), digest(F.col("file"), var, length=12), F.lit("chain_rules"), F.array_join(rules, ","), F.lit("chain_size"), n.cast("string"))
    old = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return findings.withColumn("metadata", F.when(use & (n >= 2), F.map_concat(old, chain)).otherwise(F.col("metadata")))


def stats(findings: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by kind, severity, language and category in one pass; unknown languages and empty categories are left out."""
    g = findings.sparkSession.sql(
        """SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(severity) = 0 THEN 'severity'
             WHEN grouping(language) = 0 THEN 'language' ELSE 'category' END AS dimension,
             coalesce(kind, severity, language, category) AS value, count(*) AS n
           FROM {f} GROUP BY GROUPING SETS ((kind), (severity), (language), (category))""",
        f=findings.select("kind", "severity", "language", "category"),
    )
    return g.where("value is not null and value <> '' and not (dimension = 'language' and value = 'unknown')")


KEYS = {"file": "file", "rule": "rule_id", "severity": "severity", "language": "language"}


def groups(findings: DataFrame, by: str) -> DataFrame:
    """(key, n, first) by file, rule, severity or language; severities by rank, others by first appearance (file, line, column, rule). A row a group, pre-aggregated."""
    first = F.struct("file", "start_line", "start_col", "rule_id", "fingerprint")
    g = findings.groupBy(F.col(KEYS[by]).alias("key")).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return g.orderBy(severity_rank(F.col("key")) if by == "severity" else F.col("first"), "key")


def grouped(findings: DataFrame, by: str) -> DataFrame:
    """Findings in the order of their groups and of their places, with key and n of the group; rows, so that a group may be of any size."""
    g = groups(findings, by).select("key", "n", F.col("first").alias("group_first"))
    order = severity_rank(F.col("key")) if by == "severity" else F.col("group_first")
    joined = findings.join(g, F.col(KEYS[by]).eqNullSafe(F.col("key")))
    return joined.orderBy(order, "key", "file", "start_line", "start_col", "rule_id", "fingerprint").drop("group_first")

"""Sinks: JSON, SARIF, HTML and the accuracy report."""

from __future__ import annotations

import html as _html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosec.functions.text import classification_tag, sarif_level
from argosec.operators.findings import grouped, stats

ORDER = ("file", "start_line", "start_col", "rule_id", "fingerprint")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_index, rule_id, rule_name, level, tags, rationale, remediation, references): each rule once, in order of first appearance."""
    at = F.struct(*ORDER)
    have = set(findings.columns)
    text = [c for c in ("cwe", "owasp", "references", "rationale", "remediation") if c in have]
    seen = findings.groupBy("rule_id").agg(F.min(at).alias("first"), F.min_by("rule_name", at).alias("rule_name"), F.min_by("severity", at).alias("severity"), *(F.min_by(c, at).alias(c) for c in text))
    for c in ("cwe", "owasp", "references", "rationale", "remediation"):
        if c not in have:
            seen = seen.withColumn(c, F.lit(None).cast("string" if c in ("rationale", "remediation") else "array<string>"))
    ix = F.row_number().over(Window.orderBy("first")) - 1  # a row a rule
    none = F.array().cast("array<string>")
    tags = F.transform(F.concat(F.coalesce("cwe", none), F.coalesce("owasp", none)), classification_tag)
    return seen.select(ix.alias("rule_index"), "rule_id", "rule_name", sarif_level(F.col("severity")).alias("level"), tags.alias("tags"), "rationale", "remediation", "references")


def _sarif_rule(r) -> dict:
    out = {"id": r.rule_id, "name": r.rule_name, "shortDescription": {"text": r.rule_name}, "defaultConfiguration": {"level": r.level}}
    if r.rationale:
        out["fullDescription"] = {"text": r.rationale}
    help_ = "\n\n".join(x for x in (r.rationale, f"Remediation: {r.remediation}" if r.rationale and r.remediation else r.remediation) if x)
    if len(r.references or []) > 1:
        help_ += "".join(["\n\nReferences:", *(f"\n- {x}" for x in r.references)])
    if help_:
        out["help"] = {"text": help_}
    if r.references:
        out["helpUri"] = r.references[0]
    return out | ({"properties": {"tags": list(r.tags)}} if r.tags else {})


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(result): a JSON object a finding; lines below 1 become 1, endLine only after startLine, nulls left out."""
    line = F.greatest(F.col("start_line"), F.lit(1))
    region = F.struct(line.alias("startLine"), F.when(F.col("end_line") > line, F.col("end_line")).alias("endLine"))
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    res = F.struct(F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(where).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    return findings.join(F.broadcast(rules.select("rule_id", "rule_index")), "rule_id").select(*ORDER, F.to_json(res, {"ignoreNullFields": "true"}).alias("result"))


def sarif(findings: DataFrame) -> str:
    """The whole document, for reports that fit the driver; sarif_results() writes larger ones."""
    rules = sarif_rules(findings)
    meta = [_sarif_rule(r) for r in rules.orderBy("rule_index").collect()]  # a row a rule
    results = [json.loads(r.result) for r in sarif_results(findings, rules).orderBy(*ORDER).toLocalIterator()]
    run = {"results": results, "tool": {"driver": {"rules": meta, "name": "argosec"}}}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"} | {"runs": [run]})


def _numbers(findings: DataFrame) -> dict:
    out: dict = {}
    for r in stats(findings).collect():  # a row a kind, severity, language and category
        out.setdefault(f"by_{r.dimension}", {})[r.value] = r.n
    return out


def json_pieces(findings: DataFrame, group_by: str | None = None, extra: dict | None = None):
    """The JSON document piece by piece; rows come a partition at a time, so neither the driver nor a task holds all of them."""
    head = json.dumps({"stats": _numbers(findings), **(extra or {})})[:-1]
    if not group_by:
        yield head + ', "findings": ['
        for i, r in enumerate(findings.orderBy(*ORDER).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            yield (", " if i else "") + r.j
        yield "]}"
        return
    yield head + ', "groups": ['
    last: tuple | None = None
    for r in grouped(findings, group_by).select("key", F.to_json(F.struct(*findings.columns)).alias("j")).toLocalIterator():
        if last != (r.key,):
            yield ("]}, " if last else "") + f'{{"key": {json.dumps(r.key)}, "findings": [' + r.j
        else:
            yield ", " + r.j
        last = (r.key,)
    yield ("]}" if last else "") + "]}"


def json_report(findings: DataFrame, group_by: str | None = None, extra: dict | None = None) -> str:
    return "".join(json_pieces(findings, group_by, extra))


def write_json(findings: DataFrame, path: str) -> None:
    """A JSON object a line, written by the executors."""
    findings.write.mode("overwrite").json(path)


def html_pieces(findings: DataFrame, group_by: str | None = None, generated: datetime | None = None):
    """The page piece by piece, in one pass over the grouped rows."""
    e = lambda x: _html.escape(str(x if x is not None else ""))
    when = (generated or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S UTC")
    total = findings.count()
    yield f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Scan report</title></head><body><h1>{total} findings</h1><p>Generated {e(when)}</p>"
    last: tuple | None = None
    for r in grouped(findings, group_by or "severity").select("key", "n", "rule_id", "severity", "file", "start_line", "message").toLocalIterator():
        if last != (r.key,):
            yield ("</table>" if last else "") + f"<h2>{e(r.key)} ({r.n})</h2><table>"
        yield f"<tr><td>{e(r.severity)}</td><td>{e(r.rule_id)}</td><td>{e(r.file)}:{r.start_line}</td><td>{e(r.message)}</td></tr>"
        last = (r.key,)
    yield ("</table>" if last else "") + "</body></html>"


def html_report(findings: DataFrame, group_by: str | None = None, generated: datetime | None = None) -> str:
    return "".join(html_pieces(findings, group_by, generated))


def accuracy_markdown(summary: dict, by_language: list[dict], by_rule: list[dict]) -> str:
    out = ["# Accuracy", "", f"TP {summary['tp']}, FP {summary['fp']}, FN {summary['fn']}, precision {summary['precision']:.2%}, recall {summary['recall']:.2%}", ""]
    for title, rows, key in (("Language", by_language, "language"), ("Rule", by_rule, "rule_id")):
        out += [f"| {title} | TP | FP | FN |", "|---|" + "---|" * 3, *(f"| {r[key]} | {r['tp']} | {r['fp']} | {r['fn']} |" for r in rows), ""]
    return "\n".join(out)


def exit_code(n_findings: int, upload_failed: bool = False) -> int:
    return 2 if upload_failed else int(n_findings > 0)

"""Rule catalogue: shipped rows, user YAML, validation, index classes and the rule-set hash."""

from __future__ import annotations

import hashlib
import json
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.sources.rule_texts import complete

KINDS = ("module", "function_def", "class_def", "call", "assignment", "import", "literal", "identifier", "block", "return", "if", "for", "while", "try", "attribute", "binary_op", "assert_statement")
LANGUAGES = ("python", "javascript", "typescript", "go", "java", "csharp", "php", "html")
_KWARG = "struct<name:string,name_pattern:string,value_pattern:string>"
_FILTER = f"argument_count:int,has_attribute:string,tainted_argument:boolean,tainted_rhs:boolean,kwarg:{_KWARG},argument_identifier_matches:string,argument_literal_matches:string,has_bare_except:boolean,has_empty_except_handler:boolean"
NESTING = 2  # negations within negations


def filter_type(nesting: int = NESTING) -> str:
    """A filter; its negated pattern is a pattern again, without a callee, down to the given nesting."""
    inner = f",not:struct<kind:string,identifier:string,literal:string,lhs_identifier:string,rhs_literal:string,filters:array<{filter_type(nesting - 1)}>>" if nesting else ""
    return f"struct<{_FILTER}{inner}>"


RULE_SCHEMA = (
    "id string, name string, version string, language string, category string, severity string, confidence string, lifecycle string, message string, "
    "description string, rationale string, fix_suggestion string, tags array<string>, cwe array<string>, owasp array<string>, references array<string>, "
    "kind string, callee string, suffix boolean, identifier string, literal string, lhs_identifier string, rhs_literal string, "
    f"filters array<{filter_type()}>"
)
_FIELDS = {x.split(":")[0] for x in _FILTER.replace(_KWARG, "kwarg").split(",")} | {"not"}
_INNER = {"kind", "callee", "callee_suffix", "identifier", "literal", "lhs_identifier", "rhs_literal", "filters"}


CATALOGUE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "rules.jsonl")


class RuleError(ValueError):
    """A rule set that does not load as a whole."""


def _filters(rule_id, filters, nesting: int = NESTING) -> list[dict] | None:
    """Filters as rows. Nothing that is written is passed over: what a row cannot hold is an error."""
    out = []
    for f in filters or []:
        f = {k: v for k, v in f.items() if v is not None}
        if set(f) - _FIELDS:
            raise RuleError(f"{rule_id}: unknown filter {', '.join(sorted(set(f) - _FIELDS))}")
        if "not" in f:
            inner = f["not"]
            if not nesting:
                raise RuleError(f"{rule_id}: negations nested too deep")
            if not isinstance(inner, dict) or not inner.get("kind") or set(inner) - _INNER:
                raise RuleError(f"{rule_id}: a negated pattern needs a kind and takes {', '.join(sorted(_INNER - {'kind'}))}")
            # as in a pattern below the index, a callee says nothing here: the node is the same one
            f["not"] = {k: v for k, v in inner.items() if k not in ("callee", "callee_suffix", "filters")} | {"filters": _filters(rule_id, inner.get("filters"), nesting - 1)}
        out.append(f)
    return out or None


def _flat(rule: dict) -> dict:
    """A rule as a row; a user's YAML holds what is matched in a mapping `match`."""
    r = dict(rule)
    r |= r.pop("match", None) or {}
    r["suffix"] = bool(r.pop("callee_suffix", r.get("suffix", False)))
    r["filters"] = _filters(r.get("id"), r.get("filters"))
    r.setdefault("message", r.get("name"))
    r.setdefault("lifecycle", "released")
    return r


def validate(rule: dict) -> list[str]:
    """What is wrong with a flat rule."""
    bad = [f"missing {k}" for k in ("id", "name", "language", "kind") if not rule.get(k)]
    if rule.get("kind") and rule["kind"] not in KINDS:
        bad.append(f"unknown kind {rule['kind']}")
    if rule.get("kind") == "call" and not rule.get("callee") and not rule.get("filters"):
        bad.append("a call rule needs a callee or filters")
    if rule.get("suffix") and "." not in (rule.get("callee") or ""):
        bad.append("a suffix callee needs a dot")
    for k, among in (("language", LANGUAGES), ("severity", ("critical", "high", "medium", "low", "info")), ("confidence", ("high", "medium", "low"))):
        if rule.get(k) and rule[k] not in among:
            bad.append(f"unknown {k} {rule[k]}")
    return bad


def shipped() -> list[dict]:
    with open(CATALOGUE, encoding="utf-8") as f:
        return [_flat(complete(json.loads(line))) for line in f]


def read_yaml(folder: str) -> list[dict]:
    """Rules of the *.yaml files of a folder, not of folders below it."""
    import yaml

    return [_flat(yaml.safe_load(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.yaml"))]


def load_rules(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """The catalogue (or a user's folder) as a table; one bad rule fails the whole load."""
    rules = read_yaml(folder) if folder else shipped()
    errors = [f"{r.get('id')}: {e}" for r in rules for e in validate(r)]
    if len({r.get("id") for r in rules}) < len(rules):
        errors.append("rule ids repeat")
    if errors:
        raise RuleError("; ".join(errors))
    # null fields are left out and read as null
    text = [json.dumps({k: v for k, v in r.items() if v is not None}) for r in rules]
    return spark.createDataFrame([(x,) for x in text], "j string").select(F.from_json("j", RULE_SCHEMA).alias("r")).select("r.*")


def with_index(rules: DataFrame) -> DataFrame:
    """idx_class (suffix, callee or kind) and callee_last: each rule is in one class."""
    call = (F.col("kind") == "call") & (F.coalesce("callee", F.lit("")) != "")
    cls = F.when(call & F.col("suffix") & F.col("callee").contains("."), "suffix").when(call, "callee").otherwise("kind")
    return rules.withColumn("idx_class", cls).withColumn("callee_last", F.regexp_extract(F.coalesce("callee", F.lit("")), r"([^.]*)\z", 1))


def by_language(rules: DataFrame, language: str) -> DataFrame:
    return rules.where(F.col("language") == language)


def by_category(rules: DataFrame, category: str) -> DataFrame:
    return rules.where(F.col("category") == category)


def by_tag(rules: DataFrame, tag: str) -> DataFrame:
    return rules.where(F.array_contains("tags", tag))


def rule_set_hash(files: DataFrame) -> DataFrame:
    """(hash) over files (path, content): sha256 of the sorted lines `path|sha256 of the content`, line ends unified."""
    line = F.concat("path", F.lit("|"), F.sha2(F.replace(F.col("content").cast("string"), F.lit("\r\n"), F.lit("\n")), 256), F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("path", line.alias("line"))))
    return files.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), ""), 256).alias("hash"))


def local_hash(folder: str) -> str:
    lines = sorted((p.name, hashlib.sha256(re.sub(b"\r\n", b"\n", p.read_bytes())).hexdigest()) for p in Path(folder).glob("*.yaml"))
    return hashlib.sha256("".join(f"{a}|{b}\n" for a, b in lines).encode()).hexdigest()

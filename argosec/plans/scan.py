"""The whole scan as one plan: files -> findings of all modalities -> dedup -> suppression -> chains."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.operators import findings as fd
from argosec.operators.config_checks import config_findings
from argosec.operators.dependencies import vulnerable
from argosec.operators.incremental import State, refresh
from argosec.operators.matching import match
from argosec.operators.secrets import secrets
from argosec.operators.symbols import symbols
from argosec.operators.taint import taint
from argosec.parsers.facts import ir_facts
from argosec.parsers.front import ir_nodes
from argosec.sources.lockfiles import dependencies
from argosec.sources.rules import load_rules, local_hash
from argosec.storage import spread, stash


@dataclass
class Options:
    languages: tuple[str, ...] = ()
    rules: str | None = None
    secrets: bool = False
    sca: bool = False
    config: bool = False
    graphs: bool = False
    compat_dedup: bool = False
    allow: list[dict] = field(default_factory=list)


def sast(files: DataFrame, rules: DataFrame, graphs: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Syntax findings.

    Files are parsed in one stage that also works out taint, symbols and snippets of each file, and matched in the same one by a broadcast join; nothing
    is shuffled. Stored syntax rows (nodes) are joined with their facts instead.
    """
    if nodes is None:
        kinds = tuple(r["kind"] for r in rules.select("kind").distinct().collect())  # of KINDS
        return fd.sast_findings(match(ir_facts(files, kinds, graphs), rules))
    t = stash(taint(nodes, graphs), "taint")
    return fd.sast_findings(match(nodes, rules, t), files, symbols(nodes), t)


ENGINE, IR_SCHEMA = "1", "1"


def meta(options: Options) -> dict:
    """What stored findings and syntax rows depend on besides the files."""
    rules = local_hash(options.rules) if options.rules else "shipped"
    return {"format": "1", "engine": ENGINE, "rules": rules, "options": f"graphs={options.graphs}", "ir_schema": IR_SCHEMA}


def incremental_sast(files: DataFrame, rules: DataFrame, options: Options, state: State) -> DataFrame:
    """Syntax findings where only files whose content changed are matched, and only new content is parsed.

    Any failure of the state, when it is planned or read, leads to a full scan.
    """
    m = meta(options)
    try:
        old_nodes, old = state.table("nodes", m), state.table("findings", m)
        known = files.select("path", "content_sha256")
        nodes = stash(refresh(files, old_nodes, lambda f: ir_nodes(f).withColumn("page", F.col("path")).withColumn("path", F.regexp_replace("path", r"#script\d+\z", ""))), "nodes")
        rows = nodes.drop("content_sha256").withColumn("path", F.col("page")).drop("page")

        def compute(todo: DataFrame) -> DataFrame:
            own = rows.withColumn("of", F.regexp_replace("path", r"#script\d+\z", "")).join(todo.select(F.col("path").alias("of")), "of", "left_semi").drop("of")
            return sast(todo, rules, options.graphs, own).withColumn("path", F.col("file"))

        found = stash(refresh(files, old, compute), "findings")
        # files without findings are kept too, as rows without a rule, so that they count as seen
        seen = known.join(found.select("path").distinct(), "path", "left_anti")
        state.replace({"nodes": nodes, "findings": found.unionByName(seen, allowMissingColumns=True)}, m)
        return found.where("rule_id is not null").drop("path", "content_sha256")
    except (OSError, PySparkException, Py4JError) as e:
        warnings.warn(f"the state cannot be used, every file is scanned: {str(e)[:200]}", stacklevel=2)
        return sast(files, rules, options.graphs)


@dataclass
class Inputs:
    files: DataFrame
    advisories: DataFrame | None = None
    vulnerable_deps: DataFrame | None = None


def _secrets(i: Inputs) -> DataFrame:
    return fd.secret_findings(secrets(i.files))


def _config(i: Inputs) -> DataFrame:
    return fd.config_findings(config_findings(i.files.where("not is_binary")))


def _dependencies(i: Inputs) -> DataFrame | None:
    if i.vulnerable_deps is not None:
        return fd.dependency_findings(i.vulnerable_deps)
    return None if i.advisories is None else fd.dependency_findings(vulnerable(dependencies(i.files), i.advisories))


# what runs beside the syntax rules: (whether the options want it, Inputs -> findings or None)
SCANNERS: list[tuple[Callable[[Options], bool], Callable[[Inputs], DataFrame | None]]] = [(lambda o: o.secrets, _secrets), (lambda o: o.config, _config), (lambda o: o.sca, _dependencies)]


def register(wanted: Callable[[Options], bool], scanner: Callable[[Inputs], DataFrame | None]) -> None:
    """Add a scanner of one's own; its rows are made of the columns of findings.FINDING, missing ones are null."""
    SCANNERS.append((wanted, scanner))


def scan(spark: SparkSession, files: DataFrame, options: Options | None = None, advisories: DataFrame | None = None, nodes: DataFrame | None = None, state: State | None = None, vulnerable_deps: DataFrame | None = None) -> DataFrame:
    o = options or Options()
    scanners = [scanner for wanted, scanner in SCANNERS if wanted(o)]
    if scanners:  # each reads all files, some of them several times over; so they are read or worked out once
        files = stash(spread(files), "files")
    code = (files.where(F.col("language").isin(*o.languages)) if o.languages else files).where("not is_binary")
    rules = load_rules(spark, o.rules)
    parts = [incremental_sast(code, rules, o, state) if state is not None else sast(code, rules, o.graphs, nodes)]
    given = Inputs(files, advisories, vulnerable_deps)
    parts += [found for scanner in scanners if (found := scanner(given)) is not None]
    out = fd.dedup(fd.union(*parts), o.compat_dedup)
    if o.allow:
        out, _ = fd.suppressed(out, fd.allowlist(spark, o.allow))
    return fd.correlate(out)

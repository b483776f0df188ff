"""The rule matcher: one broadcast equi-join of nodes with rules by key, then the filters as array predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argosec.operators.taint import patterns
from argosec.sources.rules import NESTING, with_index

_ARGS = "array<struct<kind:string,text:string,source:string,kwarg_name:string,kwarg_value:string>>"


def candidates(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Node and rule side by side (columns of nodes, and rule): by callee, by last segment of the callee, by kind.

    A node has a key for each of the three classes of rules, a rule has one; one pass over the nodes and one broadcast equi-join (a few hundred rules).
    """
    key = F.concat_ws("\0", F.substring("idx_class", 1, 1), F.when(F.col("idx_class") == "callee", F.col("callee")).when(F.col("idx_class") == "suffix", F.col("callee_last")).otherwise(F.col("kind")))
    r = with_index(rules).select(F.col("language").alias("r_lang"), key.alias("r_key"), F.col("idx_class").alias("r_class"), F.col("callee").alias("r_callee"), F.struct(*rules.columns).alias("rule"))
    # as rows of a generator, the columns are no aliases of one JSON text: from those the optimizer infers constraints without end where nodes have literal columns
    r = r.select(F.inline(F.array(F.struct(*r.columns))))
    call = F.col("kind") == "call"
    keys = F.array(F.concat(F.lit("k\0"), "kind"), F.when(call, F.concat(F.lit("c\0"), "callee_text")), F.when(call, F.concat(F.lit("s\0"), "callee_last")))
    x = nodes.withColumn("n_key", F.explode(F.array_compact(keys)))
    x = x.join(F.broadcast(r), (F.col("language") == F.col("r_lang")) & (F.col("n_key") == F.col("r_key")))
    tail = (F.col("callee_text") == F.col("r_callee")) | F.endswith(F.col("callee_text"), F.concat(F.lit("."), F.col("r_callee")))
    return x.where((F.col("r_class") != "suffix") | tail).select(*nodes.columns, "rule")


def _rlike(text: Column, rx: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), rx)


def _kwarg(args: Column, k: Column) -> Column:
    def one(a: Column) -> Column:
        named = (k["name"].isNull() | (k["name"] == "") | (a["kwarg_name"] == k["name"])) & _rlike(a["kwarg_name"], F.coalesce(k["name_pattern"], F.lit("")))
        return (a["kind"] == "keyword_argument") & named & _rlike(a["kwarg_value"], F.coalesce(k["value_pattern"], F.lit("")))

    return F.exists(args, one)


def _tainted(args: Column) -> Column:
    return F.exists(args, lambda a: (a["kind"] == "identifier") & F.array_contains(F.col("tainted_vars"), a["text"])) | F.exists(args, lambda a: a["source"].isNotNull() & F.rlike(a["source"], F.col("source_rx")))


def _pattern_holds(p: Column) -> Column:
    """What a pattern asks of a node besides its kind, callee and filters."""
    unset = lambda x: F.coalesce(x, F.lit("")) == ""
    tests = [unset(p["identifier"]) | (F.col("text") == p["identifier"])]
    tests += [unset(p[field]) | _rlike(F.col(on), p[field]) for field, on in (("literal", "text"), ("lhs_identifier", "lhs"), ("rhs_literal", "rhs"))]
    return reduce(Column.__and__, tests)


def filter_holds(f: Column, nesting: int = NESTING) -> Column:
    """All that is set within one filter must hold; a negated pattern must not hold for the same node."""
    args = F.coalesce(F.col("args"), F.array().cast(_ARGS))
    call = F.col("kind") == "call"
    handlers = F.coalesce(F.col("except_handlers"), F.array().cast("array<struct<is_bare:boolean,types:array<string>,is_empty_body:boolean>>"))

    def when(is_set: Column, holds: Column) -> Column:
        return ~F.coalesce(is_set, F.lit(False)) | F.coalesce(holds, F.lit(False))

    def text(field: str, kind: str) -> Column:
        return when(F.coalesce(f[field], F.lit("")) != "", call & F.exists(args, lambda a: (a["kind"] == kind) & F.rlike(a["text"], f[field])))

    tests = [
        when(f["argument_count"].isNotNull(), F.coalesce(F.col("argument_count"), F.lit(0)) == f["argument_count"]),
        when(F.coalesce(f["has_attribute"], F.lit("")) != "", F.exists(F.coalesce("attribute_texts", F.array().cast("array<string>")), lambda t: F.contains(t, f["has_attribute"]))),
        when(f["kwarg"].isNotNull(), call & _kwarg(args, f["kwarg"])),
        text("argument_identifier_matches", "identifier"),
        text("argument_literal_matches", "literal"),
        when(f["has_bare_except"], F.exists(handlers, lambda h: h["is_bare"])),
        when(f["has_empty_except_handler"], F.exists(handlers, lambda h: h["is_empty_body"])),
        when(f["tainted_argument"], call & _tainted(args)),
        when(f["tainted_rhs"], (F.col("kind") == "assignment") & _tainted(args)),
    ]
    if nesting:
        p = f["not"]
        below = F.forall(F.coalesce(p["filters"], F.array()), lambda g: filter_holds(g, nesting - 1))
        tests.append(when(p.isNotNull(), ~F.coalesce((p["kind"] == F.col("kind")) & _pattern_holds(p) & below, F.lit(False))))
    return reduce(Column.__and__, tests)


def tainted_var() -> Column:
    """The variable (or else the source expression) that a taint filter found first; null for rules without one."""
    args = F.coalesce(F.col("args"), F.array().cast(_ARGS))
    uses = F.exists(F.coalesce(F.col("rule.filters"), F.array()), lambda f: F.coalesce(f["tainted_argument"], F.lit(False)) | F.coalesce(f["tainted_rhs"], F.lit(False)))
    named = F.filter(args, lambda a: (a["kind"] == "identifier") & F.array_contains(F.col("tainted_vars"), a["text"]))
    direct = F.filter(args, lambda a: a["source"].isNotNull() & F.rlike(a["source"], F.col("source_rx")))
    return F.when(uses, F.coalesce(F.try_element_at(named, F.lit(1))["text"], F.regexp_replace(F.try_element_at(direct, F.lit(1))["source"], r"\(\z", "")))


def match(nodes: DataFrame, rules: DataFrame, taint: DataFrame | None = None) -> DataFrame:
    """Rows of nodes with rule (a struct), tainted_vars and tainted_var, one for each rule that a node satisfies.

    Tainted variables come with the nodes (column taints) or from a table of them.
    """
    spark = nodes.sparkSession
    c = candidates(nodes, rules)
    r = F.col("rule")
    c = c.where(_pattern_holds(r))
    if "taints" in nodes.columns:
        c = c.withColumn("tainted_vars", F.coalesce(F.transform("taints", lambda t: t["var"]), F.array().cast("array<string>")))
    elif taint is None:
        c = c.withColumn("tainted_vars", F.array().cast("array<string>"))
    else:
        held = taint.where("tainted").groupBy("path").agg(F.collect_set("var").alias("tainted_vars"))
        c = c.join(held, "path", "left").withColumn("tainted_vars", F.coalesce("tainted_vars", F.array().cast("array<string>")))
    c = c.join(F.broadcast(patterns(spark).select("language", F.when(F.col("source_rx") == "", F.lit(r"(?!)")).otherwise(F.col("source_rx")).alias("source_rx"))), "language", "left")
    c = c.where(F.forall(F.coalesce(r["filters"], F.array()), lambda f: filter_holds(f)))
    return c.withColumn("tainted_var", tainted_var()).drop("source_rx")

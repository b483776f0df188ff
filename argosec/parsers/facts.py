"""Syntax rows with what a rule match needs from the rest of their file: taint, enclosing symbol, snippet.

All of it follows from one file, and a file fits a task, so it is worked out in the stage that parses: no row is shuffled for it.
The same facts for stored syntax rows are joins (operators/taint.py, operators/symbols.py).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from argosec.operators.taint import TEXTS, fold_file, sanitizer_regex, source_regex
from argosec.parsers.front import PARSERS, parse_source
from argosec.parsers.tree import COLUMNS, NODE_SCHEMA
from argosec.storage import spread

FACT_SCHEMA = NODE_SCHEMA + ", symbol string, snippet string, taints array<struct<var:string,reason:string,path_locs:array<struct<line:int,col:int>>>>"
FACTS = [*COLUMNS, "symbol", "snippet", "taints"]
_AT = {c: i for i, c in enumerate(COLUMNS)}
_PATTERNS = {k: (source_regex(k), sanitizer_regex(k)) for k in TEXTS}


def _summaries(rows: list[tuple], language: str) -> dict[str, tuple[bool, bool]]:
    """Functions by name: whether a return of their own is a source, and whether one gives back a parameter."""
    kind, ix, end, name, ret, par = (_AT[c] for c in ("kind", "ix", "end_ix", "function_name", "return_expr", "parameters"))
    src = _PATTERNS.get(language, ("", ""))[0]
    own: dict[int, list[str]] = {}
    open_: list[tuple] = []
    out: dict[str, tuple[bool, bool]] = {}
    named = []
    for r in rows:  # pre-order: the innermost function around a row is the last one still open
        while open_ and open_[-1][end] < r[ix]:
            open_.pop()
        if r[kind] == "return" and r[ret] and open_:
            own.setdefault(open_[-1][ix], []).append(r[ret])
        if r[kind] == "function_def":
            open_.append(r)
            if r[name]:
                named.append(r)
    for r in named:  # the later of two functions of a name counts
        told = own.get(r[ix], [])
        out[r[name]] = (bool(src) and any(re.search(src, t) for t in told), any(t in (r[par] or []) for t in told))
    return out


def _names(args) -> list[str]:
    return [a[1] for a in args or [] if a[0] == "identifier"]


def file_taints(rows: list[tuple], path: str, language: str, graphs: bool) -> list[tuple]:
    """(var, reason, path_locs) of the variables of a file that are tainted at its end."""
    kind, ix, parent, pos, text = (_AT[c] for c in ("kind", "ix", "parent_ix", "child_pos", "text"))
    plain = {r[parent] for r in rows if r[kind] == "identifier" and r[pos] == 0}
    calls: dict[int, list[tuple]] = {}
    for r in rows:
        if r[kind] == "call" and r[pos] > 0 and r[ix] in plain:
            calls.setdefault(r[parent], []).append(r)
    recs = []
    for r in rows:
        if r[kind] == "assignment" and r[_AT["lhs"]]:
            for c in calls.get(r[ix], [None]):
                recs.append({"ix": r[ix], "lhs": r[_AT["lhs"]], "rhs": r[_AT["rhs"]] or "", "augmented": r[_AT["augmented"]], "names": _names(r[_AT["args"]]), "call": c[_AT["callee_text"]] if c else None, "call_names": _names(c[_AT["args"]]) if c else [], "line": r[_AT["start_line"]], "col": r[_AT["start_col"]]})
    if not recs:
        return []
    reaches = None
    if graphs and language == "python":
        from argosec.operators.graph import reaching_definitions

        ins = reaching_definitions([{c: r[_AT[c]] for c in ("ix", "parent_ix", "end_ix", "kind", "lhs")} for r in rows])
        reaches = lambda i, n: bool(ins.get(i, {}).get(n))
    out = fold_file(recs, *_PATTERNS.get(language, ("", "")), _summaries(rows, language), reaches)
    return [(o["var"], o["reason"], o["path_locs"]) for o in out if o["tainted"]]


def with_facts(rows: list[tuple], lines: list[str], kinds: frozenset, graphs: bool) -> list[tuple]:
    """Rows of the wanted kinds of one parsed unit (a file, or a script of a page), with their facts. lines: of the file or page."""
    path, language = rows[0][_AT["path"]], rows[0][_AT["language"]]
    start, end, name, text, args = (_AT[c] for c in ("start_line", "end_line", "function_name", "text", "args"))
    around = [(r[start], r[end], r[name]) for r in rows if r[_AT["kind"]] in ("function_def", "class_def") and r[name]]
    taints, symbol = file_taints(rows, path, language, graphs), {}
    out = []
    for r in rows:
        if r[_AT["kind"]] not in kinds:
            continue
        at = r[start]
        if at not in symbol:
            symbol[at] = next((n for a, z, n in around if a <= at <= z), "")
        snippet = r[text] or ("\n".join(lines[at - 1 : max(r[end], at)]) if 1 <= at <= len(lines) else "")
        out.append((*r, symbol[at], snippet, taints if r[args] is not None else None))
    return out


def _facts(kinds: frozenset, graphs: bool, schema: pa.Schema):
    def run(batches):
        out: list[tuple] = []
        for b in batches:
            for path, language, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows, lines = parse_source(path, language, content), content.split("\n")
                cut = [i for i, r in enumerate(rows) if r[_AT["ix"]] == 0] + [len(rows)]
                for a, z in zip(cut, cut[1:]):
                    out += with_facts(rows[a:z], lines, kinds, graphs)
                if len(out) > 5000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def ir_facts(files: DataFrame, kinds: tuple[str, ...], graphs: bool = False) -> DataFrame:
    """Syntax rows of the given kinds with their facts, of files (path, language, content); other languages and null contents give none."""
    use = files.where(F.col("language").isin(*PARSERS) & F.col("content").isNotNull())
    schema = to_arrow_schema(StructType.fromDDL(FACT_SCHEMA))
    return spread(use.select("path", "language", F.col("content").cast("string").alias("content"))).mapInArrow(_facts(frozenset(kinds), graphs, schema), FACT_SCHEMA)

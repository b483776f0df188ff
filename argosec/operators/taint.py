"""Taint: language patterns, function summaries and the fold over a file's assignments."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# what follows a name is given as a list; each joins to one alternative
_JS = (["location.search", "location.hash", "req.body", "req.params", "req.query", "window.location"], ["encodeURIComponent(", "DOMPurify.sanitize("])
_PY = (
    [f"request.{x}" for x in ("GET", "POST", "args", "form", "headers", "values")] + ["os.environ.get", "sys.argv"],
    ["html.escape(", "shlex.quote(", "bleach.clean("],
)
TEXTS: dict[str, tuple[list[str], list[str]]] = {
    "python": _PY,
    "javascript": _JS,
    "typescript": _JS,
    "csharp": ([f"Request.{x}" for x in ("Cookies", "Form", "Params", "QueryString")] + ["Console.ReadLine(", "Request["], ["Encoder.Default.Encode(", "HttpUtility.HtmlEncode(", "WebUtility.HtmlEncode("]),
    "go": (["os.Getenv(", "os.Args", ".PostFormValue(", ".FormValue(", ".URL.Query()"], ["template.HTMLEscapeString(", "html.EscapeString("]),
    "php": ([], ["escapeshellarg(", "htmlentities(", "htmlspecialchars("]),
    "java": (["System.getenv(", "request.getHeader(", "request.getParameter("], ["Encode.forHtml(", "StringEscapeUtils.escapeHtml4("]),
    "html": (_PY[0] + _JS[0], _PY[1] + _JS[1]),
}
_MORE = {"python": [r"(?:\A|\W)input\("], "html": [r"(?:\A|\W)input\("], "php": [rf"\$_(?:{'|'.join(('COOKIE', 'GET', 'POST', 'REQUEST', 'SERVER', 'SESSION'))})\b"]}


def source_regex(language: str) -> str:
    return "|".join([re.sub(r"([.()\[\]$])", r"\\\1", t) for t in TEXTS[language][0]] + _MORE.get(language, []))


def sanitizer_regex(language: str) -> str:
    return "|".join(re.sub(r"([.()\[\]$])", r"\\\1", t) for t in TEXTS[language][1])


def patterns(spark: SparkSession) -> DataFrame:
    """(language, source_rx, sanitizer_rx): a row a language, to be broadcast."""
    return spark.createDataFrame([(k, source_regex(k), sanitizer_regex(k)) for k in TEXTS], "language string, source_rx string, sanitizer_rx string")


def function_summaries(nodes: DataFrame) -> DataFrame:
    """(path, fn, always, pass): what a function's own returns (not those of functions inside it) say; the later of two functions of a name counts."""
    fn = nodes.where("kind = 'function_def' and function_name <> ''").select("path", "language", "ix", "end_ix", F.col("function_name").alias("fn"), "parameters")
    ret = nodes.where("kind = 'return' and return_expr <> ''").select(F.col("path").alias("p"), F.col("ix").alias("r_ix"), "return_expr")
    every = nodes.where("kind = 'function_def'").select(F.col("path").alias("p"), F.col("ix").alias("f_ix"), F.col("end_ix").alias("f_end"))
    # a return belongs to the innermost function around it: the one that begins last
    own = ret.join(every, "p").where("r_ix > f_ix and r_ix <= f_end").groupBy("p", "r_ix", "return_expr").agg(F.max("f_ix").alias("f_ix"))
    x = fn.join(own, (F.col("path") == F.col("p")) & (F.col("ix") == F.col("f_ix")), "left").join(F.broadcast(patterns(nodes.sparkSession)), "language", "left")
    always = F.coalesce(F.max(F.expr("return_expr rlike source_rx")), F.lit(False))
    passes = F.coalesce(F.max(F.array_contains(F.coalesce("parameters", F.array().cast("array<string>")), F.col("return_expr"))), F.lit(False))
    one = x.groupBy("path", "fn", "ix").agg(always.alias("always"), passes.alias("pass"))
    return one.groupBy("path", "fn").agg(F.max_by(F.struct("always", "pass"), "ix").alias("s")).select("path", "fn", "s.always", "s.pass")


def fold_file(rows: list[dict], source_rx: str, sanitizer_rx: str, summaries: dict[str, tuple[bool, bool]], reaches=None) -> list[dict]:
    """Verdict of each assignment in source order. rows: ix, lhs, rhs, augmented, names, call, call_names, line, col.

    reaches(ix, name): whether a definition of name reaches the assignment; None gives no paths.
    """
    tainted: dict[str, bool] = {}
    reason: dict[str, str] = {}
    paths: dict[str, list] = {}
    out = []
    src = re.compile(source_rx) if source_rx else None
    san = re.compile(sanitizer_rx) if sanitizer_rx else None
    for r in rows:
        lhs, rhs = r["lhs"], r["rhs"] or ""
        verdict, why, ref = False, None, None
        if not (san and san.search(rhs)):
            if src and src.search(rhs):
                verdict, why = True, rhs
            else:
                ref = next((n for n in r["names"] if tainted.get(n)), None)
                if ref:
                    verdict, why = True, f"propagated from {ref}"
                elif r["call"] in summaries:
                    always, passes = summaries[r["call"]]
                    if always or passes and any(tainted.get(n) for n in r["call_names"]):
                        verdict, why = True, f"tainted via {r['call']}(...)"
        if r["augmented"] and not verdict and tainted.get(lhs):
            verdict, why, ref = True, reason.get(lhs), lhs
        tainted[lhs] = verdict
        if verdict:
            reason[lhs] = why
            here = (r["line"], r["col"])
            if reaches is not None and ref and not reaches(r["ix"], ref):
                paths.pop(lhs, None)
            elif reaches is not None:
                paths[lhs] = [*(paths.get(ref, []) if ref else []), here]
        else:
            reason.pop(lhs, None)
            paths.pop(lhs, None)
        out.append({"ix": r["ix"], "var": lhs, "tainted": verdict, "reason": why})
    last = {}
    for o in out:
        last[o["var"]] = o | {"path_locs": paths.get(o["var"])}
    return list(last.values())


_OUT = "path string, language string, var string, tainted boolean, reason string, path_locs array<struct<line:int,col:int>>"


def _fold(patterns_: dict, graphs: bool):
    """Input is sorted by path and language; a file may span batches, and a batch holds many files."""
    from argosec.operators.graph import reaching_definitions

    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.struct([("line", pa.int32()), ("col", pa.int32())])))
    names = [c.split()[0] for c in _OUT.split(", ", 5)]

    def verdicts(path: str, language: str, rows: list[dict]) -> list[tuple]:
        recs = [r | {"names": r["names"] or [], "call_names": r["call_names"] or []} for r in rows if r["row"] == "assign"]
        sums = {r["lhs"]: (bool(r["always"]), bool(r["pass"])) for r in rows if r["row"] == "summary"}
        reaches = None
        if graphs and language == "python":
            ins = reaching_definitions([r for r in rows if r["row"] == "node"])
            reaches = lambda ix, name: bool(ins.get(ix, {}).get(name))
        out = fold_file(recs, *patterns_.get(language, ("", "")), sums, reaches)
        return [(path, language, o["var"], o["tainted"], o["reason"], o["path_locs"]) for o in out]

    def run(batches):
        key, held, out = None, [], []
        for b in batches:
            for r in b.to_pylist():
                if (r["path"], r["language"]) != key:
                    out += verdicts(*key, held) if held else []
                    key, held = (r["path"], r["language"]), []
                held.append(r)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        out += verdicts(*key, held) if held else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return run


def taint(nodes: DataFrame, graphs: bool = False) -> DataFrame:
    """(path, language, var, tainted, reason, path_locs): the last verdict of every assigned variable. Sequential in a file, parallel over files.

    Paths are only made for Python and only with graphs.
    """
    args = F.coalesce("args", F.array().cast("array<struct<kind:string,text:string,source:string,kwarg_name:string,kwarg_value:string>>"))
    names = F.transform(F.filter(args, lambda a: a["kind"] == "identifier"), lambda a: a["text"])
    calls = nodes.where("kind = 'call'").select(F.col("path").alias("p"), F.col("parent_ix").alias("a_ix"), F.col("child_pos").alias("c_pos"), F.col("ix").alias("c_ix"), F.col("callee_text").alias("call"), names.alias("call_names"))
    plain = nodes.where("kind = 'identifier' and child_pos = 0").select(F.col("path").alias("q"), F.col("parent_ix").alias("n_ix"))
    calls = calls.join(plain, (F.col("p") == F.col("q")) & (F.col("c_ix") == F.col("n_ix")), "left_semi").where("c_pos > 0")
    a = nodes.where("kind = 'assignment' and lhs <> ''").select("path", "language", "ix", "end_ix", "lhs", "rhs", "augmented", names.alias("names"), F.col("start_line").alias("line"), F.col("start_col").alias("col"))
    a = a.join(calls, (F.col("path") == F.col("p")) & (F.col("ix") == F.col("a_ix")), "left").drop("p", "a_ix", "c_pos", "c_ix").withColumn("row", F.lit("assign"))
    s = function_summaries(nodes).join(nodes.where("ix = 0").select("path", "language"), "path").select("path", "language", F.col("fn").alias("lhs"), "always", "pass", F.lit(0).alias("ix"), F.lit("summary").alias("row"))
    rows = a.unionByName(s, allowMissingColumns=True).withColumn("parent_ix", F.lit(None).cast("int")).withColumn("kind", F.lit(None).cast("string"))
    if graphs:
        n = nodes.where("language = 'python'").select("path", "language", "ix", "parent_ix", "end_ix", "kind", "lhs", F.lit("node").alias("row"))
        rows = rows.unionByName(n, allowMissingColumns=True)
    pats = {k: (source_regex(k), sanitizer_regex(k)) for k in TEXTS}
    return rows.repartition("path", "language").sortWithinPartitions("path", "language", "ix").mapInArrow(_fold(pats, graphs), _OUT)

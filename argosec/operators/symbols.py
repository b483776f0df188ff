"""Scopes and symbols, and the joins that look them up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scopes(nodes: DataFrame) -> DataFrame:
    """(path, scope_ix, type, parent_ix, start_line, end_line): the file, functions and classes. A function in a class looks past it."""
    s = nodes.where("ix = 0 or kind in ('function_def', 'class_def')").select("path", F.col("ix").alias("scope_ix"), "end_ix", F.when(F.col("ix") == 0, "global").when(F.col("kind") == "class_def", "class").otherwise("function").alias("type"), "start_line", "end_line")
    up = s.select("path", F.col("scope_ix").alias("u_ix"), F.col("end_ix").alias("u_end"), F.col("type").alias("u_type"))
    near = s.join(up, "path", "left").where("scope_ix = 0 or (u_ix < scope_ix and u_end >= scope_ix)")
    # the innermost scope around; for a function the innermost that is no class directly around it
    w = Window.partitionBy("path", "scope_ix").orderBy(F.col("u_ix").desc())
    near = near.withColumn("n", F.row_number().over(w)).withColumn("first", F.first("u_type").over(w))
    take = F.when((F.col("type") == "function") & (F.col("first") == "class"), 2).otherwise(1)
    parent = near.where(F.col("n") == take).select("path", "scope_ix", F.when(F.col("scope_ix") > 0, F.col("u_ix")).alias("parent_ix"))
    return s.join(parent, ["path", "scope_ix"], "left").select("path", "scope_ix", "type", "parent_ix", "start_line", "end_line")


def symbols(nodes: DataFrame) -> DataFrame:
    """(path, seq, name, kind, scope_ix, start_line, end_line) in order of definition."""
    own = nodes.where("kind in ('function_def', 'class_def') and function_name <> ''").select("path", "ix", F.lit(0).alias("sub"), F.col("function_name").alias("name"), F.when(F.col("kind") == "class_def", "class").otherwise("function").alias("kind"), "start_line", "end_line", F.lit(False).alias("inside"))
    par = nodes.where("kind = 'function_def'").select("path", "ix", F.posexplode("parameters").alias("p", "name"), "start_line", "end_line").select("path", "ix", (F.col("p") + 1).alias("sub"), "name", F.lit("parameter").alias("kind"), "start_line", "end_line", F.lit(True).alias("inside"))
    child = nodes.where("kind = 'identifier' and text <> ''").select("path", F.col("parent_ix").alias("p_ix"), "ix", "text", "child_pos", "start_line", "end_line")
    up = nodes.where("kind in ('assignment', 'import')").select("path", F.col("ix").alias("p_ix"), F.col("kind").alias("p_kind"))
    var = child.join(up, ["path", "p_ix"]).where("p_kind = 'import' or child_pos = 0").select("path", "ix", F.lit(0).alias("sub"), F.col("text").alias("name"), F.when(F.col("p_kind") == "import", "import").otherwise("variable").alias("kind"), "start_line", "end_line", F.lit(False).alias("inside"))
    every = own.unionByName(par).unionByName(var)
    sc = nodes.where("ix = 0 or kind in ('function_def', 'class_def')").select("path", F.col("ix").alias("s_ix"), F.col("end_ix").alias("s_end"))
    held = every.join(sc, "path").where("(inside and s_ix = ix) or (not inside and (s_ix < ix) and s_end >= ix)")
    held = held.groupBy("path", "ix", "sub", "name", "kind", "start_line", "end_line").agg(F.max("s_ix").alias("scope_ix"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("ix", "sub"))
    return held.select("path", seq.alias("seq"), "name", "kind", "scope_ix", "start_line", "end_line")


def scope_at(lines: DataFrame, scopes_: DataFrame) -> DataFrame:
    """(path, line, scope_ix): the smallest scope around a line, the earliest of equal ones, the file where none is."""
    kind = scopes_.schema["scope_ix"].dataType
    # of scopes over the same lines only the first counts; span and place in one number, so that lines are summed up as they are joined, without a sort
    s = scopes_.groupBy("path", F.col("start_line").alias("a"), F.col("end_line").alias("z")).agg(F.min("scope_ix").cast("long").alias("first"))
    j = lines.join(s, "path", "left")
    span = F.when((F.col("line") >= F.col("a")) & (F.col("line") <= F.col("z")), F.shiftleft((F.col("z") - F.col("a")).cast("long"), 32) + F.col("first"))
    return j.groupBy("path", "line").agg(F.coalesce(F.min(span).bitwiseAND(F.lit((1 << 32) - 1)), F.lit(0)).cast(kind).alias("scope_ix"))


class _Scopes:
    """The scopes of a file: ids in order (those that are only named as parents, too), whether they are rows, and the place of each one's parent, or -1."""

    def __init__(self, scope: pa.ChunkedArray, parent: pa.ChunkedArray):
        own, held = scope.to_numpy(), parent.is_valid().to_numpy()
        up = parent.fill_null(0).to_numpy()
        self.ids = np.unique(np.concatenate([own, up[held]]))
        self.is_row, self.up = np.zeros(len(self.ids), bool), np.full(len(self.ids), -1, np.int64)
        self.is_row[self.find(own)] = True
        self.up[self.find(own[held])] = self.find(up[held])

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id, or -1."""
        if not len(self.ids):
            return np.full(len(ids), -1, np.int64)
        i = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[i] == ids, i, -1)


def _chains(t: pa.Table) -> pa.Table:
    s = _Scopes(t["scope_ix"], t["parent_ix"])
    first = at = np.flatnonzero(s.is_row)
    out, distance = [], 0
    while len(at) and distance <= len(s.ids):  # no chain is longer, unless scopes lie in themselves
        out.append((s.ids[first], s.ids[at], np.full(len(at), distance)))
        distance += 1
        more = s.up[at] >= 0
        first, at = first[more], s.up[at[more]]
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    path = pa.repeat(t["path"][0], len(cols[0]))
    return pa.table([path, *map(pa.array, cols)], ["path", "scope_ix", "up_ix", "distance"])


def scope_chains(scopes_: DataFrame) -> DataFrame:
    """(path, scope_ix, up_ix, distance): each scope and those around it, worked out file by file."""
    kind = scopes_.schema["scope_ix"].dataType
    s = scopes_.where("path is not null and scope_ix is not null").select("path", F.col("scope_ix").cast("long").alias("scope_ix"), F.col("parent_ix").cast("long").alias("parent_ix"))
    c = s.groupBy("path").applyInArrow(_chains, "path string, scope_ix long, up_ix long, distance long")
    return c.select("path", F.col("scope_ix").cast(kind).alias("scope_ix"), F.col("up_ix").cast(kind).alias("up_ix"), F.col("distance").cast("int").alias("distance"))


def _resolve(t: pa.Table) -> pa.Table:
    names, scopes_, syms = (t.filter(pc.equal(t["what"], k)) for k in range(3))
    s = _Scopes(scopes_["scope_ix"], scopes_["parent_ix"])
    code = pa.chunked_array([*names["name"].chunks, *syms["name"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    code, own = code[: names.num_rows], code[names.num_rows :]
    # the first symbol of each name in each scope
    place, seq = s.find(syms["scope_ix"].to_numpy()), syms["seq"].to_numpy()
    row = np.flatnonzero(place >= 0)
    row = row[np.lexsort((seq[row], own[row] * len(s.ids) + place[row]))]
    keys, at = np.unique(own[row] * len(s.ids) + place[row], return_index=True)
    row = row[at]
    # all names go up together, each until its scope has such a symbol
    where, found = s.find(names["scope_ix"].to_numpy()), np.full(names.num_rows, -1, np.int64)
    todo = np.flatnonzero(where >= 0)
    todo = todo[s.is_row[where[todo]]]
    for _ in range(len(s.ids) + 1):  # no chain is longer, unless scopes lie in themselves
        if not len(todo) or not len(keys):
            break
        want = code[todo] * len(s.ids) + where[todo]
        i = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[i] == want
        found[todo[hit]] = row[i[hit]]
        todo = todo[~hit]
        where[todo] = s.up[where[todo]]
        todo = todo[where[todo] >= 0]
    some = np.flatnonzero(found >= 0)
    n, y = names.take(some), syms.take(found[some])
    return pa.table([n["path"], n["name"], n["scope_ix"], y["seq"], y["kind"]], ["path", "name", "scope_ix", "seq", "kind"])


def resolve(names: DataFrame, symbols_: DataFrame, scopes_: DataFrame) -> DataFrame:
    """(path, name, scope_ix, seq, kind): the first symbol of a name along the chain of scopes. Chains are walked file by file and never written out."""
    columns = {"path": "string", "what": "int", "name": "string", "scope_ix": "long", "parent_ix": "long", "seq": "long", "kind": "string"}

    def part(df: DataFrame, what: int, *given: str) -> DataFrame:
        use = df.where(" and ".join(f"{c} is not null" for c in given if c in ("path", "name", "scope_ix", "seq")))
        return use.select(*(F.lit(what).alias(c) if c == "what" else (F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))

    t = part(names.select("path", "name", "scope_ix").distinct(), 0, "path", "name", "scope_ix")
    t = t.unionByName(part(scopes_, 1, "path", "scope_ix", "parent_ix")).unionByName(part(symbols_, 2, "path", "name", "scope_ix", "seq", "kind"))
    r = t.groupBy("path").applyInArrow(_resolve, "path string, name string, scope_ix long, seq long, kind string")
    kinds = {"scope_ix": names.schema["scope_ix"].dataType, "seq": symbols_.schema["seq"].dataType}
    return r.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in r.columns))


def enclosing_symbol(lines: DataFrame, symbols_: DataFrame) -> DataFrame:
    """(path, line, symbol): the first function or class by definition whose lines hold the line; '' where none does."""
    s = symbols_.where("kind in ('function', 'class')").select("path", "seq", "name", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    lines = lines.select("path", "line").distinct()
    # of symbols over the same lines only the first counts
    first = s.groupBy("path", "a", "z").agg(F.min("seq").alias("seq"))
    hit = lines.join(first, "path").where("line between a and z").groupBy("path", "line").agg(F.min("seq").alias("seq"))
    named = hit.join(s.select("path", "seq", "name"), ["path", "seq"]).groupBy("path", "line").agg(F.min("name").alias("name"))
    return lines.join(named, ["path", "line"], "left").select("path", "line", F.coalesce("name", F.lit("")).alias("symbol"))

"""Control flow and reaching definitions of a file, as edge and definition rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _children(nodes: list[dict]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for n in nodes:
        out.setdefault(n["parent_ix"], []).append(n["ix"])
    return out


class Flow:
    """Edges (from, to, kind) between the nodes of a tree; to is -1 at a function's end."""

    def __init__(self, nodes: list[dict]):
        self.kind = {n["ix"]: n["kind"] for n in nodes}
        self.kids = _children(nodes)
        self.edges: list[tuple[int, int, str]] = []
        for n in nodes:
            ix, kind = n["ix"], n["kind"]
            blocks = self.blocks(ix) if kind in ("if", "for", "while", "try") else []
            if kind == "if":
                self.edges += [(ix, b, "true" if i == 0 else "false") for i, b in enumerate(blocks)]
            elif kind in ("for", "while") and blocks:
                self.edges += [(ix, blocks[0], "loop"), (blocks[0], ix, "loop-back")]
                self.edges += [(e, ix, "loop-end") for last in self.statements(blocks[0])[-1:] for e in self.exits(last)]
            elif kind == "try" and blocks:
                self.edges.append((ix, blocks[0], "normal"))
            elif kind == "return":
                self.edges.append((ix, -1, "return"))
        for n in nodes:
            if n["kind"] in ("module", "block"):
                stmts = self.statements(n["ix"])
                if n["kind"] == "block" and stmts:
                    self.edges.append((n["ix"], stmts[0], "enter"))
                for one, nxt in zip(stmts, stmts[1:]):
                    self.edges += [(e, nxt, "normal") for e in self.exits(one)]

    def statements(self, ix: int) -> list[int]:
        """Statements below a node, wrappers opened."""
        out = []
        for c in self.kids.get(ix, ()):
            out += self.statements(c) if self.kind[c] == "unknown" else [c]
        return out

    def blocks(self, ix: int) -> list[int]:
        """Blocks right below a node or one wrapper further down."""
        out = []
        for c in self.kids.get(ix, ()):
            if self.kind[c] == "block":
                out.append(c)
            elif self.kind[c] == "unknown":
                out += [g for g in self.kids.get(c, ()) if self.kind[g] == "block"]
        return out

    def exits(self, ix: int) -> list[int]:
        """Nodes from which control leaves a statement."""
        kind = self.kind[ix]
        if kind == "return":
            return []
        if kind not in ("if", "try"):
            return [ix]
        blocks = self.blocks(ix)
        if kind == "try":
            blocks = blocks[:1]
        out = [e for b in blocks for s in self.statements(b)[-1:] for e in self.exits(s)]
        return out + [ix] if len(blocks) < (2 if kind == "if" else 1) else out


def reaching_definitions(nodes: list[dict]) -> dict[int, dict[str, set[int]]]:
    """Node -> variable -> assignments that may have set it when the node begins; forward fixed point."""
    flow = Flow(nodes)
    preds: dict[int, list[int]] = {}
    for a, b, _ in flow.edges:
        if b >= 0:
            preds.setdefault(b, []).append(a)
    defs = {n["ix"]: n["lhs"] for n in nodes if n["kind"] == "assignment" and isinstance(n["lhs"], str) and n["lhs"]}
    order = sorted({n for e in flow.edges for n in e[:2] if n >= 0})
    outs: dict[int, dict[str, set[int]]] = {}
    ins: dict[int, dict[str, set[int]]] = {}
    changed = True
    while changed:
        changed = False
        for n in order:
            got: dict[str, set[int]] = {}
            for p in preds.get(n, ()):
                for v, s in outs.get(p, {}).items():
                    got.setdefault(v, set()).update(s)
            ins[n] = got
            new = dict(got) if n not in defs else {**got, defs[n]: {n}}
            if new != outs.get(n):
                outs[n] = new
                changed = True
    return ins


def _edges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    flow = Flow(pdf.sort_values("ix").to_dict("records"))
    return pd.DataFrame([(key[0], *e) for e in flow.edges], columns=["path", "from_ix", "to_ix", "kind"])


def cfg_edges(nodes: DataFrame) -> DataFrame:
    """(path, from_ix, to_ix, kind) for Python files."""
    use = nodes.where("language = 'python'").select("path", "ix", "parent_ix", "kind")
    return use.groupBy("path").applyInPandas(_edges, "path string, from_ix int, to_ix int, kind string")


def _reach(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    ins = reaching_definitions(pdf.sort_values("ix").to_dict("records"))
    rows = [(key[0], n, v, d) for n, by in ins.items() for v, ds in by.items() for d in sorted(ds)]
    return pd.DataFrame(rows, columns=["path", "ix", "var", "def_ix"])


def reaching(nodes: DataFrame) -> DataFrame:
    """(path, ix, var, def_ix): definitions that reach a node."""
    use = nodes.where("language = 'python'").select("path", "ix", "parent_ix", "kind", "lhs")
    return use.groupBy("path").applyInPandas(_reach, "path string, ix int, var string, def_ix int")


def definitions(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'assignment' and lhs <> ''").selectExpr("path", "ix", "lhs as var")


def uses(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'identifier' and text <> ''").selectExpr("path", "ix", "text as var")

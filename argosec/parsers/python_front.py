"""Python source to syntax nodes, by the standard library's parser."""

from __future__ import annotations

import ast

from argosec.parsers.tree import Node, unquote

_BLOCKS = {ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while"}


class _Builder:
    def __init__(self, source: str):
        self.lines = [x.encode() for x in source.split("\n")]

    def text(self, n) -> str:
        a, b, c, d = n.lineno - 1, n.col_offset, n.end_lineno - 1, n.end_col_offset
        if a == c:
            return self.lines[a][b:d].decode("utf-8", "replace")
        return b"\n".join([self.lines[a][b:], *self.lines[a + 1 : c], self.lines[c][:d]]).decode("utf-8", "replace")

    @staticmethod
    def loc(n) -> tuple:
        return (n.lineno, n.col_offset, n.end_lineno, n.end_col_offset)

    def block(self, body) -> Node:
        return Node("block", loc=(*self.loc(body[0])[:2], *self.loc(body[-1])[2:]), children=[self.node(s) for s in body])

    def wrap(self, n, *children: Node) -> Node:
        return Node("unknown", loc=self.loc(n), children=list(children))

    def parameters(self, a: ast.arguments) -> list[str]:
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        return [x.arg for x in every]

    def node(self, n) -> Node:
        loc = self.loc(n)
        if isinstance(n, ast.Name):
            return Node("identifier", n.id, loc)
        if isinstance(n, ast.Constant):
            return Node("literal", unquote(self.text(n)) if isinstance(n.value, (str, bytes)) else self.text(n), loc)
        if isinstance(n, ast.JoinedStr):
            return Node("literal", unquote(self.text(n)), loc, [self.node(v.value) for v in n.values if isinstance(v, ast.FormattedValue)])
        if isinstance(n, ast.Attribute):
            name = Node("identifier", n.attr, (n.end_lineno, n.end_col_offset - len(n.attr), n.end_lineno, n.end_col_offset))
            return Node("attribute", "", loc, [self.node(n.value), name])
        if isinstance(n, ast.Call):
            args = sorted([*n.args, *n.keywords], key=lambda x: (x.lineno, x.col_offset))
            given = Node("unknown", loc=(n.func.end_lineno, n.func.end_col_offset, *loc[2:]), children=[self.node(a) for a in args])
            return Node("call", "", loc, [self.node(n.func), given], {"argument_count": len(args)})
        if isinstance(n, ast.keyword):
            if n.arg is None:
                return self.wrap(n, self.node(n.value))
            name = Node("identifier", n.arg, (n.lineno, n.col_offset, n.lineno, n.col_offset + len(n.arg)))
            return Node("keyword_argument", "", loc, [name, self.node(n.value)], {"kwarg_name": n.arg, "kwarg_value": self.text(n.value)})
        if isinstance(n, ast.Assign):
            right = self.node(n.value)
            text = self.text(n.value)
            for t in reversed(n.targets):
                left = self.node(t)
                right = Node("assignment", "", (*self.loc(t)[:2], *loc[2:]), [left, right], {"lhs": self.text(t), "rhs": text})
                text = f"{self.text(t)} = {text}"
            return right
        if isinstance(n, (ast.AugAssign, ast.AnnAssign)):
            a = {"lhs": self.text(n.target), "augmented": isinstance(n, ast.AugAssign)}
            children = [self.node(n.target)]
            if isinstance(n, ast.AnnAssign):
                children.append(self.wrap(n.annotation, self.node(n.annotation)))
            if n.value is not None:
                children.append(self.node(n.value))
                a["rhs"] = self.text(n.value)
            return Node("assignment", "", loc, children, a)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name = Node("identifier", n.name, (n.lineno, n.col_offset, n.lineno, n.col_offset))
            a = n.args
            inner = [Node("identifier", x.arg, self.loc(x)) for x in (*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else []))]
            inner += [self.node(d) for d in (*a.defaults, *a.kw_defaults) if d is not None]
            fn = Node("function_def", "", loc, [name, Node("unknown", loc=loc, children=inner), self.block(n.body)], {"function_name": n.name, "parameters": self.parameters(a) or None})
            return Node("unknown", loc=loc, children=[*(self.wrap(d, self.node(d)) for d in n.decorator_list), fn]) if n.decorator_list else fn
        if isinstance(n, ast.ClassDef):
            name = Node("identifier", n.name, (n.lineno, n.col_offset, n.lineno, n.col_offset))
            c = Node("class_def", "", loc, [name, *(self.wrap(b, self.node(b)) for b in (*n.bases, *n.keywords)), self.block(n.body)])
            return Node("unknown", loc=loc, children=[*(self.wrap(d, self.node(d)) for d in n.decorator_list), c]) if n.decorator_list else c
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            parts = [p for a in n.names for p in a.name.split(".")]
            return Node("import", "", loc, [Node("unknown", loc=loc, children=[Node("identifier", p, loc) for p in parts])])
        if isinstance(n, ast.Return):
            value = [self.node(n.value)] if n.value is not None else []
            return Node("return", "", loc, value, {"return_expr": self.text(n.value)} if value else {})
        if isinstance(n, tuple(_BLOCKS)):
            head = [n.test] if hasattr(n, "test") else [n.target, n.iter]
            children = [*map(self.node, head), self.block(n.body)]
            rest = n.orelse
            while rest and isinstance(n, ast.If) and len(rest) == 1 and isinstance(rest[0], ast.If) and self.text(rest[0]).startswith("elif"):
                children.append(self.wrap(rest[0], self.node(rest[0].test), self.block(rest[0].body)))
                rest = rest[0].orelse
            if rest:
                children.append(Node("unknown", loc=self.block(rest).loc, children=[self.block(rest)]))
            return Node(_BLOCKS[type(n)], "", loc, children)
        if isinstance(n, (ast.Try, ast.TryStar)):
            hs, children = [], [self.block(n.body)]
            for h in n.handlers:
                hs.append((h.type is None, [self.text(h.type)] if h.type is not None else [], len(h.body) == 1 and isinstance(h.body[0], ast.Pass)))
                children.append(self.wrap(h, *([self.wrap(h.type, self.node(h.type))] if h.type is not None else []), Node("unknown", loc=self.loc(h), children=[self.block(h.body)])))
            for more in (n.orelse, n.finalbody):
                if more:
                    b = self.block(more)
                    children.append(Node("unknown", loc=b.loc, children=[Node("unknown", loc=b.loc, children=[b])]))
            return Node("try", "", loc, children, {"except_handlers": hs} if hs else {})
        if isinstance(n, (ast.With, ast.AsyncWith)):
            items = [self.node(x) for i in n.items for x in ((i.context_expr, i.optional_vars) if i.optional_vars is not None else (i.context_expr,))]
            return self.wrap(n, *items, self.block(n.body))
        if isinstance(n, ast.Expr):
            return self.node(n.value)
        kind = {ast.Assert: "assert_statement", ast.BinOp: "binary_op"}.get(type(n), "unknown")
        return Node(kind, "", loc, [self.node(c) for c in self.below(n)])

    def below(self, n):
        """Placed nodes below a node, in source order; unplaced ones are passed through."""
        out = []
        for c in ast.iter_child_nodes(n):
            out += [c] if hasattr(c, "lineno") else self.below(c)
        return sorted(out, key=lambda c: (c.lineno, c.col_offset))


def parse(source: str) -> tuple[Node, str | None]:
    """The tree, and a warning if lines that do not parse were left out."""
    lines, dropped = source.split("\n"), 0
    while True:
        text = "\n".join(lines)
        try:
            tree = ast.parse(text)
            break
        except (SyntaxError, ValueError) as e:
            at = min(max((getattr(e, "lineno", 1) or 1) - 1, 0), len(lines) - 1)
            if dropped >= 50 or lines[at].strip() in ("", "pass"):
                return Node("module", loc=(1, 0, len(lines), 0)), "not parsed"
            dropped += 1
            old = lines[at]
            lines[at] = old[: len(old) - len(old.lstrip())] + "pass"
    b = _Builder(text)
    root = Node("module", "", (1, 0, len(lines), len(lines[-1])), [b.node(s) for s in tree.body])
    return root, f"{dropped} lines left out" if dropped else None

"""Syntax nodes and their interval-encoded rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NODE_SCHEMA = (
    "path string, language string, ix int, end_ix int, parent_ix int, child_pos int, depth int, kind string, text string, callee_text string, "
    "callee_last string, argument_count int, lhs string, rhs string, augmented boolean, return_expr string, function_name string, parameters array<string>, "
    "kwarg_name string, kwarg_value string, except_handlers array<struct<is_bare:boolean,types:array<string>,is_empty_body:boolean>>, "
    "start_line int, start_col int, end_line int, end_col int, "
    "args array<struct<kind:string,text:string,source:string,kwarg_name:string,kwarg_value:string>>, attribute_texts array<string>, warning string"
)
COLUMNS = [c.split()[0] for c in re.split(r", (?=[a-z_]+ )", NODE_SCHEMA)]


@dataclass
class Node:
    kind: str
    text: str = ""
    loc: tuple = (1, 0, 1, 0)
    children: list = field(default_factory=list)
    attrs: dict = field(default_factory=dict)

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def dotted(node: Node) -> str:
    """Text of an attribute chain; what is neither name nor chain is passed over."""
    if node.kind == "identifier":
        return node.text
    parts = [dotted(c) for c in node.children if c.kind in ("identifier", "attribute")]
    return ".".join(p for p in parts if p)


def callee(node: Node) -> str:
    """Name of what a call calls: its first child that is a non-empty name or chain."""
    return next((t for c in node.children if c.kind in ("identifier", "attribute") and (t := dotted(c))), "")


def source_text(node: Node) -> str | None:
    """The text that taint sources are looked for in; None for kinds that are no source."""
    if node.kind == "call":
        return callee(node) + "("
    return dotted(node) if node.kind in ("attribute", "identifier") else None


def function_name(node: Node) -> str:
    return node.attrs.get("function_name") or next((c.text for c in node.children if c.kind == "identifier" and c.text), "")


def unquote(s: str) -> str:
    """One layer of equal quotes is taken off."""
    for q in ('"""', "'''"):
        if len(s) >= 6 and s.startswith(q) and s.endswith(q):
            return s[1:-1]
    return s[1:-1] if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'`" else s


def rows(root: Node, path: str, language: str, warning: str | None = None, shift: tuple = (1, 0)) -> list[tuple]:
    """Pre-order rows of a tree. shift: line and column at which the text begins in its file.

    `args` holds what may be an argument of a call (all below its second child and later ones), or
    the right-hand side of an assignment (its last child and all below), in source order.
    """
    out: list[list] = []

    def place(line: int, col: int) -> tuple[int, int]:
        return line + shift[0] - 1, col + (shift[1] if line == 1 else 0)

    stack = [(root, -1, 0, 0, False)]
    open_: list[int] = []
    while stack:
        n, parent, pos, depth, leave = stack.pop()
        if leave:
            out[open_.pop()][3] = len(out) - 1
            continue
        ix = len(out)
        a = n.attrs
        call, args, name = n.kind == "call", None, None
        if call:
            name = callee(n)
            args = [d for c in n.children[1:] for d in c.walk()]
        elif n.kind == "assignment" and n.children:
            args = list(n.children[-1].walk())
        if args is not None:
            args = [(d.kind, d.text, source_text(d), d.attrs.get("kwarg_name"), d.attrs.get("kwarg_value")) for d in args if d.kind not in ("unknown", "block")]
        chains = [t for c in n.children if c.kind == "attribute" and (t := dotted(c))] if call else None
        out.append([path, language, ix, ix, parent, pos, depth, n.kind, n.text, name, name.rsplit(".", 1)[-1] if call else None, a.get("argument_count"), a.get("lhs"), a.get("rhs"), a.get("augmented", False), a.get("return_expr"), function_name(n) if n.kind in ("function_def", "class_def") else None, a.get("parameters"), a.get("kwarg_name"), a.get("kwarg_value"), a.get("except_handlers"), *place(n.loc[0], n.loc[1]), *place(n.loc[2], n.loc[3]), args, chains, warning if ix == 0 else None])
        open_.append(ix)
        stack.append((n, parent, pos, depth, True))
        for i in range(len(n.children) - 1, -1, -1):
            stack.append((n.children[i], ix, i, depth + 1, False))
    return [tuple(r) for r in out]

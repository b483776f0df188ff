"""HTML to one call node an element, and inline scripts to fragments."""

from __future__ import annotations

import re

from argosec.parsers.tree import Node

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_RAW = ("script", "style", "textarea", "title")
SCRIPT_TYPES = {"", "module", "text/javascript", "application/javascript", "text/ecmascript", "application/ecmascript", "application/x-javascript", "text/jscript"}


class Lines:
    """Line and byte column of a character offset."""

    def __init__(self, s: str):
        self.s, self.at = s, [0, *(m.end() for m in re.finditer("\n", s))]

    def __call__(self, i: int) -> tuple[int, int]:
        from bisect import bisect_right

        k = bisect_right(self.at, i) - 1
        return k + 1, len(self.s[self.at[k] : i].encode())


def elements(s: str):
    """(tag, attributes, begin, end, body begin, body end) of every element's start tag; bodies of raw-text elements are not looked into."""
    i = 0
    while m := _TAG.search(s, i):
        i = m.end()
        if not m[1]:
            continue
        tag = m[1].lower()
        attrs = [(a[1].lower(), next((g for g in a.groups()[1:] if g is not None), ""), m.start(2) + a.start(), m.start(2) + a.end()) for a in _ATTR.finditer(m[2])]
        body = (i, i)
        if tag in _RAW and not m[2].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\b", re.I).search(s, i)
            body = (i, end.start() if end else len(s))
            i = body[1]
        yield tag, attrs, m.start(), m.end(), *body


def parse(source: str) -> tuple[Node, str | None]:
    where = Lines(source)
    root = Node("module", "", (1, 0, *where(len(source))))
    for tag, attrs, a, z, *_ in elements(source):
        loc = (*where(a), *where(z))
        name = Node("identifier", tag, loc)
        given = [Node("keyword_argument", "", (*where(p), *where(q)), [], {"kwarg_name": k, "kwarg_value": v}) for k, v, p, q in attrs]
        root.children.append(Node("call", "", loc, [name, *given], {"argument_count": len(attrs)}))
    return root, None


def scripts(source: str) -> list[tuple[str, int, int]]:
    """(body, first line, first column) of each inline script."""
    where, out = Lines(source), []
    for tag, attrs, _, _, a, z in elements(source):
        given = {k: v for k, v, *_ in attrs}
        if tag == "script" and "src" not in given and given.get("type", "").strip().lower() in SCRIPT_TYPES and source[a:z].strip():
            out.append((source[a:z], *where(a)))
    return out

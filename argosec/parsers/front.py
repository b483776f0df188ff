"""files -> syntax rows: one row in, many out, in one Python stage."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.parsers import clike_front, html_front, python_front
from argosec.parsers.tree import COLUMNS, NODE_SCHEMA, Node, rows
from argosec.storage import spread

PARSERS = {
    "python": python_front.parse,
    "html": html_front.parse,
    **{k: (lambda s, k=k: clike_front.parse(s, k)) for k in ("javascript", "typescript", "go", "java", "csharp", "php")},
}


def parse_source(path: str, language: str, source: str) -> list[tuple]:
    """Rows of a file; inline scripts of HTML follow as files `path#script<n>` with lines of the page."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
    source = source.replace("\x00", " ")
    try:
        root, warning = PARSERS[language](source)
        out = rows(root, path, language, warning)
    except RecursionError:
        return rows(Node("module"), path, language, "nested too deep")
    if language == "html":
        for k, (body, line, col) in enumerate(html_front.scripts(source)):
            root, warning = PARSERS["javascript"](body)
            out += rows(root, f"{path}#script{k}", "javascript", warning, (line, col))
    return out


def _parse(pdfs):
    for pdf in pdfs:
        out = []
        for x in pdf.itertuples(index=False):
            out += parse_source(x.path, x.language, x.content)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def ir_nodes(files: DataFrame) -> DataFrame:
    """Syntax rows of files (path, language, content); other languages and null contents give none."""
    use = files.where(F.col("language").isin(*PARSERS) & F.col("content").isNotNull())
    return spread(use.select("path", "language", F.col("content").cast("string").alias("content"))).mapInPandas(_parse, NODE_SCHEMA)

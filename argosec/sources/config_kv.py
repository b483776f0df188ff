"""Key-value configuration files as rows (path, key, value, line)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argosec.functions.text import base_name
from argosec.sources.walk import lines

KV = "path string, key string, value string, line int"


def _unquoted(c):
    return F.when(c.rlike(r"""(?s)\A(?:".*"|'.*')\z""") & (F.length(c) >= 2), F.expr("substring(v, 2, length(v) - 2)")).otherwise(c)


def env_entries(files: DataFrame) -> DataFrame:
    """dotenv: comments skipped, `export ` stripped, split at the first =, one pair of quotes taken off."""
    t = lines(files).withColumn("t", F.trim(F.regexp_replace("line", r"\r\z", ""))).where("t <> '' and not startswith(t, '#')")
    t = t.withColumn("t", F.regexp_replace("t", r"\Aexport\s+", "")).where(F.col("t").contains("="))
    t = t.withColumn("key", F.trim(F.substring_index("t", "=", 1))).withColumn("v", F.trim(F.expr("substring(t, locate('=', t) + 1)")))
    return t.select("path", "key", _unquoted(F.col("v")).alias("value"), F.col("line_no").alias("line"))


def property_entries(files: DataFrame) -> DataFrame:
    """Java properties: # and ! comments; = separates, else :."""
    t = lines(files).withColumn("t", F.trim(F.regexp_replace("line", r"\r\z", ""))).where(r"t <> '' and not t rlike '\\A[#!]'")
    sep = F.when(F.col("t").contains("="), "=").otherwise(":")
    t = t.withColumn("sep", sep).where("locate(sep, t) > 0")
    return t.select("path", F.trim(F.expr("substring(t, 1, locate(sep, t) - 1)")).alias("key"), F.trim(F.expr("substring(t, locate(sep, t) + 1)")).alias("value"), F.col("line_no").alias("line"))


def flatten_yaml(text: str) -> list[tuple[str, str, int]]:
    """(dotted path, scalar, line) of the first document; sequences are numbered, aliases passed over."""
    import yaml

    out: list[tuple[str, str, int]] = []
    try:
        root = next(iter(yaml.compose_all(text, Loader=yaml.SafeLoader)), None)
    except yaml.YAMLError:
        return out
    todo, seen = [("", root)], set()
    while todo:
        path, n = todo.pop()
        if n is None or id(n) in seen and not isinstance(n, yaml.ScalarNode):
            continue
        seen.add(id(n))
        if isinstance(n, yaml.ScalarNode):
            out.append((path, n.value, n.start_mark.line + 1))
        else:
            pairs = [(k.value, v) for k, v in n.value] if isinstance(n, yaml.MappingNode) else list(enumerate(n.value))
            todo += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(pairs)]
    return out


def _yaml(pdfs):
    for pdf in pdfs:
        yield pd.DataFrame([(x.path, *r) for x in pdf.itertuples() for r in flatten_yaml(x.content or "")], columns=["path", "key", "value", "line"])


def yaml_entries(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_yaml, KV)


def file_named(pattern: str):
    return F.lower(base_name(F.col("path"))).rlike(pattern)

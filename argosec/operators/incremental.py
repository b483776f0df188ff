"""Incremental scans: state tables by content hash, replaced as a whole."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.storage import read_text, remove, write_text

# the first field that differs decides what is dropped
MATRIX = (("format", ("findings", "nodes")), ("engine", ("findings", "nodes")), ("rules", ("findings",)), ("options", ("findings",)), ("ir_schema", ("nodes",)))


def invalid(old: dict | None, new: dict) -> tuple[str, ...]:
    """State tables that a change of meta makes useless; a missing or broken meta drops all."""
    if not isinstance(old, dict):
        return ("findings", "nodes")
    return next((drop for field, drop in MATRIX if old.get(field) != new.get(field)), ())


def misses(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, content_sha256) whose content the state doesn't hold; a left anti join."""
    return files.join(state.select("path", "content_sha256").distinct(), ["path", "content_sha256"], "left_anti")


def hits(files: DataFrame, state: DataFrame) -> DataFrame:
    """State rows of files that did not change."""
    return state.join(files.select("path", "content_sha256").distinct(), ["path", "content_sha256"], "left_semi")


class State:
    """Versions of tables in a folder of any file system that Spark knows; a small pointer file names the current ones and is replaced at once.

    The versions before the current ones stay for readers that began with them; those before these are removed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, (root if "://" in root else os.path.abspath(root)).rstrip("/")

    def _pointer(self) -> str:
        return f"{self.root}/current.json"

    def read(self) -> dict:
        try:
            got = json.loads(read_text(self.spark, self._pointer()) or "{}")
        except (ValueError, Py4JError):  # a pointer that is damaged or cannot be read is none
            return {}
        return got if isinstance(got, dict) else {}

    def table(self, name: str, meta: dict) -> DataFrame | None:
        """The current version, or None if there is none or meta makes it useless."""
        got = self.read()
        if name in invalid(got.get("meta"), meta) or not isinstance(got.get(name), str):
            return None
        return self.spark.read.parquet(f"{self.root}/{got[name]}")

    def replace(self, tables: dict[str, DataFrame], meta: dict) -> None:
        """Write the tables, then let one pointer name them all."""
        new = {}
        for name, df in tables.items():
            new[name] = f"{name}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.root}/{new[name]}")
        got = self.read()
        dropped = invalid(got.get("meta"), meta)
        before = [got[n] for n in ("findings", "nodes") if isinstance(got.get(n), str) and (n in new or n in dropped)]
        kept = {n: got[n] for n in ("findings", "nodes") if n in got and n not in dropped}
        write_text(self.spark, self._pointer(), json.dumps(kept | new | {"meta": meta, "before": before}))
        for old in got.get("before") or []:
            remove(self.spark, f"{self.root}/{old}")


def refresh(files: DataFrame, state: DataFrame | None, compute, key=("path", "content_sha256")) -> DataFrame:
    """State for files: kept rows of unchanged files and computed rows of the others. compute: files -> rows with path."""
    if state is None:
        return compute(files).join(files.select(*key), "path")
    fresh = compute(misses(files, state)).join(files.select(*key), "path")
    return hits(files, state).unionByName(fresh, allowMissingColumns=True)

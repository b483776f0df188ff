"""Small driver-side inputs: allowlists, labelled corpora, advisories, version control."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.operators.accuracy import EXPECTATION
from argosec.operators.dependencies import ADVISORY
from argosec.sources.walk import walk


def load_allowlist(path: str, must_exist: bool = False) -> list[dict]:
    """Entries (id, fingerprint, path, reason) of a YAML file with a list `suppressions`."""
    import yaml

    if not os.path.exists(path):
        if must_exist:
            raise FileNotFoundError(path)
        return []
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    out = doc.get("suppressions") or []
    for e in out:
        if not e.get("id") and not e.get("fingerprint"):
            raise ValueError(f"{path}: a suppression needs an id or a fingerprint")
    return [e | {"path": e.get("path") or e.get("path_glob")} for e in out]


def load_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories from Parquet or JSON lines; there is no network source."""
    return spark.read.schema(ADVISORY).json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _modality(folder: str) -> str:
    return {"sca": "sca", "secrets": "secret", "framework": "config"}.get(folder, "sast")


def load_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, cases, expectations) of the subfolders that have a manifest.yaml; cases whose file is missing are left out."""
    import yaml

    cases, expected = [], []
    for folder in sorted(os.listdir(root)):
        manifest = os.path.join(root, folder, "manifest.yaml")
        if not os.path.exists(manifest):
            continue
        with open(manifest, encoding="utf-8") as f:
            doc = yaml.safe_load(f)
        for c in doc.get("cases") or []:
            if not c.get("file"):
                raise ValueError(f"{manifest}: a case without file")
            path = os.path.abspath(os.path.join(root, folder, c["file"]))
            if not os.path.exists(path):
                continue
            lang = c.get("language") or c.get("ecosystem") or folder
            cases.append((path, lang))
            for e in c.get("expect") or []:
                dep = e.get("dependency") or {}
                if bool(e.get("rule_id")) == bool(dep):
                    raise ValueError(f"{manifest}: an expectation has a rule_id or a dependency")
                expected.append((path, lang, _modality(folder), e.get("rule_id"), e.get("min_count") or 1, dep.get("package"), dep.get("ecosystem")))
    files = walk(spark, root)
    return files, spark.createDataFrame(cases, "file string, language string"), spark.createDataFrame(expected, EXPECTATION)


def git_head(root: str) -> tuple[str | None, str | None]:
    """(commit, branch), where git knows them."""

    def ask(*args: str) -> str | None:
        try:
            return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10, check=True).stdout.strip() or None
        except (OSError, subprocess.SubprocessError):
            return None

    return ask("rev-parse", "HEAD"), ask("branch", "--show-current")


def files_of_rows(rows: DataFrame) -> DataFrame:
    """Rows (path, content) as a files table."""
    from argosec.sources.walk import language

    c = F.col("content").cast("string")
    return rows.select("path", F.col("path").alias("rel_path"), F.length(c).cast("long").alias("size"), F.lit(False).alias("is_binary"), language(F.col("path"), c).alias("language"), c.alias("content"), F.sha2(c, 256).alias("content_sha256"))

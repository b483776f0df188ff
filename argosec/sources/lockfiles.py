"""Manifests and lock files as dependency rows (ecosystem, package, version, manifest, direct)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argosec.functions.text import base_name
from argosec.sources.walk import lines
from argosec.storage import spread

DEPENDENCY = "ecosystem string, package string, version string, manifest string, direct boolean"
_VERSIONS = "map<string,struct<version:string>>"


def _named(files: DataFrame, rx: str) -> DataFrame:
    return files.where(base_name(F.col("path")).rlike(rx))


def _out(df: DataFrame, ecosystem: str) -> DataFrame:
    return df.select(F.lit(ecosystem).alias("ecosystem"), "package", "version", F.col("path").alias("manifest"), "direct").where("package <> '' and version <> ''")


def npm(files: DataFrame) -> DataFrame:
    """package-lock.json: `dependencies` up to version 1, else `packages`."""
    p = _named(files, r"\Apackage-lock\.json\z").select("path", F.from_json("content", f"lockfileVersion int, packages {_VERSIONS}, dependencies {_VERSIONS}").alias("j"))
    new = F.coalesce("j.lockfileVersion", F.lit(0)) > 1
    v2 = p.where(new).select("path", F.explode("j.packages").alias("k", "v")).where("k <> ''").withColumn("package", F.regexp_replace("k", r"\Anode_modules/", ""))
    v1 = p.where(~new).select("path", F.explode("j.dependencies").alias("package", "v"))
    v2 = v2.select("path", "package", "v.version", (~F.col("package").contains("node_modules/")).alias("direct"))
    v1 = v1.select("path", "package", "v.version", (~F.col("package").contains("/")).alias("direct"))
    return _out(v2.unionByName(v1), "npm")


def yarn(files: DataFrame) -> DataFrame:
    """yarn.lock v1 and v2: a header line, then its version."""
    t = lines(_named(files, r"\Ayarn\.lock\z")).withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    head = F.when(F.col("line").rlike(r"\A[^\s#].*:\z") & ~F.col("line").startswith("__metadata"), F.col("line"))
    w = Window.partitionBy("path").orderBy("line_no")
    t = t.withColumn("head", F.last(head, ignorenulls=True).over(w)).withColumn("version", F.regexp_extract("line", r'\A\s+version:?\s+"?([^"\s]+)"?', 1))
    first = F.min(F.when(F.col("version") != "", F.col("line_no"))).over(Window.partitionBy("path", "head"))
    t = t.where("head is not null and version <> ''").withColumn("f", first).where("line_no = f")
    spec = F.trim(F.regexp_replace(F.substring_index(F.regexp_replace("head", r'\A"|"?:\z', ""), ",", 1), '"', ""))
    name = F.trim(F.regexp_replace(spec, r"(?<=.)@[^@]*\z", ""))
    return _out(t.select("path", name.alias("package"), "version", F.lit(True).alias("direct")), "npm")


def _pnpm(pdfs):
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for pdf in pdfs:
        out = []
        for x in pdf.itertuples():
            try:
                doc = yaml.load(x.content or "", loader)
            except yaml.YAMLError:
                doc = None
            keys = (doc.get("packages") if isinstance(doc, dict) else None) or {}
            out += [(x.path, str(k)) for k in keys]
        yield pd.DataFrame(out, columns=["path", "k"])


def pnpm(files: DataFrame) -> DataFrame:
    k = spread(_named(files, r"\Apnpm-lock\.ya?ml\z").select("path", "content")).mapInPandas(_pnpm, "path string, k string")
    rx = r"\A/?(.+)@([^@]+)\z"
    k = k.withColumn("k", F.regexp_replace("k", r"\(.*\z", ""))  # what peers it was resolved with
    return _out(k.select("path", F.regexp_extract("k", rx, 1).alias("package"), F.regexp_extract("k", rx, 2).alias("version"), F.lit(True).alias("direct")), "npm")


def pipfile(files: DataFrame) -> DataFrame:
    p = _named(files, r"\APipfile\.lock\z").select("path", F.from_json("content", f"default {_VERSIONS}, develop {_VERSIONS}").alias("j"))
    parts = [p.select("path", F.explode(f"j.{k}").alias("package", "v"), F.lit(k == "default").alias("direct")) for k in ("default", "develop")]
    both = parts[0].unionByName(parts[1])
    return _out(both.select("path", "package", F.regexp_replace("v.version", r"\A==", "").alias("version"), "direct"), "PyPI")


def requirements(files: DataFrame) -> DataFrame:
    t = lines(_named(files, r"\Arequirements.*\.txt\z")).withColumn("t", F.trim(F.regexp_replace(F.regexp_replace("line", r"\r\z", ""), r" #.*\z", "")))
    t = t.where(r"t <> '' and not t rlike '\\A(?:#|-r|-e)' and contains(t, '==')")
    name = F.trim(F.regexp_replace(F.substring_index("t", "==", 1), r"\[.*\]", ""))
    version = F.trim(F.expr("substring(t, locate('==', t) + 2)"))
    return _out(t.select("path", name.alias("package"), F.trim(F.substring_index(version, ";", 1)).alias("version"), F.lit(True).alias("direct")), "PyPI")


def go_mod(files: DataFrame) -> DataFrame:
    t = lines(_named(files, r"\Ago\.mod\z")).withColumn("t", F.trim(F.regexp_replace("line", r"\r\z", "")))
    opens, closes = F.col("t").rlike(r"\Arequire\s*\("), F.col("t") == ")"
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(before)
    t = t.withColumn("inside", F.coalesce(mark, F.lit(False))).where("t <> '' and t <> ')' and not startswith(t, '//')")
    single = F.regexp_extract("t", r"\Arequire\s+(?!\()(.+)\z", 1)
    t = t.withColumn("spec", F.when(F.col("inside"), F.col("t")).otherwise(single)).where("spec <> ''")
    t = t.withColumn("f", F.split(F.trim(F.substring_index("spec", "//", 1)), r"\s+")).where("size(f) = 2")
    return _out(t.select("path", F.col("f")[0].alias("package"), F.col("f")[1].alias("version"), (~F.col("spec").contains("// indirect")).alias("direct")), "Go")


def _pom(pdfs):
    import re
    import xml.etree.ElementTree as ET

    for pdf in pdfs:
        out = []
        for x in pdf.itertuples():
            try:
                root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", x.content or "", count=1))
            except ET.ParseError:
                continue
            props = {p.tag: (p.text or "").strip() for p in root.findall("properties/*")}
            managed = {}
            found = [(d, False) for d in root.findall("dependencyManagement/dependencies/dependency")] + [(d, True) for d in root.findall("dependencies/dependency")]
            for d, direct in found:
                g, a, v = ((d.findtext(k) or "").strip() for k in ("groupId", "artifactId", "version"))
                v = re.sub(r"\$\{([^}]+)\}", lambda m: props.get(m[1], ""), v)
                if v[:1] in "[(":
                    m = re.search(r"\d[0-9A-Za-z.\-]*", v)
                    v = m[0] if m else ""
                name = f"{g}:{a}"
                if direct:
                    v = v or managed.get(name, "")
                else:
                    managed[name] = v
                if g and a and v:
                    out.append((x.path, name, v, direct))
        yield pd.DataFrame(out, columns=["path", "package", "version", "direct"])


def maven(files: DataFrame) -> DataFrame:
    return _out(spread(_named(files, r"\Apom\.xml\z").select("path", "content")).mapInPandas(_pom, "path string, package string, version string, direct boolean"), "Maven")


READERS = (npm, yarn, pnpm, pipfile, requirements, go_mod, maven)


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of all manifests, each (ecosystem, package, version) once, from the first manifest by name."""
    every = reduce(DataFrame.unionByName, (r(files) for r in READERS))
    return dedup(every)


def dedup(deps: DataFrame) -> DataFrame:
    first = Window.partitionBy("ecosystem", "package", "version").orderBy("manifest", F.col("direct").desc())
    return deps.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

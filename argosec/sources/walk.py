"""Source trees as tables: listing, pruning, sniffing, language detection."""

from __future__ import annotations

import os
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.functions.text import base_name, glob_regex
from argosec.storage import stash, worker_fs

PRUNED = tuple(
    ".argosec .git .mypy_cache .pytest_cache .ruff_cache .tox .venv __pycache__ assets bin build coverage dist htmlcov media migrations node_modules obj public static vendor venv".split()
)
BINARY_EXTENSIONS = tuple(".7z .bmp .bz2 .class .dll .dylib .exe .gif .gz .ico .jpeg .jpg .pdf .png .pyc .pyd .rar .so .tar .wasm .xz .zip".split())
IGNORED = ("*.min.css", "*.min.map", "*.min.js")
MAX_BYTES = 1 << 20
_BY_LANGUAGE = {"python": "py pyw", "javascript": "js mjs cjs jsx", "typescript": "ts tsx mts cts", "csharp": "cs", "go": "go", "php": "php", "java": "java", "html": "html htm"}
EXTENSIONS = {f".{e}": k for k, v in _BY_LANGUAGE.items() for e in v.split()}
SHEBANGS = {f"#!/usr/bin/{env}{name}": k for k, names in {"python": ("python3", "python"), "javascript": ("node",)}.items() for name in names for env in ("", "env ")}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)\z", 1))


def language(path: Column, content: Column) -> Column:
    """By extension, else by the first line; unknown otherwise."""
    known = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    first = F.regexp_replace(F.substring_index(F.coalesce(content, F.lit("")), "\n", 1), r"\r\z", "")
    sheb = F.coalesce(*(F.when((first == k) | first.startswith(k + " "), F.lit(v)) for k, v in SHEBANGS.items()), F.lit("unknown"))
    return F.coalesce(F.try_element_at(known, extension(path)), sheb)


def keep_directories(rel: Column, exclude: tuple[str, ...] = ()) -> Column:
    """No folder on the way has a pruned name."""
    folders = F.split(rel, "/")
    return ~F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda d: d.isin(*PRUNED, *exclude))


def keep_extension(path: Column) -> Column:
    return ~extension(path).isin(*BINARY_EXTENSIONS)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 512 bytes; content is binary."""
    return F.hex(F.substring(content, 1, 512)).rlike(r"\A(?:..)*?00")


def ignore_regex(line: str) -> str | None:
    """A line of an ignore file as a regular expression over paths from the root of the walk; None for comments, blank lines and negations.

    A trailing slash names a folder from the root on, taken literally; other globs match the path, or its last parts.
    """
    p = line.strip()
    if not p or p.startswith(("#", "!")):
        return None
    if p.endswith("/"):
        return rf"\A{re.escape(p[:-1])}(?:/|\z)"
    core = glob_regex(p)[2:-2]
    try:
        re.compile(core)
    except re.error:  # a glob that is none, such as [z-a], matches nothing
        return None
    return rf"(?:\A|/){core}\z"


def ignore_patterns(lines: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(owner, line) of ignore files -> (owner, regex); the owner is the file's folder, '' at the root."""
    return [(owner, rx) for owner, line in lines if (rx := ignore_regex(line))]


def not_ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Left anti join of files (rel_path) with patterns (owner, regex), each of which holds for the files below its owner: an equi-join on the folders around a file."""
    one = patterns.groupBy("owner").agg(F.array_join(F.sort_array(F.collect_set("regex")), "|").alias("regex"))
    folders = F.split("rel_path", "/")
    around = F.transform(F.sequence(F.lit(0), F.size(folders) - 1), lambda n: F.array_join(F.slice(folders, 1, n), "/"))
    hit = files.select("rel_path", F.explode(around).alias("owner")).join(one, "owner").where(F.rlike("rel_path", "regex"))
    return files.join(hit.select("rel_path").distinct(), "rel_path", "left_anti").select(*files.columns)


_LISTED = "kind string, rel_path string, size long, regex string"
LIST_STEP = 5000
FILES_A_TASK = 100_000


def _children(folder: str):
    """(name, is folder, size) of what is in a folder; links and special files are left out, and so is a folder that cannot be read."""
    fs, bare = worker_fs(folder)
    try:
        if isinstance(fs, pafs.LocalFileSystem):
            with os.scandir(bare) as it:
                return [(e.name, e.is_dir(follow_symlinks=False), 0 if e.is_dir(follow_symlinks=False) else e.stat(follow_symlinks=False).st_size) for e in it if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
        return [(i.base_name, i.type == pafs.FileType.Directory, i.size or 0) for i in fs.get_file_info(pafs.FileSelector(bare))]
    except OSError:
        return []


def _read(path: str) -> bytes | None:
    fs, bare = worker_fs(path)
    try:
        with fs.open_input_stream(bare, compression=None) as f:
            return f.read()
    except OSError:
        return None


def _list(root: str, exclude: tuple[str, ...]):
    """Files, lines of ignore files and, after LIST_STEP entries of a task, the folders that are still to be listed. Pruned folders are never entered."""

    def run(batches):
        todo = [x for b in batches for x in b.column(0).to_pylist()]
        out = []
        while todo and len(out) < LIST_STEP:
            rel = todo.pop()
            for name, folder, size in _children(f"{root}/{rel}" if rel else root):
                path = f"{rel}/{name}" if rel else name
                if not folder:
                    out.append(("file", path, size, None))
                    if name in (".gitignore", ".zsignore"):
                        lines = (_read(f"{root}/{path}") or b"").decode("utf-8", "replace").splitlines()
                        out += [("pattern", rel, 0, rx) for x in lines if (rx := ignore_regex(x))]
                elif name not in PRUNED and name not in exclude:
                    todo.append(path)
        out += [("folder", x, 0, None) for x in todo]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string()))] if out else [pa.array([], k) for k in (pa.string(), pa.string(), pa.int64(), pa.string())], ["kind", "rel_path", "size", "regex"])

    return run


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(kind, rel_path, size, regex) of a tree: its files, and the patterns of ignore files with the folder that owns them. Large trees are listed in rounds by all tasks."""
    out = None
    todo = spark.createDataFrame([("",)], "rel_path string")
    while True:
        found = stash(todo.mapInArrow(_list(root, exclude), _LISTED), "listing")
        out = found if out is None else out.unionByName(found)
        todo = found.where("kind = 'folder'").select("rel_path")
        if todo.isEmpty():
            return out
        todo = todo.repartition(spark.sparkContext.defaultParallelism)


def _contents(root: str):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 16):  # files are of max_bytes at most
                part = b.slice(at, 16)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([_read(f"{root}/{p}") for p in part.column(0).to_pylist()], pa.binary())], ["rel_path", "size", "content"])

    return run


def walk(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files of a tree (path, rel_path, size, is_binary, language, content, content_sha256).

    Names, sizes and ignore files are looked at first, and only what they leave is read. Bytes that are no UTF-8 become U+FFFD; a file that cannot be read is left out.
    """
    root = (root if "://" in root else os.path.abspath(root)).rstrip("/") or "/"
    found = listing(spark, root, exclude)
    f = found.where("kind = 'file'").where(F.col("size") <= max_bytes).where(keep_extension(F.col("rel_path"))).select("rel_path", "size")
    shipped = spark.createDataFrame(ignore_patterns([("", p) for p in IGNORED]), "owner string, regex string")
    f = not_ignored(f, shipped.unionByName(found.where("kind = 'pattern'").select(F.col("rel_path").alias("owner"), "regex")))
    f = f.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_contents(root), "rel_path string, size long, content binary").where("content is not null")
    path = F.concat(F.lit(root.rstrip("/") + "/"), "rel_path")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return f.select(path.alias("path"), "rel_path", "size", is_binary(F.col("content")).alias("is_binary"), language(path, text).alias("language"), text.alias("content"), F.sha2("content", 256).alias("content_sha256"))


def line_counts(files: DataFrame) -> DataFrame:
    """(line, n, n_files): how often each line occurs, and in how many paths.

    Files go to tasks of some FILES_A_TASK of them by path, so what a task holds does not grow with the input, and (path, line) is whole within a task and needs no shuffle of its own.
    """
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES_A_TASK))
    own = lines(files.select("path", "content").repartition(tasks, "path")).groupBy("path", "line").agg(F.count("*").alias("n"))
    return own.groupBy("line").agg(F.sum("n").alias("n"), F.count("path").alias("n_files"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line): every line, split at \\n alone."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")

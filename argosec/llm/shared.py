"""Tables of the shared folder in workers, and connected components."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argosec.storage import new_path, shared_dir, spread, stash, stash_alone, worker_fs

__all__ = ["components", "drop_path", "drop_stash", "keep", "lean", "new_path", "shared_dir", "spread", "stash", "stash_alone", "table", "worker_fs", "worker_table"]


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stash(df: DataFrame) -> None:
    """Remove a stashed table that no later result reads."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def keep(group: str, name: str, key, make):
    """make(), or what it gave for the same key before, in a Python worker that outlives its tasks. Only one group's objects are kept at a time.

    Functions of this package reach the workers by value, with globals of their own for each task; the module sys is the worker's.
    """
    kept = sys.__dict__.setdefault("_argosec_kept", {})
    if kept.get("group") != group:
        kept.clear()
        kept["group"] = group
    if name not in kept or kept[name][0] != key:
        kept.pop(name, None)
        kept[name] = (key, make())
    return kept[name][1]


def lean(group: str, run):
    """run, for mapInArrow, in a worker that keeps no other group's objects and gives free memory back before and after; else a worker holds on to the most that any task before took."""

    def task(batches):
        _give_back(group)
        yield from run(batches)
        _give_back(group)

    return task


def _give_back(group: str) -> None:
    kept = sys.__dict__.get("_argosec_kept", {})
    if kept.get("group") != group:
        kept.clear()
        gc.collect()  # what was kept may hold itself
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's only
    if trim:
        trim(0)


def worker_table(path: str, columns=None):
    """A written table, read inside a Python worker."""
    fs, bare = worker_fs(path)
    return pads.dataset(bare, filesystem=fs, format="parquet", ignore_prefixes=["_", "."]).to_table(columns=columns)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components of edges (a, b), both bigint; root is the least node of each.

    Alternating large-star and small-star rounds; each is two shuffles of at most the
    number of edges, and the number of rounds grows with the logarithm of the longest chain.
    The label table is written to the shared folder after each round.
    """
    e = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small.select("u", F.col("m").alias("v"))).distinct()
        nxt = stash(small, "edges")
        drop_stash(e)
        e = nxt
        r = e.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"), F.countDistinct("u").alias("d")).first()
        if (r.n, r.s) == seen and r.n == r.d:
            break
        seen = (r.n, r.s)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, over as many tasks as there are cores at least."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))

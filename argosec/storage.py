"""The folder that all executors see, and tables written to it to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: ContextVar[list[str] | None] = ContextVar("_MADE", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; an own folder only in local mode, where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="argosec-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/argosec/{name}-{uuid.uuid4().hex[:12]}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


def stash_alone(make, name: str) -> DataFrame:
    """stash(make(), name); whatever else make() wrote to the shared folder is removed."""
    token = _MADE.set(made := [])
    try:
        out = stash(make(), name)
    finally:
        _MADE.reset(token)
    for path in made[:-1]:
        remove(out.sparkSession, path)
    return out


def release_shuffles(spark: SparkSession, run):
    """run(), whose queries remove their shuffle files as they end and not when the driver collects its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        return run()
    finally:
        spark.conf.set(_RELEASE, before) if before is not None else spark.conf.unset(_RELEASE)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    release_shuffles(df.sparkSession, lambda: df.write.parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_fs(path: str):
    """File system and bare path, for use inside a Python worker."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as there are cores; an input of fewer splits (small files of one row group) would keep most of them idle.

    A plan with exchanges is left alone: to ask it for its partitions would run it, and its last exchange decides.
    """
    if str(df._jdf.queryExecution().executedPlan().toString()).startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any file system that Spark knows; None if it is not there."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside and rename over, so that a reader sees the old text or the new one."""
    jvm = spark._jvm
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, p = _hadoop(spark, temp)
    fs.mkdirs(p.getParent())
    stream = fs.create(p, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(p), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)

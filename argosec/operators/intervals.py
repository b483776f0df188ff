"""Tree navigation over interval-encoded rows (path, ix, end_ix, parent_ix, kind, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BLOCK = 64  # places of a file that are one key of a join


def walk(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("path", "ix")


def find_by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def find_by_text(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.where(F.col("text") == text)


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(path, ix, d_ix): all nodes below each node of `of` (path, ix, end_ix).

    An equi-join on path and block with a range: a node lies in one block of places, and what is below a node in all blocks from its first to its last one. So
    each pair meets once, and a node is held against no more others in vain than begin or end in its block, however large the file.
    """
    blocks = F.sequence(F.expr(f"cast((ix + 1) div {BLOCK} as bigint)"), F.expr(f"cast(end_ix div {BLOCK} as bigint)"))
    a = of.where("end_ix > ix").select("path", "ix", "end_ix", F.explode(blocks).alias("block"))
    d = nodes.select("path", F.col("ix").alias("d_ix"), F.expr(f"cast(ix div {BLOCK} as bigint)").alias("block"))
    return a.join(d, ["path", "block"]).where("d_ix > ix and d_ix <= end_ix").select("path", "ix", "d_ix")


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(path, ix, a_ix, distance): all nodes above each node of `of`, the nearest at distance 1."""
    from pyspark.sql import Window

    up = descendants(of, nodes).select("path", F.col("d_ix").alias("ix"), F.col("ix").alias("a_ix"))
    spark = nodes.sparkSession
    up = up.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "ix")  # few bytes a row, so too few tasks would be left of them
    return up.select("path", "ix", "a_ix", F.row_number().over(Window.partitionBy("path", "ix").orderBy(F.col("a_ix").desc())).alias("distance"))


def find_calls(nodes: DataFrame, callee: str) -> DataFrame:
    """Calls with a direct child that is the name `callee`."""
    name = nodes.where((F.col("kind") == "identifier") & (F.col("text") == callee)).select("path", F.col("parent_ix").alias("ix"))
    return nodes.where("kind = 'call'").join(name, ["path", "ix"], "left_semi")

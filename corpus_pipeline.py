"""From documents to token ids: five stages, each over all that the stage before kept.

run(spark, sf_dir) writes the result of each stage to the shared folder and reads it again for the next; what a stage read or wrote on the way is
removed once its result is written.

Common to all stages: extra columns stay; texts of any length are taken whole; an empty table gives an empty one; decisions are taken on rows, so
rows of a null or repeated doc_id are neither lost nor let through with another one's decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from argosec.llm.op01_repeats import remove_repeats
from argosec.llm.op02_cube import mix
from argosec.llm.op03_simhash import deduplicate
from argosec.llm.op06_bpe import encode
from argosec.llm.op07_kneser_ney import keep_good
from argosec.llm.shared import drop_stash, stash_alone, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier keeps.

    Null, empty and token-less texts go; a null lang is a language of its own; repeated rows are judged alike and stay; a score equal to the threshold stays;
    without trusted labels all that have tokens stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id (of equal ones, of the least row hash; null last).

    Of repeated rows one stays; null, empty and word-less texts have no fingerprint and stay, each of them.
    """
    return deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place, by doc_id and word, has.

    Null, empty and short texts and rows of a null doc_id stay as they are; repeated rows are cut alike; a document of which nothing is left goes; n_chars is
    counted anew where text was cut.
    """
    return remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced draw that brings the sources to their target weights.

    A null source is one of its own; null and empty texts count as documents of 0 tokens; repeated rows are drawn together; rows have an order by hash, so there are no ties.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text.

    A null text gives null tokens, an empty one none; repeated rows are encoded each; columns named tokens or n_tokens are replaced.
    """
    return encode(docs, drop_text=True)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("source mixing", mixture),
    ("bpe encoding", tokens),
]

ORACLE_SQL = None  # hashing, suffix order and the random draw have no SQL; tests/llm holds run() against brute force, stage by stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stash_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            drop_stash(before)
    return docs

"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from argosec.llm import op09_chat
from argosec.llm import op10_threshold as op10_threshold_search
from argosec.llm.op01_repeats import repeats
from argosec.llm.op02_cube import mix
from argosec.llm.op03_simhash import near_duplicates
from argosec.llm.op04_pseudo import score
from argosec.llm.op05_projection import near_vectors
from argosec.llm.op06_bpe import encode
from argosec.llm.op07_kneser_ney import classify
from argosec.llm.op08_warc import round_trip
from argosec.llm.shared import table


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op2_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources meet their target weights in tokens and documents."""
    return mix(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, drop_text=True, verify=True)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_chat.render(table(spark, sf_dir, "conversations"))


def op4_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op5_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_threshold_search.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_cube": op2_cube,
    "op3_simhash": op3_simhash,
    "op4_pseudo": op4_pseudo,
    "op5_projection": op5_projection,
    "op6_bpe": op6_bpe,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_warc": op8_warc,
    "op9_chat": op9_chat,
    "op10_threshold": op10_threshold,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {"op9_chat": op09_chat.ORACLE, "op10_threshold": op10_threshold_search.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

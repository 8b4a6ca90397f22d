"""Queries of the operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm import chat, decontaminate, language, merkle, mixing, neighbours, quality, repeats, scoring, toxicity, trie, urls
from sensorloom.llm.common import table
from sensorloom.llm.simhash import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op1_neighbours, op2_scoring, op3_mixing, op4_language, op5_quality, op6_toxicity, op7_decontaminate, op8_simhash, op9_urls, op10_chat, op11_repeats, op12_trie, op13_merkle, decontaminated_texts)}
ORACLE_SQL |= {"op3_mixing": mixing.sql(), "op7_decontaminate": decontaminate.SQL, "op10_chat": chat.SQL, "op11_repeats": repeats.SQL, "op12_trie": trie.SQL, "op13_merkle": merkle.SQL, "decontaminated_texts": decontaminate.CLEANED_SQL}

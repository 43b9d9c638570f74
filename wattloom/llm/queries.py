"""Registered queries of this package, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattloom.llm import language, licenses, mixing, modelscore, packing, phrases, repeats, secrets, simhash, topk, toxicity, turns, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.digest(table(spark, sf, "documents"))


ORACLES["op1_mixing"] = mixing.ORACLE


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digest(table(spark, sf, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.predict(table(spark, sf, "documents"))


@query
def op10_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf, "embeddings"))


@query
def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.nearest_vectors(table(spark, sf, "embeddings"))


ORACLES["op9_topk"] = topk.ORACLE


@query
def op7_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return modelscore.scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


@query
def op11_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(table(spark, sf, "documents"))


ORACLES["op11_secrets"] = secrets.ORACLE


@query
def op12_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return turns.digest(table(spark, sf, "conversations"))


@query
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


ORACLES["op13_phrases"] = phrases.ORACLE

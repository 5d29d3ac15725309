"""A corpus pipeline in five stages over ``documents``: language ID, near-dedup, decontamination, mixing, sharding.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. Each is written as Parquet and read again before the next one starts.

Nulls and odd rows follow the operators: a document whose text is null or without letters has no
language and goes in the first stage, as do noise and languages that no other labelled text holds; null ids and sources pass through; a document the mix
takes twice is two rows from then on, each with a place of its own in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickscope.llm import decontam, langid, mixing, neardup, sharding
from tickscope.llm.common import prepare, stored

SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: without letters, of noise, or in a language not learned from other documents."""
    prepare(spark)
    return langid.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    prepare(spark)
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of ``benchmark`` go."""
    prepare(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    prepare(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mix goes: doc_id, source, size, text_crc32, law, shard, slot."""
    prepare(spark)
    return sharding.shard(docs, SHARDS)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: SQL can't express the trained language model; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs

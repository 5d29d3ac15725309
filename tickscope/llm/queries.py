"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, lines, lm, merkle, mixing, neardup, pii, rpforest, sharding, spelling, substring, warc
from .common import fold, prepare


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir), 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [_count(spans, kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return pii.detect_pii(_docs(spark, sf_dir), redacted=False).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs, ~held)
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return rpforest.embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf_dir))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))
    return lm.score(_docs(spark, sf_dir), ~held).select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"), F.round("score", 5).alias("score"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, (size, source_size, target, copies) = mixing.sample(_docs(spark, sf_dir).select("doc_id", "text", "source"), keep=["doc_id"])
    return out.select("doc_id", F.col(size).alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), (F.col(size) * F.col(copies)).cast("long").alias("taken"), F.col(copies).alias("copies"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(_docs(spark, sf_dir), claims={"text": tampered})


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pii, op3_decontamination, op4_substring, op5_embedding, op6_lines, op7_minhash, op8_lm, op9_langid, op10_mixing, op11_merkle, op12_warc, op13_spelling)}

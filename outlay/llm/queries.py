"""The corpus queries: each operator over its whole table, with its result's columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import align, chat, decontaminate, licenses, mixing, near_dedup, phrases, quality, secrets, sharding, topk, toxicity, warc
from outlay.llm.common import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(spark, docs, _table(spark, sf_dir, "labels"), ~_held_out(F.col("doc_id")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), toxicity.rejected().cast("int").alias("predicted"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents"), shingle=3, part=85)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.read_back(*chat.pack(spark, rows.unionByName(extra))))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(spark, _table(spark, sf_dir, "documents")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark, _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(spark, _table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.mix(spark, docs)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(spark, _table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return warc.read(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(spark, docs, _table(spark, sf_dir, "labels"), ~_held_out(F.col("doc_id")))
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("quality").alias("score"), quality.kept().cast("int").alias("predicted"))


def _hex(groups: str) -> str:
    return hashlib.sha256(groups.encode()).hexdigest() if groups else ""


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align.align(spark, _table(spark, sf_dir, "documents"), finish=_hex).documents
    return out.withColumnRenamed("groups", "groups_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_toxicity": op2_toxicity,
        "op3_near_dedup": op3_near_dedup,
        "op4_chat": op4_chat,
        "op5_secrets": op5_secrets,
        "op6_topk": op6_topk,
        "op7_sharding": op7_sharding,
        "op8_licenses": op8_licenses,
        "op9_mixing": op9_mixing,
        "op10_warc": op10_warc,
        "op11_quality": op11_quality,
        "op12_align": op12_align,
        "op13_phrases": op13_phrases,
    }

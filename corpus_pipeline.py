"""From raw documents to shards: toxicity, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage works on all that the one before it kept. ``run`` writes each stage's result as
Parquet below ``spark.checkpoint.dir`` and rereads it for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from outlay.llm.common import stored

SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from ``labels``, but for the fifth of ids that are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(spark, docs, labels, usable)
    score = "toxicity"
    while score in docs.columns:
        score = f"_{score}"
    return toxicity.score(docs, model, into=score).where(~toxicity.rejected(score)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8: that with the smallest id."""
    return near_dedup.keep_first(spark, docs, shingle=5, part=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontaminate.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight says."""
    return mixing.emit(mixing.mix(spark, docs)).select(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of each row."""
    return sharding.shard(spark, docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: SQL can express neither the classifier nor the search for passages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs

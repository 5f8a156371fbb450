"""Intermediate tables in the folder that all executors share: a lost executor takes no part of one with it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, one of our own if all runs on this machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='outlay-')}"
        context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``shared_dir``; what is there is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/outlay-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before us
        pass


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """The table written once and reread: cuts the lineage, fixes every value and lets several results share one computation.

    ``narrow``: rows are a few numbers each, so that a task may write several shuffle partitions one
    after the other, into one file instead of a tiny one for each.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if narrow:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, most_bytes: int = 32 << 20) -> bool:
    """Whether the rows of a stored table, as text, have at most ``most_bytes``: then it may be broadcast."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0) <= most_bytes

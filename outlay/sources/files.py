"""Exports in, views out."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_export(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A CSV export with a header; every column is text, so that codes keep their zeros."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', **options)


def peek(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Columns and number of rows of an export."""
    df = read_export(spark, path)
    return df.columns, df.count()


def for_output(df: DataFrame) -> DataFrame:
    """Decimals as doubles, flags as numbers, dates as ISO texts."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    casts = {"decimal": "double", "boolean": "int", "date": "string"}
    return df.withColumns({c: F.col(c).cast(casts[k]) for c, k in kinds.items() if k in casts})


def write_views(views: Mapping[str, DataFrame], directory: str, format_: str = "parquet") -> None:
    """Each view in a folder of its own, as Parquet or as CSV with a header."""
    for name, view in views.items():
        writer = for_output(view).write.mode("overwrite")
        if format_ == "csv":
            writer.csv(f"{directory}/{name}", header=True)
        else:
            writer.format(format_).save(f"{directory}/{name}")


def read_views(spark: SparkSession, directory: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{directory}/{n}") for n in names}


def write_json(df: DataFrame, path: str) -> None:
    """A record a line, nulls included."""
    for_output(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def config_from(text: str | None) -> dict:
    """A tenant's settings from JSON text; anything that is no object gives none."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}

"""Tables in folders by tenant and by the first digits of a hash of the row's key: reads and changes take the folders they need.

Each change of such a table writes new versions of the folders that it touches beside the old ones and then publishes them, all at
once, by adding lines to a small list. A reader takes the newest published version of each folder, so that a writer that
stops halfway leaves the table as it was.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

TENANT, PREFIX = "engagement_id", "key_prefix"
PARTS = f"{TENANT} string, {PREFIX} string"
#: Hexadecimal digits of a folder's prefix, and the most folders that a read names one by one.
DIGITS, MOST_NAMED = 1, 2000
VERSIONS = f"{PARTS}, version long, rows long"


def prefix(key: Column, digits: int = DIGITS) -> Column:
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, digits)


def read_table(spark: SparkSession, path: str | list[str], fields: str, base: str | None = None) -> DataFrame:
    """A table that is empty before something was written."""
    reader = spark.read.schema(fields)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], fields)


def folder_name(value: str | None) -> str:
    """A partition's value as Spark writes it into a folder's name."""
    if value is None or value == "":
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def touched(rows: DataFrame) -> list[Row] | None:
    """The folders (tenant, prefix) that rows belong to; none, if there are too many to name."""
    found = rows.select(TENANT, PREFIX).distinct().limit(MOST_NAMED + 1).collect()
    return found if len(found) <= MOST_NAMED else None


def read_folders(spark: SparkSession, path: str, fields: str, parts: list[Row] | None) -> DataFrame:
    """Rows of the named folders; other folders aren't even listed. ``parts`` none: all."""
    if parts is None:
        return read_table(spark, path, fields, path)
    if not parts:
        return spark.createDataFrame([], fields)
    by_tenant: dict[str | None, list[str]] = {}
    for p in parts:
        by_tenant.setdefault(p[TENANT], []).append(p[PREFIX])
    out = None
    for tenant, prefixes in by_tenant.items():  # a name without a folder is no fault: nothing has landed there yet
        mine = read_table(spark, f"{path}/{TENANT}={_quoted(folder_name(tenant))}/{PREFIX}={{{','.join(sorted(prefixes))}}}", fields, path)
        out = mine if out is None else out.unionByName(mine)
    return out


def _quoted(name: str) -> str:
    """A folder's name inside a path pattern."""
    return re.sub(r"([{}\[\]*?,\\])", r"\\\1", name)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The newest published version of each folder."""
    rows = read_table(spark, f"{path}/published", VERSIONS)
    return rows.groupBy(TENANT, PREFIX).agg(F.max("version").alias("version"), F.max_by("rows", "version").alias("rows"))


def _version_path(path: str, row: Row) -> str:
    return f"{path}/data/{TENANT}={_quoted(folder_name(row[TENANT]))}/{PREFIX}={row[PREFIX]}/version={row['version']}"


def read(spark: SparkSession, path: str, fields: str, tenants: list[str] | None = None, parts: list[Row] | None = None) -> DataFrame:
    """The table as published; of some tenants or folders only, if given. ``fields`` are without prefix and version.

    What is collected is the list of folders, as of any table's files.
    """
    known = versions(spark, path).where("rows > 0")
    if tenants is not None:
        known = known.where(F.col(TENANT).isin(tenants))
    if parts is not None:
        known = known.join(F.broadcast(spark.createDataFrame(parts, PARTS)), [TENANT, PREFIX], "left_semi") if parts else known.limit(0)
    paths = [_version_path(path, r) for r in known.collect()]
    every = f"{fields}, {PREFIX} string, version long"
    return (read_table(spark, paths, every, f"{path}/data") if paths else spark.createDataFrame([], every)).drop("version")


def _put(df: DataFrame, path: str, fields: str, version: int, parts: list[Row] | None) -> None:
    """Writes the rows as a version and publishes it for the folders they are in and for ``parts``."""
    spark = df.sparkSession
    columns = [c for c in spark.createDataFrame([], fields).columns if c != TENANT]
    df.select(*columns, TENANT, PREFIX, F.lit(version).alias("version")).write.mode("append").partitionBy(TENANT, PREFIX, "version").parquet(f"{path}/data")
    # counted from the files' footers
    paths = f"{path}/data/*/*/version={version}"
    written = read_table(spark, paths, f"{fields}, {PREFIX} string, version long", f"{path}/data").groupBy(TENANT, PREFIX).agg(F.count(F.lit(1)).alias("rows"))
    if parts is not None:
        written = spark.createDataFrame(parts, PARTS).join(written, [TENANT, PREFIX], "left")
    written.select(TENANT, PREFIX, F.lit(version).cast("long").alias("version"), F.coalesce("rows", F.lit(0).cast("long")).alias("rows")).coalesce(1).write.mode("append").parquet(f"{path}/published")


def create(df: DataFrame, path: str, fields: str, key: str, digits: int = DIGITS) -> None:
    """Writes a table's first version."""
    _put(df.withColumn(PREFIX, prefix(F.col(key), digits)), path, fields, 1, None)


def change(spark: SparkSession, path: str, fields: str, key: str, news: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], digits: int = DIGITS) -> list[Row]:
    """Changes the folders that ``news`` (with tenant and key) touches: ``apply(rows, news)`` gives their rows anew. Returns the folders.

    Other folders are neither read nor written. One writer at a time; a change whose writer was lost is repeated as if it hadn't begun.
    """
    last = versions(spark, path).agg(F.max("version")).first()[0] or 0
    found = touched(news.withColumn(PREFIX, prefix(F.col(key), digits)))
    if found is None:
        found = versions(spark, path).select(TENANT, PREFIX).collect()
    if not found:
        return []
    # a version's number is never used twice, though its writer may have been lost
    used = read_table(spark, f"{path}/data", f"{fields}, {PREFIX} string, version long", f"{path}/data").agg(F.max("version")).first()[0] or 0
    rows = read(spark, path, fields, parts=found)
    changed = apply(rows.drop(PREFIX), news).withColumn(PREFIX, prefix(F.col(key), digits))
    _put(changed, path, fields, max(last, used) + 1, found)
    return found

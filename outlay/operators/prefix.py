"""Running totals in falling order of a measure, without one window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands for each factor of e in the measure; with both signs a double has under 60,000 bands.
FINENESS = 40


def _band(value: Column) -> Column:
    """Falls as the value grows; equal values share a band."""
    size = F.floor(F.log(F.abs(value)) * FINENESS)
    return F.when(value > 0, 100_000 - size).when(value == 0, 200_000).otherwise(300_000 + size)


def with_running(rows: DataFrame, value: str, tie: str, keys: tuple[str, ...] = (), share_ties: bool = False) -> DataFrame:
    """Adds ``before``, ``until`` and ``rank`` in falling order of ``value``, ties by ``tie``, and ``all_value``, within ``keys``.

    Rows are grouped in bands of the value's magnitude. Each band is summed in its own window, and one row a
    band (a bounded number in each of ``keys``) carries what stands before it. With ``share_ties``
    rows of equal value all have the sum including each of them.
    """
    rows = rows.withColumn("_band", _band(F.col(value).cast("double")))
    inside = Window.partitionBy(*keys, "_band").orderBy(F.desc(value), F.col(tie).asc_nulls_first())
    equal = Window.partitionBy(*keys, "_band").orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, 0)
    over_bands = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_band").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_count"))
    sums = sums.select(
        *keys, "_band",
        F.coalesce(F.sum("_sum").over(over_bands), F.lit(0)).alias("_base"), F.coalesce(F.sum("_count").over(over_bands), F.lit(0)).alias("_rows"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("all_value"), F.sum("_count").over(Window.partitionBy(*keys)).alias("all_rows"),
    )
    joined = rows.join(sums.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumnRenamed("_band", "_of_band"), _same(keys), "inner")
    until = F.sum(value).over(equal if share_ties else inside.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = joined.withColumns({"until": F.col("_base") + until, "before": F.col("_base") + before, "rank": F.col("_rows") + F.row_number().over(inside)})
    return out.drop("_band", "_of_band", "_base", "_rows", *[f"_{k}" for k in keys])


def _same(keys: tuple[str, ...]) -> Column:
    out = F.col("_band") == F.col("_of_band")
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out

"""Exact quantiles in bounded memory: ranges of values are counted first, then only the ranges that hold the asked-for ranks are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlay.operators.joins import look_up
from outlay.sources.scratch import stored

#: Ranges for each doubling of a value: a range is about one per cent wide.
RANGES = 64


def _range(value: Column) -> Column:
    """A number that never falls as the value grows."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * RANGES)).cast("int")


def exact(df: DataFrame, key: str, value: Column, at: dict[str, float]) -> DataFrame:
    """A row a key (nulls left out): ``least``, ``most``, ``rows`` of its values and, by name, the quantiles ``at`` (0 to 1), linear between two values.

    A group's ranges are some thousands at most, whatever its rows. Of the second pass, only values of the at most two ranges of a
    quantile are kept apart, each with its count.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), value.cast("double").alias("value")).where("value is not null and not isnan(value)").withColumn("range", _range(F.col("value")))
    counted = rows.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    order = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    ranges = counted.select("key", "range", "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("rows"), F.min("low").over(whole).alias("least"), F.max("high").over(whole).alias("most"))
    ranges = stored(ranges, "ranges", narrow=True)
    place = lambda q: (F.col("rows") - 1) * F.lit(float(q))
    ranks = F.array(*[f(place(q)).cast("long") for q in at.values() for f in (F.floor, F.ceil)])
    inside = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    asked = stored(ranges.withColumn("ranks", F.array_distinct(F.filter(ranks, inside))).where(F.size("ranks") > 0).select(F.struct("key", "range").alias("place"), "before", "ranks"), "asked", narrow=True)
    # a key's few asked-for ranges
    kept = look_up(rows.select(F.struct("key", "range").alias("place"), "value"), asked, "place").where("ranks is not null")
    values = kept.groupBy("place", "value").agg(F.first("before").alias("before"), F.first("ranks").alias("ranks"), F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("place").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("from", F.col("before") + F.coalesce(F.sum("n").over(running), F.lit(0)))
    hit = F.filter("ranks", lambda r: (r >= F.col("from")) & (r < F.col("from") + F.col("n")))
    found = values.select(F.col("place.key").alias("key"), "value", F.explode(hit).alias("rank"))
    listed = found.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("of"))
    totals = ranges.select("key", "least", "most", "rows").distinct()

    def between(q: float) -> Column:
        low, high = (F.col("of")[f(place(q)).cast("long")] for f in (F.floor, F.ceil))
        return low + (high - low) * (place(q) - F.floor(place(q)))

    return totals.join(listed, "key").select(F.col("key").alias(key), "least", *[between(q).alias(name) for name, q in at.items()], "most", "rows")

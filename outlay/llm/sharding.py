"""Minimax contiguous partition: the smallest shard capacity that a greedy walk over ordered groups can meet."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.common import spread_join, stored, with_totals_before

#: Cells that one look at the prefix sums may bring to the driver, and by how much each further look is finer.
CELLS = 1 << 14
FINER = 32


def _greedy(bounds: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards when each takes as much as ``capacity`` allows; None if ``shards`` don't reach the end."""
    cuts, at = [], bounds[0]
    for _ in range(shards):
        to = bounds[bisect.bisect_right(bounds, at + capacity) - 1]
        cuts.append(to)
        at = to
        if at == bounds[-1]:
            return cuts + [at] * (shards - len(cuts))
    return None


def smallest_capacity(bounds: list[int], shards: int, low: int = 0) -> tuple[int, list[int]]:
    """Binary search over capacities; ``bounds`` are prefix sums from 0 to the total, in order."""
    low, high = max(low, -(-(bounds[-1] - bounds[0]) // shards)), bounds[-1] - bounds[0]
    while low < high:
        middle = (low + high) // 2
        if _greedy(bounds, middle, shards):
            high = middle
        else:
            low = middle + 1
    return high, _greedy(bounds, high, shards)


def _bounds(groups: DataFrame, width: int, near: list[tuple[int, int]] | None) -> set[int]:
    """First and last start and last end of the groups that start in each cell of ``width``, inside ``near``."""
    if near is not None:
        where = F.lit(False)
        for a, b in near:
            where = where | F.col("start").between(a, b)
        groups = groups.where(where)
    cells = groups.groupBy(F.floor(F.col("start") / width)).agg(F.min("start"), F.max("start"), F.max(F.col("start") + F.col("group_size")))
    return {int(x) for row in cells.collect() for x in row[1:]}


def cut_points(groups: DataFrame, total: int, shards: int) -> list[int]:
    """Ends (as prefix sums) of ``shards`` contiguous shards whose largest is as small as can be.

    ``groups`` has ``start`` (what stands before) and ``group_size``. The driver sees only
    bounds of at most ``CELLS`` or so cells at a time: with cells of width w, the best cut
    among the bounds seen is within w of the best of all, so that only cells near a possible
    cut are looked at again with a width ``FINER`` times smaller, until a cell is one unit.
    """
    width = max(1, total // CELLS)
    seen = _bounds(groups, width, None) | {0, total}
    while True:
        bounds = sorted(seen)
        best, cuts = smallest_capacity(bounds, shards)
        if width == 1:
            return cuts
        least = max(0, best - width)
        low, at = [], 0
        for _ in cuts:  # no cut of a capacity from ``least`` on is before these
            at = bounds[bisect.bisect_right(bounds, at + least) - 1]
            low.append(at)
        near = [(a - width, c + (i + 1) * width) for i, (a, c) in enumerate(zip(low, cuts, strict=True))]
        width = max(1, width // FINER)
        seen |= _bounds(groups, width, near)


def shard(spark: SparkSession, docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of each document.

    Size: UTF-8 bytes of the text (null: none) plus 1. Groups: equal texts (all null texts are
    one group), never split; they stand in the order of their smallest id (null ids first) and
    shards are contiguous in that order. Slots are gapless from 0 in each shard. crc32 of a null
    text is null. Repeated rows each count. Later shards stay empty if there are fewer groups than
    shards. Other columns of ``docs`` play no part.
    """
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("group_key"))
    rows = stored(spark, rows, "sizes")
    groups = rows.groupBy("group_key").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("group_rows"))
    placed = with_totals_before(spark, groups, ["first_id", "group_key"], {"start": F.col("group_size"), "rows_before": F.col("group_rows")})
    total = placed.agg(F.sum("group_size")).first()[0]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts = cut_points(placed, int(total), shards)
    number = sum((F.when(F.col("start") >= c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    placed = placed.withColumn("shard", number.cast("int"))
    heads = placed.groupBy("shard").agg(F.min("rows_before").alias("shard_before"))  # one row a shard
    # all copies of one text, or all null texts, are one key
    known = placed.join(F.broadcast(heads), "shard").select("group_key", "first_id", "shard", "rows_before", "shard_before", "group_rows", F.col("group_rows").alias("uses"))
    met = stored(spark, spread_join(rows, stored(spark, known, "groups"), "group_key", "uses", ["doc_id", "size"]), "grouped")
    single = met.where("group_rows = 1").withColumn("slot", F.col("rows_before") - F.col("shard_before"))
    copies = with_totals_before(spark, met.where("group_rows > 1"), ["first_id", "group_key", "doc_id"], {"at": F.lit(1)})
    first = stored(spark, copies.groupBy("group_key").agg(F.min("at").alias("group_at"), F.count(F.lit(1)).alias("uses")), "firsts")
    copies = spread_join(copies, first, "group_key", "uses", ["doc_id", "at"]).withColumn("slot", F.col("at") - F.col("group_at") + F.col("rows_before") - F.col("shard_before"))
    names = ["doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")]
    return single.select(*names).unionByName(copies.select(*names))

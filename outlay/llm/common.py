"""Pieces shared by the corpus operators: joins that spare rows or split hot keys, prefix sums, word hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.sources import scratch

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate; it is deleted when the driver ends."""
    return scratch.new_folder(spark, name)


def stored(spark: SparkSession, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """See ``scratch.stored``."""
    return scratch.stored(df, name, narrow)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Places of the bit map of ``likely_among``: 8 MB in 2049 rows, however many keys there are.
PLACES = 1 << 26


def likely_flag(df: DataFrame, key: str, keys: DataFrame, into: str) -> DataFrame:
    """``df`` with ``into``: whether its ``key`` may be among ``keys`` (its first column): true for all that are, and for few others while keys are fewer than ``PLACES``.

    No row is moved: what is broadcast is a bit map with a fixed bound. With very many keys it is true for all rows.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PLACES))
    part, bits = fresh(df, "part_no"), fresh(df, "bits")
    placed = keys.select(place(F.col(keys.columns[0])).alias("place"))
    marked = placed.groupBy(F.bitmap_bucket_number("place").alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(bits))
    own = F.bitmap_bit_position(place(df[key]))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(own / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = df.withColumn(part, F.bitmap_bucket_number(place(df[key]))).join(F.broadcast(marked), part, "left")
    return out.withColumn(into, F.coalesce(F.getbit(byte, (own % 8).cast("int")) == 1, F.lit(False))).select(*df.columns, into)


def likely_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` for which ``likely_flag`` is true. Put before a semi-join, so that wide rows that it drops are not shuffled."""
    into = fresh(df, "likely")
    return likely_flag(df, key, keys, into).where(into).select(*df.columns)


#: A key is hot if it has more than one in so many of all rows; so there are fewer hot keys than this.
HOT = 1000


def spread_join(many: DataFrame, one: DataFrame, key: str, uses: str, by: list[str], how: str = "inner") -> DataFrame:
    """``many`` with the row of ``one`` (a stored table, a row a key) that has its ``key``; ``one``'s column ``uses`` says how many rows of ``many`` have it.

    Rows of hot keys are dealt over all shuffle partitions by a hash of ``by``, and ``one``'s row for such a
    key is copied to each, so that no task gets a hot key whole. Only the hot keys (under ``HOT``) are broadcast.
    """
    spark = many.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = one.agg(F.sum(uses)).first()[0] or 0
    is_hot = F.col(uses) * HOT > F.lit(int(total))
    hot, salt = fresh(many, "is_hot"), fresh(many, "salt_no")
    listed = one.where(is_hot).select(key, F.lit(True).alias(hot))
    if total < HOT or listed.isEmpty():
        return many.join(one.drop(uses), key, how)
    dealt = many.join(F.broadcast(listed), key, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0)).drop(hot)
    copies = one.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies.drop(uses), [key, salt], how).drop(salt)


def with_totals_before(spark: SparkSession, df: DataFrame, order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Add, for each of ``totals``, the sum over all rows that stand before a row in ``order``.

    Two passes instead of one global window: rows are dealt out by ranges of ``order``, each
    range is summed inside its own task, and only one row a range (as many as shuffle
    partitions) is accumulated globally. ``order`` should tell rows apart: ties get some
    order, fixed once the ranges are written. The result is a stored table.
    """
    part = fresh(df, "range_id")
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in order]
    values = {fresh(df, f"value_{k}"): v for k, v in totals.items()}
    dealt = stored(spark, df.withColumns(values).repartitionByRange(ranges, *keys).withColumn(part, F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    over_ranges = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    names = list(zip(totals, values, strict=True))
    sums = dealt.groupBy(part).agg(*[F.sum(v).alias(f"sum_{v}") for _, v in names])
    sums = sums.select(part, *[F.coalesce(F.sum(f"sum_{v}").over(over_ranges), F.lit(0)).alias(f"base_{v}") for _, v in names])
    local = dealt.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in names})
    # one row a range: bounded by the number of shuffle partitions
    out = local.join(F.broadcast(sums), part).withColumns({n: F.col(n) + F.col(f"base_{v}") for n, v in names})
    return stored(spark, out.select(*df.columns, *totals), "totals")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 1 << 16

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs without ASCII white space, A-Z lower-cased."""
    return text.lower().split() if text else []


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    out = np.full(n - size + 1, 0x9E3779B97F4A7C15 * size & (2**64 - 1), np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + each[j : n - size + 1 + j]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)

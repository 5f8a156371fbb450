"""Joins of a large table with one that has a row a key, without a task that gets all rows of a common key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.sources.scratch import is_small, stored

#: A key is common if it has more than one in so many of all rows; so there are fewer common keys than this.
COMMON = 1000
#: Shares that all rows would make for each shuffle partition: a common key gets its part of them.
SHARES = 32


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` for a join that never broadcasts: Spark goes by compressed bytes, of files even before rows are multiplied, and a table that grows with the input would be unpacked in the driver."""
    return table.hint("merge")


def look_up(df: DataFrame, table: DataFrame, key: str | list[str], most_bytes: int = 32 << 20, common: bool = True, small: bool | None = None) -> DataFrame:
    """``df`` with the row of ``table`` (a row a key) that has its key, if any.

    A table of a checked size is broadcast, so that ``df`` stays where it is. With a larger one both are shuffled,
    rows of common keys and rows without a key dealt over all tasks (see ``spread``). ``common`` false: keys are known to be rare.
    ``small``: given for a table that is stored and whose size was checked.
    """
    keys = [key] if isinstance(key, str) else key
    if small is None:
        table = stored(table, "look-up")
        small = is_small(table, most_bytes)
    if small:
        return df.join(F.broadcast(table), keys, "left")
    return spread(df, table, keys) if common else df.join(table, keys, "left")


def stored_kinds(tables: dict[str, DataFrame], most_bytes: int = 32 << 20) -> dict[str, tuple[DataFrame, bool]]:
    """Several tables of the same columns, written as one and measured in one go: of each the stored table and whether it is small."""
    every = None
    for kind, table in tables.items():
        marked = table.withColumn("kind", F.lit(kind))
        every = marked if every is None else every.unionByName(marked)
    every = stored(every, "look-ups", narrow=True)
    size = F.sum(F.octet_length(F.to_json(F.struct(*every.columns))))
    sizes = {r.kind: r.bytes for r in every.groupBy("kind").agg(size.alias("bytes")).collect()}  # a row a kind
    return {kind: (every.where(F.col("kind") == kind).drop("kind"), sizes.get(kind, 0) <= most_bytes) for kind in tables}


def _dealt(df: DataFrame, salts: Column) -> Column:
    """A number for each row from its values, the same whenever the row is made again."""
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*plain), salts).cast("int")


def spread(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """A left join by shuffle. Keys of ``df`` are counted first (added up before they are shuffled); rows of the common ones, and
    those without a key, are dealt into shares, as many as their part of all rows asks for, and ``table``'s row of a common key is copied to each. What is
    broadcast are the common keys alone, fewer than ``COMMON``; copies are fewer than shuffle partitions times ``SHARES`` and common keys.
    """
    taken = {c.lower() for c in (*df.columns, *table.columns)}
    salt, shares = (next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n not in taken) for name in ("salt", "shares"))
    most = SHARES * max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    counts = stored(df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "key-counts", narrow=True)
    total = counts.agg(F.sum("rows")).first()[0] or 0
    parts = F.ceil(F.col("rows") * most / F.lit(max(total, 1))).cast("int")
    common = counts.where((F.col("rows") * COMMON > total) & (F.col("rows") > 1)).select(*keys, parts.alias(shares))
    own = df.join(F.broadcast(common), keys, "left").withColumn(salt, F.when(~known, _dealt(df, F.lit(most))).otherwise(F.coalesce(_dealt(df, F.col(shares)), F.lit(0)))).drop(shares)
    copies = table.join(F.broadcast(common), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(shares, F.lit(1)) - 1))).drop(shares)
    return own.join(copies, [*keys, salt], "left").drop(salt)

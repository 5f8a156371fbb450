"""Mixing sources to target weights: repetition rates and hash-seeded copies, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.common import WORD, with_totals_before


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on ``seed`` and ``key`` alone, so that reruns agree."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def source_targets(spark: SparkSession, sizes: DataFrame, source_col: str, size_col: str, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.

    Sources in code-point order (null last) weigh ``cycle``, repeated. The targets share the
    sum of all sizes by weight; a target stops at ``cap`` times its source's size and what is
    over goes to the others by weight, until none is above. That is a water level: with the
    sources ordered by cap / weight, the level is the first one that the next source can hold;
    from there on what would be left for each unit of weight only falls, so it is the largest such.
    Sums run over ranges, not in one task, so the number of sources may be large.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    per = per.withColumn("last", F.col("source").isNull())
    ranked = with_totals_before(spark, per, ["last", "source"], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("full_at", F.col("source_size") * cap / F.col("weight"))
    below = with_totals_before(spark, ranked, ["full_at", "rank"], {"capped": F.col("source_size") * cap, "weights": F.col("weight")})
    all_of = below.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))
    # ``all_of`` and ``level`` have one row each
    level = (
        below.join(F.broadcast(all_of))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weights") - F.col("weights")))
        .where(F.col("level") <= F.col("full_at"))
        .agg(F.max("level").alias("level"))
    )
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("weight"))
    return below.join(F.broadcast(level)).select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: int = 7,
) -> DataFrame:
    """``row`` (a row of ``docs`` as a struct, so that no name in it can clash), ``size``, ``source_size``, ``target`` and ``copies``.

    The rate of a source is target / size. Each document gets floor(rate) copies plus one
    more with a probability equal to the fraction, decided by a hash of the seed and its id;
    it never gets more than ``cap``. Null or empty text: size 0. Null source: a source of
    its own, last. Null ids share one coin. Repeated rows each count and get the same
    copies. An empty table stays empty. Texts are counted twice, once for the sources' sums: that is cheaper
    than to write them all down with their sizes.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("mix_source"), word_count(docs[text_col]).alias("size"))
    targets = source_targets(spark, rows.select("mix_source", "size"), "mix_source", "size", cycle, cap)
    # one row a source, with its name, a size and a target; Spark broadcasts it only below its own size limit
    out = rows.join(targets, rows["mix_source"].eqNullSafe(targets["source"]), "left")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    extra = F.when(coin(F.col("row")[id_col], seed) < rate - F.floor(rate), 1).otherwise(0)
    return out.select("row", "size", "source_size", "target", F.least(F.floor(rate) + extra, F.lit(cap)).cast("int").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as ``copies`` says, with its own columns."""
    out = mixed.where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("row.*")

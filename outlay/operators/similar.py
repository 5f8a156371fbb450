"""Which names are worth comparing: an exact similarity join by rare words and by cells of alike letters.

A composite of at least ``t`` needs a ratio, of the sorted words or of the word sets, of at least ``y = (t - 0.2) / 0.8``.
Such a ratio comes about in one of two ways, each an equi-join:

* the shared words are a large part of one of the names: then one of that name's rarest words is shared;
* the letters in common are many: names are routed to those cells of suppliers whose ranges of letter counts allow it.

A pair that neither brings together can't reach ``t``, so none is lost. Where ``near`` finds a supplier first, its score is the
name's own ``t`` (column ``floor``), so that where all names are alike few are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlay.functions import fuzzy
from outlay.operators.joins import shuffled

#: Suppliers of a cell, about; those of a block that is compared at once; names that meet a block together.
CELL, BLOCK, NAMES = 1024, 2048, 512
#: Suppliers that the cells' borders are drawn from (all are dealt into the cells), and the most cells.
SAMPLE, MOST_CELLS = 20_000, 4096
#: Names under a word that meet one task's share of its suppliers.
POSTINGS = 1000


def needed_ratio(least: float) -> float:
    return max(0.0, (least - 0.2) / 0.8)


def _measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts and size of the sorted words; whether a word is repeated."""
    _, words, sets = fuzzy.forms_of(texts)
    return np.column_stack([fuzzy.letter_counts(words), np.fromiter(map(len, words), np.int32, len(words))]), np.array([len(a) != len(b) for a, b in zip(words, sets, strict=True)], bool)


@dataclass
class Cells:
    """A tree of borders (column, highest value of the left side, left, right; a cell where the column is -1), and of each cell the
    lowest and highest letter counts and sizes, and whether a supplier of it repeats a word."""

    tree: np.ndarray
    low: np.ndarray
    high: np.ndarray
    repeats: np.ndarray
    sizes: np.ndarray

    def place(self, measures: np.ndarray) -> np.ndarray:
        node = np.zeros(len(measures), np.int64)
        while True:
            column = self.tree[node, 0]
            inner = np.flatnonzero(column >= 0)
            if not len(inner):
                return self.tree[node, 1]
            left = measures[inner, column[inner]] <= self.tree[node[inner], 1]
            node[inner] = np.where(left, self.tree[node[inner], 2], self.tree[node[inner], 3])

    def within_reach(self, text: str, ratio: float) -> list[int]:
        """Cells with a supplier that may have ``ratio`` (0 to 1) with a text, by letters alone."""
        counts, repeats = _measures([text])
        if repeats[0] or ratio <= 0:
            return np.flatnonzero(self.sizes > 0).tolist()
        own, size = counts[0, :-1], int(counts[0, -1])
        most = np.minimum(own, self.high[:, :-1]).sum(axis=1)
        extra = np.maximum(self.low[:, :-1] - own, 0).sum(axis=1)  # letters that each supplier of the cell has besides
        best = np.clip(np.minimum(most, size) + extra, self.low[:, -1], self.high[:, -1])
        common = np.minimum(np.minimum(most, size), best - extra)
        reach = 2.0 * common >= (ratio - 1e-9) * np.maximum(size + best, 1)
        return np.flatnonzero((self.sizes > 0) & (reach | self.repeats)).tolist()


def _borders(measures: np.ndarray, cells: int) -> np.ndarray:
    """Halve the sample at the median of the column that differs most, until there are ``cells``."""
    tree: list[list[int]] = []
    count = 0

    def grow(rows: np.ndarray, share: int) -> int:
        nonlocal count
        me = len(tree)
        tree.append([-1, 0, 0, 0])
        spread = rows.var(axis=0) if len(rows) > 1 else np.zeros(rows.shape[1])
        column = int(spread.argmax())
        if share > 1 and spread[column] > 0:
            value = int(np.median(rows[:, column]))
            if value == rows[:, column].max():
                value -= 1
            left = rows[:, column] <= value
            tree[me] = [column, value, grow(rows[left], share // 2), grow(rows[~left], share - share // 2)]
        else:
            tree[me] = [-1, count, 0, 0]
            count += 1
        return me

    grow(measures, cells)
    return np.array(tree, np.int64)


def cells_of(known: DataFrame, column: str = "candidate") -> Cells:
    """Cells for the texts of a stored table. Borders come from ``SAMPLE`` texts at most, ranges from all of them.

    What is collected are ranges: a row for each cell (``MOST_CELLS`` at most) and letter.
    """
    total = known.count()
    wanted = min(MOST_CELLS, max(1, total // CELL))
    sample = [r[0] for r in known.select(column).orderBy(F.xxhash64(column), column).limit(SAMPLE).collect()] if wanted > 1 else []
    tree = _borders(_measures(sample)[0], wanted) if sample else np.array([[-1, 0, 0, 0]], np.int64)
    n, width = int((tree[:, 0] < 0).sum()), fuzzy.BINS + 1
    cells = Cells(tree, np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.zeros(n, bool), np.zeros(n, np.int64))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full((n, width), 1 << 30, np.int64), np.full((n, width), -1, np.int64)
        sizes, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            measures, repeated = _measures(batch.column(0).to_pylist())
            at = cells.place(measures)
            np.minimum.at(low, at, measures)
            np.maximum.at(high, at, measures)
            np.add.at(sizes, at, 1)
            np.add.at(repeats, at, repeated)
        own = np.flatnonzero(sizes)
        each = [np.repeat(own, width), np.tile(np.arange(width), len(own)), low[own].ravel(), high[own].ravel(), np.repeat(sizes[own], width), np.repeat(repeats[own], width)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in each], ["cell", "measure", "low", "high", "size", "repeats"])

    found = known.select(column).mapInArrow(ranges, "cell long, measure long, low long, high long, size long, repeats long")
    for r in found.groupBy("cell", "measure").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("size").alias("size"), F.sum("repeats").alias("repeats")).collect():
        cells.low[r.cell, r.measure], cells.high[r.cell, r.measure] = r.low, r.high
        cells.sizes[r.cell], cells.repeats[r.cell] = r["size"], r.repeats > 0
    return cells


def _over_all(df: DataFrame, *keys: str) -> DataFrame:
    """A number of tasks given, so that few rows aren't put into one: each is much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _with_floor(names: DataFrame, least: float) -> DataFrame:
    return names if "floor" in names.columns else names.withColumn("floor", F.lit(least))


def _fewer(texts: pa.Array) -> pa.Array:
    rows = [None if t is None or len(t) > fuzzy.BITS else fuzzy.forms_of([t])[1][0] for t in texts.to_pylist()]
    return pa.array([None if t is None else sorted({t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}) for t in rows], pa.list_(pa.string()))


def near(names: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Some suppliers that become a name by one letter left out and one put in, with their scores: name, score, supplier.

    They only tell what the best has to reach, so each text with a letter less brings the first supplier that has it, and long names none.
    """
    keys = lambda c: F.explode(F.arrow_udf(_fewer, T.ArrayType(T.StringType()))(c)).alias("key")
    others = known.select("candidate", "canonical_supplier_id", keys(F.col("candidate"))).withColumn("key", F.xxhash64("key"))
    others = others.groupBy("key").agg(F.min(F.struct("candidate", "canonical_supplier_id")).alias("supplier"))
    pairs = names.select("name", keys(F.col("name"))).withColumn("key", F.xxhash64("key")).join(shuffled(others), "key").select("name", "supplier").distinct()
    scored = _over_all(pairs, "name", "supplier").withColumn("score", fuzzy.fuzzy_score("name", F.col("supplier.candidate"), F.lit(least)))
    return scored.where(F.col("score").isNotNull()).select("name", "score", "supplier")


def by_letters(names: DataFrame, known: DataFrame, cells: Cells, least: float) -> DataFrame:
    """Of each name (column ``name``) the best candidates of the cells in its reach, one for each block: name, score, supplier. What is below ``floor``, if there is such a column, isn't found."""
    sizes = cells.sizes

    def reach(texts: pa.Array, floors: pa.Array) -> pa.Array:
        return pa.array([cells.within_reach(t, needed_ratio(f)) for t, f in zip(texts.to_pylist(), floors.to_pylist(), strict=True)], pa.list_(pa.int64()))

    def place(texts: pa.Array) -> pa.Array:
        return pa.array(cells.place(_measures(texts.to_pylist())[0]) if len(texts) else [], pa.int64())

    parts = F.element_at(F.lit((-(-np.maximum(sizes, 1) // BLOCK)).tolist()), (F.col("cell") + 1).cast("int"))
    blocks = known.withColumn("cell", F.arrow_udf(place, T.LongType())(F.col("candidate"))).withColumn("part", F.pmod(F.xxhash64("candidate"), parts))
    blocks = blocks.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("candidate", "canonical_supplier_id"))).alias("block"))
    names = _with_floor(names, least)
    routed = _over_all(names, "name").select("name", "floor", F.explode(F.arrow_udf(reach, T.ArrayType(T.LongType()))("name", "floor")).alias("cell"))
    share = max(1, names.count() // NAMES)
    grouped = routed.groupBy("cell", F.pmod(F.xxhash64("name"), F.lit(share)).alias("share")).agg(F.collect_list(F.struct("name", "floor")).alias("names"))
    pairs = _over_all(grouped.join(shuffled(blocks), "cell"), "cell", "part", "share")
    found = pairs.withColumn("found", F.explode(fuzzy.fuzzy_best(F.col("names.name"), F.col("block.candidate"), F.col("names.floor"))))
    return found.select(F.col("found.name").alias("name"), F.col("found.score").alias("score"), F.element_at("block", F.col("found.at") + 1).alias("supplier"))


def _split(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else sorted(set(t.split())) for t in texts.to_pylist()], pa.list_(pa.string()))


def by_words(names: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs whose shared words are a large part of one side, with the score where it reaches ``least``: name, score, supplier.

    Each side's rarest words, as many as can't all be missing, meet all words of the other side. A word's suppliers are split
    into shares of about ``POSTINGS``, each of which the names meet apart.
    """
    split = F.arrow_udf(_split, T.ArrayType(T.StringType()))
    each = lambda df, text, *more: df.withColumn("words", split(F.col(text))).select(F.col(text), *more, F.explode("words").alias("word"), (F.length(F.array_join("words", " "))).alias("letters"))
    own, others = each(_with_floor(names, least), "name", "floor"), each(known, "candidate", "canonical_supplier_id")
    count = own.select("word", F.lit(0).alias("other")).unionByName(others.select("word", F.lit(1).alias("other")))
    count = count.groupBy("word").agg(F.count(F.lit(1)).alias("often"), F.sum("other").alias("others")).where((F.col("others") > 0) & (F.col("often") > F.col("others")))
    # of a side's letters, at most so many are in words that aren't shared
    y = F.greatest(F.lit(0.0), (F.col("floor") - 0.2) / 0.8)
    missing = 1 - y / (2 - y) + 1e-9

    def ranked(df: DataFrame, key: list[str]) -> DataFrame:
        rows = df.join(shuffled(count), "word", "left")
        entry = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word", "others")
        listed = rows.groupBy(*key, "letters").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        before = lambda i: F.aggregate(F.slice("entries", 1, i), F.lit(0), lambda s, e: s + F.length(e["word"]) + 1)
        marked = F.transform("entries", lambda e, i: F.struct(e["word"].alias("word"), e["others"].alias("others"), (before(i) / F.col("letters")).alias("rarer")))
        out = listed.select(*key, F.explode(marked).alias("e")).select(*key, "e.*").where(F.col("others") > 0)
        return out.withColumn("shares", F.ceil(F.col("others") / POSTINGS).cast("int")).drop("others")

    # a name meets all shares of a word's suppliers, so only words that may pair it are multiplied
    every_share = lambda df: df.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    left = ranked(own, ["name", "floor"]).withColumn("missing", missing).withColumnRenamed("rarer", "rarer_name")
    right = ranked(others, ["candidate", "canonical_supplier_id"]).withColumn("share", F.pmod(F.xxhash64("candidate"), F.col("shares")).cast("int")).drop("shares")
    # one join for each side's rare words: a common word that is rare on neither side pairs nothing
    lowest = needed_ratio(least)
    rare = right.where(F.col("rarer") <= 1 - lowest / (2 - lowest) + 1e-9)
    own_rare = every_share(left.where("rarer_name <= missing")).join(shuffled(right), ["word", "share"])
    others_rare = left.where("rarer_name > missing").join(shuffled(rare.select("word").distinct()), "word", "left_semi")
    others_rare = every_share(others_rare).join(shuffled(rare), ["word", "share"]).where("rarer <= missing")
    pairs = own_rare.unionByName(others_rare).select("name", "candidate", "canonical_supplier_id").distinct()
    scored = _over_all(pairs, "name", "candidate").withColumn("score", fuzzy.fuzzy_score("name", "candidate", F.lit(least))).where(F.col("score").isNotNull())
    return scored.select("name", "score", F.struct("candidate", "canonical_supplier_id").alias("supplier"))


def first_of(found: DataFrame) -> DataFrame:
    """The best of each name, of equals the first by supplier name, then id: name, score, supplier."""
    best = found.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("below"), F.col("supplier.candidate").alias("candidate"), F.col("supplier.canonical_supplier_id").alias("canonical_supplier_id"))).alias("best"))
    return best.select("name", (-F.col("best.below")).alias("score"), F.struct("best.candidate", "best.canonical_supplier_id").alias("supplier"))

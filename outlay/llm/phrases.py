"""Collocations: phrases that occur often, scored by how much of their parts they explain, without those inside longer ones.

*Sketches.* A task counts hashes of n-grams in a count-min sketch whose cells stop at the least frequency asked for, a byte
each; the sketches are summed block by block, and a bit a cell says whether the sum reaches it. A cell is never below what
any of its n-grams counts, so nothing frequent is lost. The first sketch has single words and pairs, the
second longer n-grams whose pairs all passed the first.

*Exact counts.* A second pass takes the n-grams whose parts and self pass the sketches, tells them apart by their words (not by
hashes), adds them up inside the task and then by Spark. What is then below the least frequency goes.

*Scores.* Each phrase is joined with the counts of the two parts of each of its cuts; a phrase inside a longer one that takes
most of its occurrences goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.common import spread_join, stored

#: What ends a piece, what parts words, and the language of texts without one.
ENDS, GAPS, NO_LANG = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09", "und"
SPACE, BREAK = 0x20, 0xFF  # a byte that UTF-8 never has
_TABLE = bytes(BREAK if b in ENDS else SPACE if b in GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that are handled at once, and of those whose words are hashed at once.
CHUNK, HASHED = 2 << 20, 1 << 19
#: Rows of a sketch, cells of a block of it; bytes of text for a cell, and the fewest and the most cells of a row as powers of 2.
ROWS, BLOCK, PER_CELL, FEWEST, MOST = 2, 1 << 16, 50, 16, 25
#: Rows that a task adds up at a time, and the most sums it holds before it sends them on.
ADDED, MOST_ADDED = 200_000, 1_000_000
#: Blocks of a sketch, and sums, that are sent at once.
SENT, ROWS_SENT = 32, 20_000
#: Shares of a language's phrases that are ranked apart before they are ranked together.
SHARES = 16
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_ODD = [np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of some texts: where each stands in ``data``, the language of each, a hash of both, whether the next stands in the same piece."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    lang: np.ndarray
    hash: np.ndarray
    goes_on: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def words_of(texts: list[bytes], langs: list[int], seeds: np.ndarray) -> Words:
    """Split texts (already cut into pieces by ``BREAK``) into words. ``langs``: of each text, a place in ``seeds``."""
    data = bytes([BREAK]).join(texts)
    raw = np.frombuffer(data, np.uint8)
    ends = raw == BREAK
    inside = np.concatenate([[False], ~(ends | (raw == SPACE)), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    breaks = np.flatnonzero(ends)
    piece = np.searchsorted(breaks, start)
    first_byte = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    lang = np.asarray(langs, np.int64)[np.searchsorted(first_byte, start, side="right") - 1] if len(start) else np.empty(0, np.int64)
    hashes, at = np.empty(len(start), np.uint64), 0
    while at < len(start):  # words of about HASHED bytes
        to = max(at + 1, int(np.searchsorted(end, start[at] + HASHED, side="right")))
        low = int(start[at])
        some = raw[low : int(end[to - 1])].astype(np.uint64) + np.uint64(1)
        power, inverse = _powers(max(HASHED, len(some)) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(some * power[: len(some)], dtype=np.uint64)])
        s, e = start[at:to] - low, end[at:to] - low
        hashes[at:to] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        at = to
    return Words(data, start, end, lang, _mixed(hashes ^ seeds[lang]) if len(start) else hashes, piece[1:] == piece[:-1])


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut where pieces end, about ``CHUNK`` bytes each (one piece at least)."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.rfind(BREAK, at, at + CHUNK)
        if cut <= at:
            cut = text.find(BREAK, at + CHUNK)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words]]:
    """The words of about ``CHUNK`` bytes of whole pieces, with the names of their languages."""
    texts: list[bytes] = []
    of: list[int] = []
    names: dict[str, int] = {}
    size = 0

    def out() -> tuple[list[str], Words]:
        seeds = np.array([xxhash.xxh3_64_intdigest(n) for n in names], np.uint64)
        return list(names), words_of(texts, of, seeds)

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            name = lang.as_py()
            for part in _pieces((text.as_py() or b"").translate(_TABLE)):
                if size + len(part) > CHUNK and texts:
                    yield out()
                    texts, of, names, size = [], [], {}, 0
                texts.append(part)
                of.append(names.setdefault(name, len(names)))
                size += len(part)
    if texts:
        yield out()


@dataclass
class Sketch:
    """A bit for each cell: whether it reached the least frequency."""

    log_width: int
    bits: list[np.ndarray]

    def passes(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), bool)
        for row, bits in enumerate(self.bits):
            cell = _cells(codes, row, self.log_width)
            out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _cells(codes: np.ndarray, row: int, log_width: int) -> np.ndarray:
    return ((codes * _ODD[row]) >> np.uint64(64 - log_width)).astype(np.int64)


def _level(size: int) -> int:
    return 0 if size <= 2 else 1


def places(words: Words, sketches: list[Sketch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size of n-gram: where those start whose parts and self pass ``sketches``, and their hashes. Sizes without a sketch: whose parts pass."""
    codes, alive = words.hash, np.ones(len(words.hash), bool)
    for size in range(1, most + 1):
        if size > 1:
            codes = _mixed(codes[:-1] * _STEP + words.hash[size - 1 :]) if len(codes) else codes
            alive = alive[:-1] & alive[1:]
            if size == 2:
                alive &= words.goes_on
        at = np.flatnonzero(alive)
        if _level(size) < len(sketches):
            at = at[sketches[_level(size)].passes(codes[at])]
            alive = np.zeros(len(alive), bool)
            alive[at] = True
        yield size, at, codes[at]


def _sketched(level: int, most: int, least: int, log_width: int, known: Broadcast):
    """A task's sketch of the n-grams of a level, in blocks."""
    kind = np.uint8 if least < 256 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((ROWS, 1 << log_width), np.uint16)
        for _, words in _chunks(batches):
            for size, _, codes in places(words, known.value, most):
                if _level(size) != level:
                    continue
                for row in range(ROWS):
                    place = _cells(codes, row, log_width)
                    for i in range(0, len(place), 1 << 15):  # no more than that fits a cell besides what stands there
                        some = place[i : i + (1 << 15)]
                        np.add.at(cells[row], some, np.uint16(1))
                        cells[row][some] = np.minimum(cells[row][some], least)
        blocks = cells.reshape(-1, min(BLOCK, 1 << log_width))
        for first in range(0, len(blocks), SENT):  # a few at a time, so that no second sketch is held
            own = [n for n in range(first, min(first + SENT, len(blocks))) if blocks[n].any()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([blocks[n].astype(kind).tobytes() for n in own], pa.binary())], ["block", "cells"])

    return run


def _summed(least: int):
    """Blocks of the same number, which come one after the other, as bits: whether their sum reaches ``least``."""
    kind = np.uint8 if least < 256 else np.uint16

    def out(number: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for number, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = np.frombuffer(cells.as_buffer(), kind).astype(np.uint32)
                if number != now:
                    if now is not None:
                        yield out(now, total)
                    now, total = number, np.zeros(len(block), np.uint32)
                total = np.minimum(total + block, least)
        if now is not None:
            yield out(now, total)

    return run


def sketch(spark: SparkSession, given: DataFrame, level: int, most: int, least: int, log_width: int, known: Broadcast) -> Sketch:
    """The merged sketch of a level: ``ROWS * 2**log_width`` bits, 8 MB at most, however much text there is."""
    least = min(least, 1 << 14)  # cells needn't count on: what reaches this is looked at
    own = given.mapInArrow(_sketched(level, most, least, log_width, known), "block int, cells binary")
    merged = own.repartition("block").sortWithinPartitions("block").mapInArrow(_summed(least), "block int, bits binary")
    width = 1 << log_width
    bits = np.zeros(ROWS * width // 8, np.uint8)
    size = min(BLOCK, width) // 8
    for r in merged.collect():
        bits[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return Sketch(log_width, list(bits.reshape(ROWS, -1)))


def word_ids(words: Words, at: np.ndarray) -> np.ndarray:
    """A number for each word of ``at``, the same for the same word of the same language and for no others."""
    _, first, ids = np.unique(words.hash[at], return_index=True, return_inverse=True)
    like = at[first][ids]
    size = words.end[at] - words.start[at]
    same = np.array_equal(size, words.end[like] - words.start[like]) and np.array_equal(words.lang[at], words.lang[like])
    if same:
        raw, before = np.frombuffer(words.data, np.uint8), np.cumsum(size) - size
        inside = np.arange(int(size.sum()))
        same = np.array_equal(raw[np.repeat(words.start[at] - before, size) + inside], raw[np.repeat(words.start[like] - before, size) + inside])
    if same:
        return ids
    known: dict[tuple[int, bytes], int] = {}  # two words have the same hash
    return np.array([known.setdefault((int(words.lang[i]), words.word(i)), len(known)) for i in at.tolist()], np.int64)


def _added(parts: list[pa.Table]) -> pa.Table:
    """Counts of equal n-grams added up."""
    return pa.concat_tables(parts).group_by(["lang", "size", "phrase"], use_threads=False).aggregate([("a", "sum")]).rename_columns(["lang", "size", "phrase", "a"])


def _counted(most: int, known: Broadcast):
    """A task's exact counts of the n-grams that pass, and of all words (size 0), by language."""

    def rows(lang: list[str], size: int, phrase: list[bytes], count: np.ndarray) -> pa.Table:
        return pa.table({"lang": pa.array(lang, pa.string()), "size": pa.array([size] * len(lang), pa.int32()), "phrase": pa.array(phrase, pa.binary()).cast(pa.string()), "a": pa.array(count, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        waiting = held = 0
        for names, words in _chunks(batches):
            n = len(words.hash)
            parts.append(rows(names, 0, [b""] * len(names), np.bincount(words.lang, minlength=len(names))))
            single, ids = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            for size, at, _ in places(words, known.value, most):
                if size == 1:
                    own = word_ids(words, at)
                    single[at] = own
                else:
                    own = ids[at] << 32 | single[at + size - 1]
                _, first, own, count = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
                ids = np.full(n, -1, np.int64)
                ids[at] = own
                here = at[first].tolist()
                parts.append(rows([names[k] for k in words.lang[here].tolist()], size, [b" ".join([words.word(j) for j in range(i, i + size)]) for i in here], count))
                waiting += len(here)
            if waiting > max(ADDED, held):  # as many new rows as there are sums: each row is added up a few times at most
                parts = [_added(parts)]
                waiting, held = 0, parts[0].num_rows
                pa.default_memory_pool().release_unused()
                if held > MOST_ADDED:
                    yield from parts[0].to_batches(ROWS_SENT)
                    parts, held = [], 0
        if parts:
            parts = [_added(parts)]
            yield from parts[0].to_batches(ROWS_SENT)
        parts.clear()
        pa.default_memory_pool().release_unused()

    return run


def frequent(spark: SparkSession, docs: DataFrame, least: int = 30, most: int = 4, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All n-grams of 1 to ``most`` words with ``least`` occurrences or more, by language: lang, size, phrase, a; a row of size 0 has a language's words.

    A stored table. Null texts have no words; null languages count as ``und``. Each row of ``docs`` counts, repeated or not.
    """
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_width = min(MOST, max(FEWEST, int(np.ceil(np.log2(max(1, total) / PER_CELL)))))
    # a sketch a task: fewer tasks than splits where a sketch would be a large part of what a task reads
    tasks = max(spark.sparkContext.defaultParallelism, int(total // max(32 << 20, 16 * ROWS << log_width)) + 1)
    known: list[Sketch] = []
    for level in (0, 1)[: 1 + (most > 2)]:
        known.append(sketch(spark, given.coalesce(tasks), level, most, least, max(FEWEST, log_width - 2 * level), spark.sparkContext.broadcast(list(known))))
    # two bit maps of ROWS * 2**MOST bits at most: 16 MB
    found = given.coalesce(tasks).mapInArrow(_counted(most, spark.sparkContext.broadcast(known)), "lang string, size int, phrase string, a long")
    return stored(spark, found.groupBy("lang", "size", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("size") == 0)), "grams")


def collocations(spark: SparkSession, docs: DataFrame, least: int = 30, most: int = 4, inside: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of 2 to ``most`` words of each language: lang, rank, phrase, a, l, r, n, score.

    The score is ``2000000 * a / (l + r)``, rounded down, of the cut with the lowest (the first of equals). Phrases inside
    a longer one that has ``inside`` per cent of their occurrences are left out. Equal scores are ranked by ``a``, then by the
    phrase's bytes. Arithmetic is exact to 38 digits. Other columns of ``docs`` are not read; an empty table gives no rows.
    """
    grams = frequent(spark, docs, least, most, text_col, lang_col)
    phrases = grams.where("size >= 2").withColumn("words", F.split("phrase", " "))
    piece = lambda s, n: F.array_join(F.slice("words", s, n), " ")
    key = lambda c: F.struct(F.col("lang"), c.alias("phrase"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("first"), piece(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    # a part's count is at least its phrase's, so it is among the frequent; a common word is part of very many phrases
    uses = cuts.select("lang", F.explode(F.array("first", "rest")).alias("phrase")).groupBy("lang", "phrase").agg(F.count(F.lit(1)).alias("uses"))
    parts = stored(spark, grams.where("size >= 1").join(uses, ["lang", "phrase"]).select(key(F.col("phrase")).alias("part"), F.col("a").alias("f"), "uses"), "parts")
    by = ["lang", "phrase", "k"]
    with_l = spread_join(cuts.withColumn("part", key(F.col("first"))), parts, "part", "uses", by).withColumnRenamed("f", "l").drop("part")
    with_r = spread_join(with_l.withColumn("part", key(F.col("rest"))), parts, "part", "uses", by).withColumnRenamed("f", "r")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = with_r.select("lang", "phrase", "a", "k", "l", "r").withColumn("score", F.expr("CAST(a AS DECIMAL(20,0)) * 2000000 DIV (CAST(l AS DECIMAL(20,0)) + r)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select("lang", "phrase", "cut.*")
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda s: F.array_join(F.slice("words", s, m), " "))))
    covers = phrases.where("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(within).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * inside))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first of each share, then of a language's shares: no task gets all phrases of a language
    shared = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    first = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = grams.where("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

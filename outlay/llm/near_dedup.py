"""MinHash near-duplicates with sequential Bayesian verification.

Texts are sketched once; equal texts collapse to one class before anything is compared.
Bands of the signature retrieve candidates; buckets with the same members count once. A bucket is
never expanded into all its pairs: its members are compared with one hub, the member that meets most
others (first each text with one of its hubs, then with those it isn't yet connected with), and verified
links are merged into components. Members of one bucket that are then in
different components are compared in bounded blocks, inside tasks: first their signatures, then
the texts of those that have a plausible partner; only links come out.
Candidates are compared batch by batch of their signatures and dropped as soon as the
posterior probability of reaching the threshold falls under ``miss``; survivors are
confirmed on their full shingle sets. Texts are sent for survivors alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from outlay.llm.common import WordHashes, likely_among, shingle_set, spread_join, stored, words_of

#: 24 bands of 5 rows: two texts at similarity 0.85 share a band but for once in a million (at 0.8, once in 15,000).
ROWS, BANDS, BATCH = 5, 24, 20
SIZE = ROWS * BANDS
#: Rows of a block, and rows that are compared with it in one unit of work.
BLOCK, PROBES = 256, 1024
#: Texts of a task that are Python objects at once.
AT_ONCE = 500
_RNG = np.random.default_rng(20240607)
_A = (_RNG.integers(0, 2**31, SIZE, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, SIZE, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``SIZE`` hashes of the shingles, a chunk at a time."""
    low = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(low, (short[i : i + 2048, None] * _A + _B).min(axis=0), out=low)
    return low


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """For each batch end n, the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail at integer
    parameters is a binomial sum.
    """
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        tail = lambda m, n=n: sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))
        out.append((n, next(m for m in range(n + 1) if tail(m) >= miss)))
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signature rows survive every batch."""
    alive, matches, at = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in least:
        matches = matches + (a[alive, at:n] == b[alive, at:n]).sum(axis=1)
        keep = matches >= m
        alive, matches, at = alive[keep], matches[keep], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in low.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ part) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            prints, counts, bands, signatures = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                found = shingle_set(words, size, hashes)
                low = signature(found) if words else None
                # a byte of each minimum is enough to compare them; chance matches only make the test more careful
                prints.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                counts.append(len(found))
                bands.append(band_keys(low) if words else None)
                signatures.append(low.astype(np.uint8).tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                names=["id", "print", "n_shingles", "bands", "signature"],
            )

    return run


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(-1, SIZE)


def _linked(both: int, a: int, b: int, part: int, whole: int) -> bool:
    return both > 0 and whole * both >= part * (a + b - both)


def _survivors(least: list[tuple[int, int]]):
    """Pairs with both signatures: those that pass the Bayesian test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = plausible(_matrix(batch.column("signature_a").to_pylist()), _matrix(batch.column("signature_b").to_pylist()), least)
            yield batch.filter(pa.array(alive)).select(["a", "b"])

    return run


def _verify(size: int, part: int, whole: int):
    """Pairs with both texts: those whose full sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            keep = []
            for ta, tb in zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("text_a", "text_b")), strict=True):
                if last[0] != tb:
                    last = tb, shingle_set(words_of(tb), size, hashes)
                a, b = shingle_set(words_of(ta), size, hashes), last[1]
                keep.append(_linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), part, whole))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _partners(least: list[tuple[int, int]], kind: pa.DataType):
    """Streams over rows ordered by unit, first a unit's block: the members that have a plausible partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = rows = None
        block: list = []
        for batch in batches:
            out, found = [], set()
            columns = [batch.column(c).to_pylist() for c in ("bucket", "block", "salt", "probe", "class", "component", "signature")]
            for bucket, number, salt, probe, id_, component, sign in zip(*columns, strict=True):
                if (bucket, number, salt) != unit:
                    unit, block, rows = (bucket, number, salt), [], None
                if not probe:
                    block.append((id_, component, sign))
                    continue
                if rows is None:
                    rows, labels = _matrix([x[2] for x in block]), np.array([x[1] for x in block])
                at = np.flatnonzero(labels != component) if block else np.empty(0, np.int64)
                at = at[plausible(rows[at], np.broadcast_to(np.frombuffer(sign, np.uint8), (len(at), SIZE)), least)] if len(at) else at
                if len(at):
                    found |= {(bucket, x) for x in (id_, *(block[i][0] for i in at.tolist()))}
            out = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], kind)], names=["bucket", "class"])

    return run


class _Block:
    """Up to ``BLOCK`` texts or so that others are compared with; it remembers which components have met."""

    def __init__(self, size: int, part: int, whole: int, least: list[tuple[int, int]], hashes: WordHashes):
        self.size, self.part, self.whole, self.least, self.hashes = size, part, whole, least, hashes
        self.ids: list = []
        self.components: list = []
        self.signatures: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.parent: dict = {}
        self.rows = None

    def add(self, id_, component, signature_: bytes, text: bytes) -> None:
        self.ids.append(id_)
        self.components.append(component)
        self.signatures.append(signature_)
        self.sets.append(shingle_set(words_of(text), self.size, self.hashes))

    def root(self, x):
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def _close(self) -> None:
        self.rows = _matrix(self.signatures)
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.order_ids = np.array(self.ids)
        self.labels = np.array([self.root(c) for c in self.components])
        self.sizes = np.array([len(x) for x in self.sets])

    def links(self, id_, component, outside: bool, signature_: bytes, text: bytes) -> list:
        """Ids of the block's texts that this one is linked with, one for each component not met before."""
        if not self.ids:
            return []
        if self.rows is None:
            self._close()
        own = self.root(component)
        row = np.frombuffer(signature_, np.uint8)
        left = self.labels != own
        if outside:  # it stands in a block itself: each pair once
            left &= self.order_ids < id_
        at = np.flatnonzero(left)
        at = at[plausible(self.rows[at], np.broadcast_to(row, (len(at), SIZE)), self.least)]
        if not len(at):
            return []
        mine = shingle_set(words_of(text), self.size, self.hashes)
        low, high = np.searchsorted(self.flat, mine, "left"), np.searchsorted(self.flat, mine, "right")
        many = high - low
        places = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        both = np.bincount(self.owner[places], minlength=len(self.ids))
        out = []
        for i in at.tolist():
            if _linked(int(both[i]), len(mine), int(self.sizes[i]), self.part, self.whole) and self.labels[i] != own:
                out.append(self.ids[i])
                self.parent[self.root(self.components[i])] = own
                self.labels[self.labels == self.labels[i]] = own
        return out


def _compare(size: int, part: int, whole: int, least: list[tuple[int, int]], kind: pa.DataType):
    """Streams over rows ordered by unit: first a unit's block, then the rows to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, unit, block = WordHashes(), None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "block", "salt", "probe", "class", "component", "outside", "signature")]
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            a, b = [], []
            for bucket, number, salt, probe, id_, component, outside, sign, text in zip(*columns, texts, strict=True):
                if (bucket, number, salt) != unit:
                    unit, block = (bucket, number, salt), _Block(size, part, whole, least, hashes)
                if not probe:
                    block.add(id_, component, sign, text)
                    continue
                for other in block.links(id_, component, outside, sign, text):
                    a.append(id_)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    return run


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``edges`` (``a``, ``b``).

    Alternates two steps, each a grouped minimum and a join, until every node points at the
    smallest of its component: larger neighbours move to the smallest neighbour, then smaller
    ones do. The number of rounds grows with the logarithm of the size of a component.
    """
    edges = stored(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", narrow=True)
    while True:
        # done when each node points once and none is pointed at that points itself
        ends = edges.select("a", F.lit(1).alias("points"), F.lit(0).alias("is_end")).union(edges.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("points").alias("points"), F.max("is_end").alias("is_end"))
        if ends.where("points > 1 or points = 1 and is_end = 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = stored(spark, small.where("a <> b").distinct(), "edges", narrow=True)


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    part: int = 80,
    whole: int = 100,
    miss: float = 1e-6,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for each row of ``docs``.

    Two texts are linked if whole * intersection >= part * union of their sets of word shingles
    (ASCII lower case, words end at ASCII white space; with fewer words than ``shingle`` the whole
    sequence is one). Components are those of all links; ``component_id`` is the smallest id in
    one. Null, empty and blank texts have an empty set and are linked with nothing. Rows with a
    null id are kept, without component. Rows that repeat an id count as one document (their texts'
    links add up). Other columns of ``docs`` play no part; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    sketches = stored(spark, texts.mapInArrow(_sketches(shingle), f"id {kind}, print binary, n_shingles long, bands array<long>, signature binary"), "sketches")
    named = sketches.where("n_shingles > 0 and id is not null")
    classes = named.groupBy("print").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"))
    # only classes with copies need a join to tell their rows the class
    several = stored(spark, classes.where("copies > 1"), "several", narrow=True)
    copies = likely_among(named.select("id", "print"), "print", several.select("print"))
    members = stored(spark, spread_join(copies, several, "print", "copies", ["id"]).select("id", "print", "class").distinct(), "members", narrow=True)
    others = members.where("id <> class")
    first = named.join(others.select("id", "print"), ["id", "print"], "left_anti").select(F.col("id").alias("class"), "n_shingles", "bands", "signature")
    # an id that stands with several texts links their classes
    repeated = named.groupBy("id").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high")
    same_id = others.join(repeated, "id", "left_semi").select(F.col("id").alias("a"), F.col("class").alias("b"))

    # buckets of two or more classes, one of those with the same members; the hub is the class that meets most others
    keyed = first.select("class", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("class")).alias("print"), F.min("class").alias("low"), F.max("class").alias("high")).where("size > 1")
    sizes = stored(spark, sizes.groupBy("print", "size", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket", "size", F.col("size").alias("uses")), "sizes", narrow=True)
    busy = stored(spark, spread_join(likely_among(keyed, "bucket", sizes.select("bucket")), sizes, "bucket", "uses", ["class"]), "buckets", narrow=True)
    meets = busy.groupBy("class").agg(F.sum("size").alias("meets"))
    hubs = busy.join(meets, "class").groupBy("bucket").agg(F.max(F.struct("meets", "class", "n")).alias("hub"), F.count(F.lit(1)).alias("uses"))
    hubs = stored(spark, hubs.select("bucket", F.col("hub.class").alias("b"), F.col("hub.n").alias("n_b"), F.col("hub.meets").alias("meets"), "uses"), "hubs", narrow=True)
    spokes = stored(spark, spread_join(busy, hubs, "bucket", "uses", ["class"]).where("class <> b").select("bucket", "class", "n", "b", "n_b", "meets"), "spokes", narrow=True)
    wanted = busy.select("class").distinct()
    signed = stored(spark, likely_among(first.select("class", "signature"), "class", wanted).join(wanted, "class"), "signatures")
    least, arrow = least_matches(part / whole, miss), to_arrow_type(texts.schema["id"].dataType)

    def with_texts(ids: DataFrame) -> DataFrame:
        """``class`` and ``text`` of some classes; ids are distinct, so the join is a semi-join, but written as one it would be moved below the bit map."""
        ids = ids.toDF("id").distinct()
        return likely_among(texts.where("text is not null"), "id", ids).join(ids, "id").select(F.col("id").alias("class"), "text")

    def verified(stars: DataFrame) -> DataFrame:
        """The pairs (``a``, ``b``) that are linked: signatures first, then the texts of those that survive."""
        pairs = stars.join(signed.toDF("a", "signature_a"), "a").join(signed.toDF("b", "signature_b"), "b")
        pairs = stored(spark, pairs.mapInArrow(_survivors(least), f"a {kind}, b {kind}"), "survivors")
        of_class = stored(spark, with_texts(pairs.select("a").union(pairs.select("b"))), "texts")
        both = pairs.join(of_class.toDF("a", "text_a"), "a").join(of_class.toDF("b", "text_b"), "b")
        return stored(spark, both.mapInArrow(_verify(shingle, part, whole), f"a {kind}, b {kind}"), "links")

    def joined(label: DataFrame, links: DataFrame) -> DataFrame:
        """The components (``node``, ``component``) after more links."""
        low = lambda c: label.toDF(c, f"of_{c}")
        ends = links.join(low("a"), "a", "left").join(low("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
        merged = components(spark, ends).toDF("component", "root")
        label = label.union(links.select("a", "a").union(links.select("b", "b")).distinct().join(label.select(F.col("node").alias("a")), "a", "left_anti").toDF("node", "component"))
        return label.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component"))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(label.toDF("class", "component"), "class", "left").withColumn("component", F.coalesce("component", "class"))

    possible = (F.col("n") * whole >= F.col("n_b") * part) & (F.col("n_b") * whole >= F.col("n") * part)
    stars = spokes.where(possible).groupBy(F.col("class").alias("a")).agg(F.max_by("b", F.struct("meets", "b")).alias("b"))
    label = stored(spark, components(spark, verified(stars).union(same_id)), "label", narrow=True)
    of_hub = label.toDF("b", "of_b")
    stars = labelled(spokes.where(possible)).join(of_hub, "b", "left").where(F.col("component") != F.coalesce("of_b", "b")).select(F.col("class").alias("a"), "b").distinct()
    links = verified(stored(spark, stars, "stars", narrow=True))
    if not links.isEmpty():
        label = stored(spark, joined(label, links), "label", narrow=True)

    # pairs that no hub has met: members of one bucket in different components
    def units(of_bucket: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Who is in a bucket's blocks (those outside its main component) and who is compared with them (all); a unit has at most ``BLOCK`` and ``PROBES`` of them or so."""
        each = of_bucket.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        open_ = each.groupBy("bucket").agg(F.sum("n").alias("uses"), F.max(F.struct("n", "component")).alias("main")).where("uses > main.n")
        open_ = open_.select("bucket", "uses", F.col("main.component").alias("main"), F.ceil((F.col("uses") - F.col("main.n")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("uses") / PROBES).cast("int").alias("salts"))
        open_ = stored(spark, open_, f"{name}-open", narrow=True)
        apart = stored(spark, spread_join(of_bucket, open_, "bucket", "uses", ["class"]).withColumn("outside", F.col("component") != F.col("main")), f"{name}-apart", narrow=True)
        hashed = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "class"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        of_block = apart.where("outside").select("bucket", hashed("blocks", 1).alias("block"), every("salts").alias("salt"), F.lit(False).alias("probe"), "class", "component", "outside")
        probes = apart.select("bucket", every("blocks").alias("block"), hashed("salts", 2).alias("salt"), F.lit(True).alias("probe"), "class", "component", "outside")
        return of_block.union(probes), apart

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "block", "salt").sortWithinPartitions("bucket", "block", "salt", "probe")

    rows, apart = units(stored(spark, labelled(spokes.select("bucket", "class")), "labelled", narrow=True), "signed")
    rows = rows.drop("outside").join(signed, "class")
    flagged = dealt(rows.select("bucket", "block", "salt", "probe", "class", "component", "signature")).mapInArrow(_partners(least, arrow), f"bucket long, class {kind}")
    flagged = stored(spark, flagged.distinct(), "flagged", narrow=True)
    same = flagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("class")).alias("print"), F.min("class").alias("low"), F.max("class").alias("high"))
    same = same.groupBy("size", "print", "low", "high").agg(F.min("bucket").alias("bucket")).select("bucket")
    flagged = stored(spark, flagged.join(same, "bucket"), "distinct", narrow=True)
    more = None
    if not flagged.isEmpty():
        rows, _ = units(stored(spark, apart.select("bucket", "class", "component").join(flagged, ["bucket", "class"]), "plausible", narrow=True), "texts")
        meeting = flagged.select("class").distinct()
        signed_texts = stored(spark, with_texts(meeting).join(signed, "class"), "signed-texts")
        rows = dealt(rows.join(signed_texts, "class").select("bucket", "block", "salt", "probe", "class", "component", "outside", "signature", "text"))
        more = stored(spark, rows.mapInArrow(_compare(shingle, part, whole, least, arrow), f"a {kind}, b {kind}"), "more")
    if more is not None and not more.isEmpty():
        label = joined(label, more)

    # a text's copies may be a third of all rows: their join with its component is split
    of_copies = several.groupBy("class").agg(F.sum("copies").alias("uses")).join(label.toDF("class", "component"), "class", "left")
    of_copies = stored(spark, of_copies.select("class", F.coalesce("component", "class").alias("root"), "uses"), "of-copies", narrow=True)
    root = spread_join(members.select("id", "class"), of_copies, "class", "uses", ["id"]).select("id", "root").union(label.select("node", "component"))
    root = root.groupBy("id").agg(F.min("root").alias("root"))
    out = sketches.join(root, "id", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "id")).otherwise(F.col("id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest id, all columns as they are.

    Rows with a null id stay. Of rows that repeat an id one stays. ``how`` goes to ``near_duplicates``.
    """
    found = near_duplicates(spark, docs, id_col, text_col, **how).where("doc_id is not null")
    # of a repeated id with an empty and another text, the row is decided by its id alone
    state = stored(spark, found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("times")).where("not kept or times > 1"), "decided", narrow=True)
    decided = state.select(F.col("doc_id").alias(id_col))
    out = docs.join(decided, id_col, "left_anti")
    if not state.where("kept").isEmpty():
        again = docs.join(state.where("kept").select(F.col("doc_id").alias(id_col)), id_col, "left_semi").dropDuplicates([id_col])
        out = out.unionByName(again)
    return out

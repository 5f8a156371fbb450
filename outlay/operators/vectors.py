"""The most similar candidates of each vector, by cosine: one matrix product for a batch of queries and a block of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from outlay.sources.scratch import is_small, stored

#: Candidates of a block, queries that meet a block together, and the most cells that candidates are dealt into.
BLOCK, QUERIES, MOST_CELLS = 1024, 256, 1024
#: Similarities this close are compared by the exact sum.
CLOSE = 1e-9


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Added up from the first component on, as ``numbers.cosine`` does."""
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += vectors[:, d] * vectors[:, d]
    return np.sqrt(out)


def nearest(queries: np.ndarray, candidates: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``top`` most similar candidates, of equals the first: places of queries, of candidates, similarities."""
    own, other = _norms(queries), _norms(candidates)
    if not len(queries) or not len(candidates):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    about = (queries @ candidates.T) / (np.outer(own, other) + 1e-10)
    k = min(top, len(candidates))
    least = np.partition(about, len(candidates) - k, axis=1)[:, len(candidates) - k]
    q, c = np.nonzero(about >= least[:, None] - CLOSE)
    dot = np.zeros(len(q))
    for d in range(queries.shape[1]):
        dot += queries[q, d] * candidates[c, d]
    exact = dot / (own[q] * other[c] + 1e-10)
    order = np.lexsort((c, -exact, q))
    q, c, exact = q[order], c[order], exact[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], c[rank < k], exact[rank < k]


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size)


def _rows(ids: pa.Array, others: pa.Array, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    q, c, similarity = found
    return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), others.take(pa.array(c)), pa.array(similarity)], ["query_id", "candidate_id", "similarity"])


def match_vectors(queries: DataFrame, candidates: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` most similar candidates of each query, of equals the smaller id: ``query_id``, ``rank``, ``candidate_id``, ``similarity``.

    Both have ``id`` and ``vector``. Vectors that are null, hold nulls or numbers that aren't finite, or are shorter than the
    candidates' longest take no part. Candidates of a checked size are sent to the queries, which stay where they are.
    Others are dealt into cells around some of them; a query meets the nearest cell, then those that can hold
    something as near as what it has. Only the best of a query in a block become rows.
    """
    known = candidates.select(F.col("id").alias("candidate_id"), F.col("vector").cast("array<double>").alias("vector"))
    size = known.agg(F.max(F.size("vector"))).first()[0] or 0
    known = stored(known.where(usable(F.col("vector"), size)), "candidates")
    own = queries.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).where(usable(F.col("vector"), size))
    schema = T.StructType([T.StructField("query_id", own.schema["query_id"].dataType), T.StructField("candidate_id", known.schema["candidate_id"].dataType), T.StructField("similarity", T.DoubleType())])
    found = _beside(own, known, size, top, schema) if known.isEmpty() or is_small(known) else _by_cells(stored(own, "queries"), known, size, top, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "candidate_id", "similarity")


def _beside(own: DataFrame, known: DataFrame, size: int, top: int, schema: T.StructType) -> DataFrame:
    """Queries where they are, beside all candidates (whose size was checked)."""
    listed = known.orderBy("candidate_id").collect()
    ids = pa.array([r.candidate_id for r in listed], to_arrow_type(schema["candidate_id"].dataType))
    vectors = own.sparkSession.sparkContext.broadcast(np.array([r.vector for r in listed], np.float64).reshape(len(listed), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows(batch.column(0), ids, nearest(_matrix(batch.column(1), size), vectors.value, top))

    return own.mapInArrow(run, schema)


class Cells:
    """Pivots and, around each, the widest angle of its candidates."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots / np.maximum(_norms(pivots), 1e-300)[:, None]
        self.radius, self.sizes = np.full(len(pivots), -1.0), np.zeros(len(pivots), np.int64)

    def angles(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """To each pivot; and which vectors have no direction."""
        norms = _norms(vectors)
        return np.arccos(np.clip((vectors / np.maximum(norms, 1e-300)[:, None]) @ self.pivots.T, -1, 1)), norms == 0

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each candidate and its angle there; one without a direction makes its cell reach everywhere."""
        angles, none = self.angles(vectors)
        cell = angles.argmin(axis=1)
        return cell, np.where(none, np.pi, angles[np.arange(len(cell)), cell])

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        return np.where(self.sizes > 0, self.angles(vectors)[0] - self.radius, np.inf).argmin(axis=1)

    def within_reach(self, vectors: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        """Cells that may have a candidate at least as similar as ``least``, but for the nearest, which was met."""
        angles, none = self.angles(vectors)
        most = np.cos(np.minimum(np.maximum(angles - self.radius - 1e-6, 0), np.pi))
        may = ((most >= least[:, None] - 1e-6) | none[:, None]) & (self.sizes > 0)
        may[np.arange(len(vectors)), self.nearest(vectors)] = False
        return [np.flatnonzero(m) for m in may]


def _by_cells(own: DataFrame, known: DataFrame, size: int, top: int, schema: T.StructType) -> DataFrame:
    spark = own.sparkSession
    total = known.count()
    # pivots: a bounded sample; every candidate is dealt to one
    pivots = known.orderBy(F.xxhash64("candidate_id"), "candidate_id").limit(min(MOST_CELLS, max(1, int(total**0.5)))).collect()
    cells = Cells(np.array([r.vector for r in pivots], np.float64))
    id_type = to_arrow_type(schema["candidate_id"].dataType)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = cells.place(_matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), batch.column(1), pa.array(cell), pa.array(angle)], ["candidate_id", "vector", "cell", "angle"])

    kind = schema["candidate_id"].dataType.simpleString()
    dealt = stored(known.mapInArrow(deal, f"candidate_id {kind}, vector array<double>, cell long, angle double"), "dealt")
    for r in dealt.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        cells.radius[r.cell], cells.sizes[r.cell] = r.angle, r.n
    parts = F.element_at(F.lit((-(-np.maximum(cells.sizes, 1) // BLOCK)).tolist()), (F.col("cell") + 1).cast("int"))
    blocks = dealt.groupBy("cell", F.pmod(F.xxhash64("candidate_id"), parts).alias("part")).agg(F.sort_array(F.collect_list(F.struct("candidate_id", "vector"))).alias("block"))
    blocks = stored(blocks, "blocks")
    shares = max(1, own.count() // QUERIES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, block in zip(batch.column(0), batch.column(1), strict=True):
                (ids, vectors), (others, theirs) = ((x.values.field(0), x.values.field(1)) for x in (mine, block))
                yield _rows(ids, others, nearest(_matrix(vectors, size), _matrix(theirs, size), top))

    def met(routed: DataFrame) -> DataFrame:
        grouped = routed.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(shares)).alias("share")).agg(F.collect_list(F.struct("query_id", "vector")).alias("queries"))
        pairs = grouped.join(blocks, "cell").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "part", "share")
        return pairs.select("queries", "block").mapInArrow(compare, schema)

    def first(vectors: pa.Array) -> pa.Array:
        return pa.array(cells.nearest(_matrix(vectors, size)) if len(vectors) else [], pa.int64())

    def others(vectors: pa.Array, least: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int64()))
        return pa.array(cells.within_reach(_matrix(vectors, size), least.to_numpy(zero_copy_only=False)), pa.list_(pa.int64()))

    near = stored(met(own.withColumn("cell", F.arrow_udf(first, T.LongType())(F.col("vector")))), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"))
    # the worst of a query's best so far; without so many anything may be among them
    worst = near.withColumn("k", F.row_number().over(best)).where(F.col("k") == top).select("query_id", F.col("similarity").alias("least"))
    rest = own.join(worst, "query_id", "left").withColumn("cell", F.explode(F.arrow_udf(others, T.ArrayType(T.LongType()))(F.col("vector"), F.coalesce("least", F.lit(-2.0)))))
    return near.unionByName(met(rest.select("query_id", "vector", "cell")))

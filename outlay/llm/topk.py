"""Exact top-k by inner product: dual-tree search over cover trees, at two scales.

Between tasks: the leaves of a cover tree over a bounded sample are the pivots of cells, each row
belongs to the cell of its nearest pivot, and a cell is split into blocks of a bounded number
of rows. A query is searched in the block of its own row first; with the k-th score found
there it is sent to those cells only whose bound reaches that score.

Inside a task: queries and rows are indexed by a cover tree each and both are walked together. A pair of
nodes is left out when its bound is below the worst k-th score of the node's queries. The bound
is the smaller of two: from the inner product of the centres and both covering radii, and from
the angle between the centres, both covering angles and the largest norms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.common import stored

LEAF, QUERY_LEAF, SHRINK, WIDEST = 64, 8, 0.7, 256
#: Cells at most, and rows of the sample for each that pivots are taken from: what the driver sees and what is broadcast is bounded.
CELLS, SAMPLED = 4096, 8


@dataclass
class Node:
    """A centre, the covering radius of all points below, and either children or the points themselves."""

    centre: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(vectors: np.ndarray, points: np.ndarray | None = None, centre: int | None = None, far: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cover tree of the rows ``points`` of ``vectors``.

    Children's centres are further apart than ``SHRINK`` times the radius of their parent, the first is
    the parent's own, and every point is within the radius of its child's centre. Once there are as many
    centres as children of ``leaf`` points would need (or ``WIDEST``), points that none of them reaches go
    to the nearest: without clusters each would become a centre.
    """
    if points is None:
        points, centre = np.arange(len(vectors)), 0
        far = np.linalg.norm(vectors - vectors[0], axis=1)
    node = Node(vectors[centre], float(far.max(initial=0.0)), points)
    if len(points) <= leaf or node.radius == 0:
        return node
    reach, most = node.radius * SHRINK, max(2, min(WIDEST, -(-len(points) // leaf)))
    owner, distance, centres = np.zeros(len(points), np.int64), far.copy(), [centre]
    open_ = np.flatnonzero(distance > reach)
    while len(open_) and len(centres) < most:
        at = int(points[open_[0]])
        every = np.linalg.norm(vectors[points] - vectors[at], axis=1)
        nearer = every < distance
        owner[nearer], distance[nearer] = len(centres), every[nearer]
        centres.append(at)
        open_ = open_[distance[open_] > reach]
    for i, at in enumerate(centres):
        own = np.flatnonzero(owner == i)
        if len(own):
            node.children.append(cover_tree(vectors, points[own], at, distance[own], leaf))
    return node


class Shapes:
    """Balls and cones around sets of vectors: centres, radii, angles, and the least and largest norms."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray, angles: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.centres, self.radii, self.angles, self.least, self.most = centres, radii, angles, least, most
        self.norms = np.linalg.norm(centres, axis=1)

    @classmethod
    def of(cls, nodes: list[Node], vectors: np.ndarray) -> Shapes:
        centres = np.stack([n.centre for n in nodes])
        norms = np.linalg.norm(vectors, axis=1)
        angles, least, most = (np.zeros(len(nodes)) for _ in range(3))
        for i, n in enumerate(nodes):
            least[i], most[i] = norms[n.points].min(), norms[n.points].max()
            angles[i] = _angles(vectors[n.points], norms[n.points], n.centre).max()
        return cls(centres, np.array([n.radius for n in nodes]), angles, least, most)

    @classmethod
    def points(cls, vectors: np.ndarray) -> Shapes:
        norms, none = np.linalg.norm(vectors, axis=1), np.zeros(len(vectors))
        return cls(vectors, none, none, norms, norms)

    def take(self, at: np.ndarray) -> Shapes:
        return Shapes(self.centres[at], self.radii[at], self.angles[at], self.least[at], self.most[at])


def _angles(vectors: np.ndarray, norms: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles with the centre; a zero vector's is 0 (its products are 0 anyway), with a zero centre all are the largest."""
    size = np.linalg.norm(centre)
    if size == 0:
        return np.full(len(vectors), np.pi)
    return np.where(norms > 0, np.arccos(np.clip(vectors @ centre / (np.maximum(norms, 1e-300) * size), -1, 1)), 0.0)


def bounds(q: Shapes, r: Shapes) -> np.ndarray:
    """What no inner product of a vector of one of ``q`` with one of ``r`` exceeds; a little is added for rounding. All pairs."""
    products = q.centres @ r.centres.T
    ball = products + np.outer(q.norms, r.radii) + np.outer(q.radii, r.norms) + np.outer(q.radii, r.radii)
    sizes = np.outer(q.norms, r.norms)
    apart = np.arccos(np.clip(products / np.maximum(sizes, 1e-300), -1, 1))
    apart = np.where(sizes > 0, apart, 0.0) - q.angles[:, None] - r.angles[None, :] - 1e-7
    cosine = np.cos(np.clip(apart, 0, np.pi))
    cone = np.where(cosine >= 0, cosine * np.outer(q.most, r.most), cosine * np.outer(q.least, r.least))
    best = np.minimum(ball, cone)
    return best + 1e-9 * np.abs(best) + 1e-6


class Search:
    """Top k of each query over one block; scores are exact integers held in doubles. ``least``: scores below these needn't be found."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None):
        self.queries, self.query_ids, self.vectors, self.ids, self.k = queries, query_ids, vectors, ids, k
        self.least = np.full(len(queries), -np.inf) if least is None else least
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.compared = 0

    def worst(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[q, -1], self.least[q])

    def compare(self, q: np.ndarray, r: np.ndarray) -> None:
        scores = self.queries[q] @ self.vectors[r].T
        self.compared += scores.size
        scores[self.query_ids[q][:, None] == self.ids[r][None, :]] = -np.inf
        better = (scores >= self.worst(q)[:, None]).any(axis=1)
        if not better.any():
            return
        q, scores = q[better], scores[better]
        if scores.shape[1] > 4 * self.k:  # of equal scores at the edge all are looked at
            edge = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            near = np.flatnonzero((scores >= edge[:, None]).any(axis=0))
            scores, r = scores[:, near], r[near]
        all_scores = np.concatenate([self.scores[q], scores], axis=1)
        all_ids = np.concatenate([self.found[q], np.broadcast_to(self.ids[r], scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[q], self.found[q] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def run(self) -> None:
        """Walks both trees level by level, then compares the pairs of leaves that are left, by falling bound."""
        if not len(self.queries) or not len(self.vectors):
            return
        q_nodes, q_children = _flat(cover_tree(self.queries, leaf=QUERY_LEAF))
        r_nodes, r_children = _flat(cover_tree(self.vectors))
        q_shapes, r_shapes = Shapes.of(q_nodes, self.queries), Shapes.of(r_nodes, self.vectors)
        r_leaves = np.flatnonzero([not c for c in r_children])
        q_leaves = np.flatnonzero([not c for c in q_children])
        # first each group of queries meets the leaf that promises most, so that its k-th scores are known early
        nearest = r_leaves[np.argmax(q_shapes.centres[q_leaves] @ r_shapes.centres[r_leaves].T, axis=1)]
        met: dict[int, list[int]] = {}
        for a, b in zip(q_leaves.tolist(), nearest.tolist(), strict=True):
            met.setdefault(b, []).append(a)
        done = set(zip(q_leaves.tolist(), nearest.tolist(), strict=True))
        for b, those in met.items():
            self.compare(np.concatenate([q_nodes[a].points for a in those]), r_nodes[b].points)
        worst = np.array([self.worst(n.points).min() for n in q_nodes])
        left: dict[int, list[int]] = {}
        level: dict[int, list[int]] = {0: [0]}  # query node: nodes of rows it still has to meet
        while level:
            below: dict[int, list[int]] = {}
            for a, those in level.items():
                at = np.array(those)
                # an equal score can still win by its smaller id, hence only what is below is left out
                at = at[bounds(q_shapes.take(np.array([a])), r_shapes.take(at))[0] >= worst[a]]
                deeper = [c for b in at.tolist() for c in (r_children[b] or [b])]
                leaves_only = all(not r_children[b] for b in at.tolist())
                if leaves_only and not q_children[a]:
                    for b in at.tolist():
                        if (a, b) not in done:
                            left.setdefault(b, []).append(a)
                    continue
                for c in q_children[a] or [a]:
                    below.setdefault(c, []).extend(deeper)
            level = below
        order = sorted(left, key=lambda b: -max(float(r_shapes.norms[b]), 0.0))
        for b in order:
            q = np.concatenate([q_nodes[a].points for a in left[b]])
            q = q[bounds(Shapes.points(self.queries[q]), r_shapes.take(np.array([b])))[:, 0] >= self.worst(q)]
            if len(q):
                self.compare(q, r_nodes[b].points)


def _flat(root: Node) -> tuple[list[Node], list[list[int]]]:
    """The nodes of a tree, the root first, and the numbers of each one's children."""
    nodes, children, at = [root], [], 0
    while at < len(nodes):
        children.append(list(range(len(nodes), len(nodes) + len(nodes[at].children))))
        nodes += nodes[at].children
        at += 1
    return nodes, children


def _matrix(arrays, width: int) -> np.ndarray:
    """A list column as rows of ``width``, padded with zeros."""
    arrays = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    sizes = np.diff(arrays.offsets.to_numpy())
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _found(search: Search) -> pa.Table:
    row, place = np.nonzero(search.scores > -np.inf)
    return pa.table({"query_id": pa.array(search.query_ids[row], pa.int64()), "vec_id": pa.array(search.found[row, place], pa.int64()), "score": pa.array(search.scores[row, place].astype(np.int64), pa.int64())})


def _place(pivots):
    """Adds to each row the cell of its nearest pivot, and what the shape of that cell needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = pivots.value
        sizes = (centres**2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column("vector"), centres.shape[1])
            cell = np.argmin(sizes[None, :] - 2 * (x @ centres.T), axis=1) if len(x) else np.empty(0, np.int64)
            norms = np.linalg.norm(x, axis=1)
            own = centres[cell]
            cosine = (x * own).sum(axis=1) / np.maximum(norms * np.sqrt(sizes[cell]), 1e-300)
            angles = np.where(norms == 0, 0.0, np.where(sizes[cell] == 0, np.pi, np.arccos(np.clip(cosine, -1, 1))))
            more = [cell.astype(np.int32), np.linalg.norm(x - own, axis=1), angles, norms]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=[*batch.schema.names, "cell", "radius", "angle", "norm"])

    return run


def _own_block(k: int, width: int):
    """Searches a block's own queries in it: a row for each query with what was found and the k-th score."""
    kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))

    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy()
        x, ids = _matrix(rows.column("vector"), width), rows.column("id").to_numpy()
        search = Search(x[asks], ids[asks], x, ids, k)
        search.run()
        found = [[{"vec_id": int(i), "score": int(s)} for i, s in zip(a, b, strict=True) if s > -np.inf] for a, b in zip(search.found, search.scores, strict=True)]
        picked = rows.filter(pa.array(asks))
        # of an id with several vectors each row counts for the others' k-th score only as far as it was found itself
        return pa.table({"id": picked.column("id"), "vector": picked.column("vector"), "cell": picked.column("cell"), "block": picked.column("block"), "found": pa.array(found, kind), "least": pa.array(search.scores[:, -1], pa.float64())})

    return run


def _send(cells, width: int):
    """A row for each query and cell whose bound reaches the query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = cells.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # bounded: so many queries by all cells
                part = batch.slice(at, 512)
                x = _matrix(part.column("vector"), width)
                query, cell = np.nonzero(bounds(Shapes.points(x), shapes) >= part.column("least").to_numpy()[:, None])
                # what a task makes at once is bounded too
                for i in range(0, len(query), 16384):
                    rows = part.take(pa.array(query[i : i + 16384]))
                    yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("id", "vector", "least", "cell", "block")], pa.array(cell[i : i + 16384].astype(np.int32))], names=["id", "vector", "least", "own_cell", "own_block", "cell"])

    return run


def _other_block(k: int, width: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        search = Search(_matrix(queries.column("vector"), width), queries.column("id").to_numpy(), _matrix(data.column("vector"), width), data.column("id").to_numpy(), k, queries.column("least").to_numpy())
        search.run()
        return _found(search)

    return run


def top_k(
    spark: SparkSession,
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block: int = 8192,
    query_block: int = 2048,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for each row where ``is_query`` holds the ``k`` best of all other rows.

    Components become floor(``scale`` * x); the score is their integer inner product; ties go to the
    smaller id. Vectors that are null or hold null or non-finite components take no part, nor do rows
    with a null id. Rows with a query's id are its own. Repeated rows (id and vector) count once. Shorter vectors
    are as if padded with zeros. Fewer than ``k`` others give all; an empty table gives no rows. Scores
    must stay below 2 ** 53. Other columns play no part.

    The result is exact whatever the data; how much is sent and compared depends on them. Where vectors
    form clusters a query meets few cells. Where they don't (unit vectors that point anywhere, in tens
    of dimensions) no bound by radius or angle rules a cell out, and each query meets each row.
    """
    x = F.col(vector_col)
    finite = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull()).where(F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).distinct()
    rows = stored(spark, rows, "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)

    # pivots: leaves of a cover tree over a bounded sample
    wanted = min(CELLS, -(-n // block))
    sample = rows.select("vector").orderBy(F.xxhash64("vector"), "id").limit(wanted * SAMPLED).collect() if wanted > 1 else rows.select("vector").limit(1).collect()
    seen = np.zeros((len(sample), width))
    for row, r in zip(seen, sample, strict=True):
        row[: len(r.vector)] = r.vector
    leaves = [node for node in _flat(cover_tree(seen, leaf=SAMPLED))[0] if not node.children]
    leaves = sorted(leaves, key=lambda node: -len(node.points))[:CELLS]
    pivots = spark.sparkContext.broadcast(np.unique(np.stack([node.centre for node in leaves]), axis=0))
    placed = rows.mapInArrow(_place(pivots), "id long, vector array<double>, asks boolean, cell int, radius double, angle double, norm double")
    placed = stored(spark, placed, "placed")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("radius"), F.max("angle"), F.min("norm"), F.max("norm")).orderBy("cell").collect()  # at most CELLS rows
    numbers = np.array([tuple(r) for r in stats], dtype=float)
    # a cell's number from here on is its place among those that have rows
    table = spark.createDataFrame([(int(r[0]), i, -(-r[1] // block)) for i, r in enumerate(stats)], "cell int, number int, blocks int")
    shapes = spark.sparkContext.broadcast(Shapes(pivots.value[numbers[:, 0].astype(int)], *numbers[:, 2:].T))
    data = placed.join(F.broadcast(table), "cell").select("id", "vector", "asks", F.col("number").alias("cell"), F.pmod(F.xxhash64("id", "vector"), F.col("blocks")).cast("int").alias("block"))

    own = data.groupBy("cell", "block").applyInArrow(_own_block(k, width), "id long, vector array<double>, cell int, block int, found array<struct<vec_id:long,score:long>>, least double")
    own = stored(spark, own, "own")
    sent = own.select("id", "vector", "least", "cell", "block").mapInArrow(_send(shapes, width), "id long, vector array<double>, least double, own_cell int, own_block int, cell int")
    sent = sent.join(F.broadcast(table.select(F.col("number").alias("cell"), "blocks")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = stored(spark, sent.where("cell <> own_cell or block <> own_block").select("id", "vector", "least", "cell", "block"), "sent")
    # one row a block; a block's queries are dealt into groups, and its rows go to each
    parts = sent.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
    parts = stored(spark, parts, "parts", narrow=True)
    units = ["cell", "block", "part"]
    rows_of = data.join(parts, ["cell", "block"]).select("id", "vector", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    queries = sent.join(parts, ["cell", "block"]).select("id", "vector", "least", "cell", "block", F.pmod(F.xxhash64(F.lit(2), "id", "vector"), F.col("parts")).cast("int").alias("part"))
    others = rows_of.groupBy(*units).cogroup(queries.groupBy(*units)).applyInArrow(_other_block(k, width), "query_id long, vec_id long, score long")
    found = own.select(F.col("id").alias("query_id"), F.inline("found")).unionByName(others)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

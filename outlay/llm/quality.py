"""Quality: a compression classifier over zstandard dictionaries of good and of bad text.

One dictionary is trained on pieces of texts labelled good, one on pieces of texts labelled bad. A whole text is cut
into pieces, each piece is compressed with either dictionary, and the two sizes, summed over all pieces, give one number:
``(bad - good) / (bad + good)``. It is above zero where the good dictionary explains the text better. Isotonic
regression on labelled rows that trained no dictionary, as a line through the middle of its steps, makes it a probability.

Pieces are short, so that what a piece saves comes from the dictionary and not from its own repetitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.common import fresh, stored

#: Bytes of a piece, and the level of compression.
PIECE, LEVEL = 256, 3
#: How far the calibration's lowest and highest steps stay from 0 and 1.
ENDS = 0.005


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration as points of a rising line; ``rate`` alone where nothing can be learned."""

    good: bytes
    bad: bytes
    places: list[float] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    rate: float = 0.0


def pieces(text: str | None) -> list[bytes]:
    """All of a text's UTF-8 bytes, ``PIECE`` by ``PIECE``; none for null and empty texts."""
    data = (text or "").encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


class Sizes:
    """Compressed sizes under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.each = [self._compressor(d) for d in (good, bad)]

    @staticmethod
    def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: str | None) -> float:
        """From -1 (bad) to 1 (good); 0 for a text without bytes."""
        parts = pieces(text)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.each)
        return (bad - good) / (bad + good) if bad + good > 0 else 0.0


def _differences(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(good, bad)
        for texts in batches:
            yield pa.array([sizes.difference(t) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(run, "double")


def _cut(most_each: int, seed: int):
    """Up to ``most_each`` pieces of each text, evenly spaced, with a hash that orders them by chance."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, found, order = [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = pieces(text)
                for i in sorted({int(k) for k in np.linspace(0, len(parts) - 1, min(most_each, len(parts)))}):
                    labels.append(label)
                    found.append(parts[i])
                    order.append(xxhash.xxh3_64_intdigest(parts[i], seed) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), pa.array(found, pa.binary()), pa.array(order, pa.int64())], ["label", "piece", "chance"])

    return run


def _dictionary(parts: DataFrame, label: float, most_pieces: int, size: int) -> bytes:
    """A dictionary of ``size`` bytes at most from up to ``most_pieces`` pieces of one class (a bounded list on the driver)."""
    chosen = [bytes(r.piece) for r in parts.where(F.col("label") == label).orderBy("chance", "piece").limit(most_pieces).select("piece").collect()]
    whole = b"".join(chosen)
    try:
        return zstandard.train_dictionary(min(size, max(256, len(whole) // 8)), chosen).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return whole[:size]


def fit(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_rows: int = 40_000,
    most_pieces: int = 20_000,
    most_each: int = 40,
    dictionary_bytes: int = 110_000,
    seed: int = 11,
) -> Model:
    """Fit on a bounded sample: the ``most_rows`` labelled ids with the smallest hash (all, if fewer).

    ``usable`` (on ``id_col`` of ``labels``) says which ids may be learned from. Four fifths of the sample train the
    dictionaries, from at most ``most_each`` pieces of a text and ``most_pieces`` of a class (5 MB); one fifth, whole
    texts, the calibration. Null ids and labels are left out; an id labelled twice counts once, as good only if all its
    labels say so. Without rows of both classes to train on the model is a constant rate (0 without rows).
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if usable is not None:
        ids = ids.where(usable)
    ids = ids.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("double")).alias("label"))
    # at most most_rows small rows: bounded, hence broadcast
    picked = stored(spark, ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most_rows), "picked")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    sample = stored(spark, texts.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(5)) == 0), "sample")
    count = {(r.calibrates, r.label): r["count"] for r in sample.groupBy("calibrates", "label").count().collect()}
    total = sum(count.values())
    rate = sum(v for (_, k), v in count.items() if k) / total if total else 0.0
    if not (count.get((False, 0.0)) and count.get((False, 1.0))):
        return Model(b"", b"", rate=rate)
    parts = stored(spark, sample.where("not calibrates").select("label", "text").mapInArrow(_cut(most_each, seed), "label double, piece binary, chance long"), "pieces")
    good, bad = (_dictionary(parts, k, most_pieces, dictionary_bytes) for k in (1.0, 0.0))
    held = sample.where("calibrates").select("label", _differences(good, bad)("text").alias("raw"))
    if not count.get((True, 0.0)) or not count.get((True, 1.0)):  # nothing to calibrate with: a straight line
        return Model(good, bad, [-1.0, 1.0], [0.0, 1.0])
    line = IsotonicRegression(labelCol="label", featuresCol="raw").fit(stored(spark, held, "held"))
    return Model(good, bad, *_rising([float(x) for x in line.boundaries], [float(x) for x in line.predictions]))


def _rising(boundaries: list[float], predictions: list[float]) -> tuple[list[float], list[float]]:
    """The calibration as a line that rises everywhere: through the middle of each step, from 0 at -1 to 1 at 1, so that different differences have different scores."""
    steps: dict[float, list[float]] = {}
    for x, y in zip(boundaries, predictions, strict=True):
        steps.setdefault(ENDS + (1 - 2 * ENDS) * y, []).append(x)
    middles = [((xs[0] + xs[-1]) / 2, y) for y, xs in steps.items()]
    points = [(-1.0, 0.0), *[(x, y) for x, y in middles if -1 < x < 1], (1.0, 1.0)]
    return [x for x, _ in points], [y for _, y in points]


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` with the score of each row, 0 to 1 (higher: better), in column ``into`` (replaced if there).

    Whole texts are read where they are; no row is moved. Null and empty texts have a difference of 0 and the score
    that the calibration gives it. Repeated rows are each scored.
    """
    if not model.places:
        return docs.withColumn(into, F.lit(float(model.rate)))
    raw = fresh(docs, "raw_difference")
    places, scores = np.array(model.places), np.array(model.scores)

    def calibrated(differences: pa.Array) -> pa.Array:
        return pa.array(np.clip(np.interp(differences.to_numpy(zero_copy_only=False), places, scores), 0, 1), pa.float64())

    kept = [c for c in docs.columns if c.lower() != into.lower()]
    out = docs.withColumn(raw, _differences(model.good, model.bad)(docs[text_col]))
    return out.withColumn(raw, F.arrow_udf(calibrated, "double")(F.col(raw))).select(*kept, F.col(raw).alias(into))


def kept(score_col: str = "quality", least: float = 0.3) -> Column:
    return F.col(score_col) >= least

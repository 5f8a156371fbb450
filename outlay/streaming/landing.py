"""Uploads as a stream: each file of a folder lands once, each row once, each batch with a line in a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from outlay import reference, schema
from outlay.config import DEFAULT, Settings
from outlay.operators import ingest
from outlay.sources import parted
from outlay.sources.scratch import stored

KEY = ["engagement_id", "source_row_hash"]


def watch_exports(spark: SparkSession, directory: str, columns: list[str] | None = None, files_per_batch: int = 100) -> DataFrame:
    """A stream of the exports that arrive in a folder; all columns are text."""
    names = columns or list(reference.COLUMN_MAPPINGS["DEFAULT"])
    fields = ", ".join(f"`{c}` string" for c in names)
    return spark.readStream.schema(fields).option("header", True).option("multiLine", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(directory)


LANDED = f"{schema.LANDING_SCHEMA}, {parted.PREFIX} string"


def landed(spark: SparkSession, path: str, parts: list[Row] | None = None) -> DataFrame:
    """All landed rows, or those of some folders (tenant, prefix). Tenant and batch are folders: conditions on them spare the others."""
    return parted.read_folders(spark, path, LANDED, parts).select(*StructType.fromDDL(schema.LANDING_SCHEMA).fieldNames())


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return parted.read_table(spark, path, schema.BATCH_SCHEMA)


def land_batch(rows: DataFrame, number: int, landing: str, ledger_path: str, engagement_id: str, source: str = "") -> None:
    """Adds rows that aren't landed yet, and the batch's line in the ledger.

    The landing table is laid out by tenant and by the first digits of a hash of the row's key, so that a batch meets the keys of its own folders
    only. The batch is read once: equal rows are joined where it is read, both numbers are counted by the tasks that write. A batch owns one
    folder below each of those and one of the ledger, and overwrites them: repeated after a failure, it gives the same tables.
    ``rows`` have the columns of ``ingest.to_landing``.
    """
    spark, batch = rows.sparkSession, f"{number:012d}"
    fields = StructType.fromDDL(schema.LANDING_SCHEMA).fields
    seen, kept = Observation(), Observation()
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in fields if f.name != "batch_id"]).withColumn(parted.PREFIX, parted.prefix(F.col("source_row_hash")))
    keys = [*KEY, parted.PREFIX]
    values = [f.name for f in fields if f.name not in (*KEY, "batch_id")]
    once = typed.groupBy(*keys).agg(F.first(F.struct(*values)).alias("row"), F.count(F.lit(1)).alias("times"))
    upload = stored(once.observe(seen, F.sum("times").alias("rows")).select(*keys, "row.*"), "upload")
    before = parted.read_folders(spark, landing, LANDED, parted.touched(upload)).where(F.col("batch_id") != batch)
    new = upload.join(before.select(*KEY), KEY, "left_anti").observe(kept, F.count(F.lit(1)).alias("rows"))
    new.withColumn("batch_id", F.lit(batch)).write.partitionBy(parted.TENANT, parted.PREFIX, "batch_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(landing)
    total, added = (o.get["rows"] or 0 for o in (seen, kept))
    line = {"engagement_id": engagement_id, "source_file": source, "rows": total, "new_rows": added, "duplicate_rows": total - added, "status": "done"}
    spark.range(1).select(*[F.lit(v).alias(k) if isinstance(v, str) else F.lit(v).cast("long").alias(k) for k, v in line.items()]).write.mode("overwrite").parquet(f"{ledger_path}/batch_id={batch}")


def land(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    landing: str,
    ledger_path: str,
    checkpoint: str,
    engagement_id: str,
) -> StreamingQuery:
    """Lands all that has arrived, batch by batch, then stops; started again, it goes on where it was.

    ``prepare`` makes landing rows of a batch (``exports_to_landing`` for exports).
    """

    def each(batch: DataFrame, number: int) -> None:
        land_batch(prepare(batch), number, landing, ledger_path, engagement_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exports_to_landing(rates: DataFrame, engagement_id: str, settings: Settings = DEFAULT) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: ingest.to_landing(ingest.ingest(batch, rates, engagement_id, settings=settings), "")


class Progress(StreamingQueryListener):
    """The newest state of each query, for a page that asks now and then."""

    def __init__(self) -> None:
        self.states: dict[str, dict] = {}

    def _put(self, query_id: object, **values: object) -> None:
        self.states.setdefault(str(query_id), {}).update(values)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._put(event.id, status="running", batch=None, rows=0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        rows = self.states.get(str(p.id), {}).get("rows", 0)
        self._put(p.id, batch=p.batchId, rows=rows + p.numInputRows)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._put(event.id, status="failed" if event.exception else "done", error=event.exception)


__all__ = ["Progress", "exports_to_landing", "land", "land_batch", "landed", "ledger", "watch_exports"]

"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. The reader cuts files into byte ranges. A task looks
for gzip magic from the start of its range, takes a place for a member only if what it decodes
there begins like a WARC record, and owns the records that start inside its range, however far
past the end they reach.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm.common import likely_flag, spread_join, stored

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
AHEAD = 1 << 20
FLUSH = 8 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    name = "none" if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + packer.flush()


def _write(directory: str, file_bytes: int):
    """Writes a task's rows to files named after the attempt; only files that a finished task reports count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(directory)
        store.create_dir(top, recursive=True)
        name, out, size, number = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, 0
        made: list[tuple[str, int]] = []

        def close() -> None:
            out.close()
            made.append((f"{directory}/{name}-{number:04d}.warc.gz", size))

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    out, size = store.open_output_stream(f"{top}/{name}-{number:04d}.warc.gz", compression=None), 0
                data = record(page_id, url, payload, digest, first)
                out.write(data)
                size += len(data)
                if size >= file_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["path", "bytes"])

    return run


def write(
    spark: SparkSession,
    pages: DataFrame,
    directory: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    file_bytes: int = 64 << 20,
) -> DataFrame:
    """Write a record for each row below ``directory`` (any file system that pyarrow knows); returns the written files: ``path``, ``bytes``.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of ``LEAST`` bytes or
    more, those with the smallest id are responses and the others revisit it; rows with a null id
    revisit it too. If all their ids are null, all are responses. Repeated rows are each
    written. An empty table writes no file. Other columns play no part.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # only digests that occur again need to be told to their rows: all others stay where they are
    firsts = rows.where(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = stored(spark, firsts, "digests", narrow=True)
    rows = likely_flag(rows, "digest", firsts.select("digest"), "again")
    again = spread_join(rows.where("again"), firsts, "digest", "n", ["page_id", "url"], "left")
    rows = again.unionByName(rows.where("not again").withColumn("first", F.lit(None).cast("long")))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    return stored(spark, rows.mapInArrow(_write(directory, file_bytes), "path string, bytes long"), "files")


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """``path`` and ``bytes`` of the archives in a folder, for ``read``; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(directory).select("path", F.col("length").alias("bytes"))


def read(spark: SparkSession, files: DataFrame, split_bytes: int = 4 << 20) -> DataFrame:
    """All records of ``files`` (``path``, ``bytes``), each from the range it starts in.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload: counted and hashed for a
    response, as stated in its headers for a revisit. ``intact``: a response's digest is the stated
    one. Bytes that are no record are skipped.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.repartition(tasks, "path", "start").mapInArrow(_read, SCHEMA)


class _Window:
    """The bytes of a file from a place on, read as far as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, bytearray()
        file.seek(start)

    def reach(self, to: int) -> bool:
        """Have the bytes up to ``to``, counted from the start, if the file has them; whether it does."""
        if len(self.data) < to and self.start + len(self.data) < self.size:
            self.data += self.file.read(min(max(to - len(self.data), AHEAD), self.size - self.start - len(self.data)))
        return len(self.data) >= to


def members(window: _Window, length: int) -> Iterator[bytes]:
    """The decoded WARC members that start in the first ``length`` bytes."""
    window.reach(length + len(MAGIC) - 1)
    at = 0
    while 0 <= (at := window.data.find(MAGIC, at, length + len(MAGIC) - 1)) < length:
        unpack, end, out = zlib.decompressobj(31), at, []
        try:
            while not unpack.eof:
                if end >= len(window.data) and not window.reach(end + 1):
                    raise zlib.error("the file ends inside a member")
                piece = unpack.decompress(bytes(window.data[end : end + AHEAD]))
                end = min(end + AHEAD, len(window.data)) - len(unpack.unused_data)
                if piece:
                    out.append(piece)
                    if len(out) == 1 and not piece.startswith(b"WARC/1."[: len(piece)]):
                        raise zlib.error("no WARC record")
        except zlib.error:
            at += 1
            continue
        data = b"".join(out)
        if data.startswith(b"WARC/1."):
            yield data
            at = end
        else:
            at += 1


def parse(data: bytes) -> tuple | None:
    """A row of ``SCHEMA`` from a decoded record; None for records of other kinds and for those whose length is no number."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    kind = fields.get("warc-type")
    stated_length = fields.get("content-length", str(len(rest)))
    if kind not in ("response", "revisit") or not re.fullmatch("[0-9]{1,18}", stated_length):
        return None
    block = rest[: int(stated_length)]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?[0-9]{1,19})>", fields.get(name, ""))) and -(2**63) <= int(m[1]) < 2**63 else None
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]{1,18})\r", http + b"\r")
        return number("warc-record-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to"), int(length[1]) if length else None, stated, None, True
    digest = hashlib.sha256(payload).hexdigest()
    return number("warc-record-id"), fields.get("warc-target-uri"), kind, None, len(payload), digest, payload, digest == stated


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    for batch in batches:
        for path, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start", "end")), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_file(name) as file:
                for data in members(_Window(file, start, size), end - start):
                    if row := parse(data):
                        rows.append(row)
                        held += len(data)
                    if held >= FLUSH:
                        yield packed(rows)
                        rows, held = [], 0
            if rows:
                yield packed(rows)

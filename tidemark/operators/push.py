"""Pushing records into a collection: serialised, compressed, packed into files, indexed."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise, tasks
from tidemark.operators.layout import assign_files, running, warc_filename
from tidemark.operators.render import serialise
from tidemark.schema import SPLIT_THRESHOLD
from tidemark.sources.cdx import FIELDS, format_line, from_records, parse_lines


def last_file(folder: str, dict_id: int | None, compression: str | None) -> tuple[int, int]:
    """The number of the last file of a collection's present encoding and where what its CDX lines name ends; (1, 0) where there is none.

    Bytes behind that end are of a push that failed. Only the lines of that file are looked at.
    """
    tail = ("" if dict_id is None else rf"\.{dict_id}") + r"\.warc" + ("" if compression is None else rf"\.{compression}")
    names = os.listdir(folder) if os.path.isdir(folder) else []
    taken = [(int(m[1]), n) for n in names if (m := re.fullmatch(rf"records\.([0-9]+){tail}", n))]
    return max(taken, default=(1, ""))


def written_to(spark, folder: str, name: str) -> int:
    """The end of the last record that the collection's CDX lines place in a file."""
    plain = folder.removeprefix("file://")
    if not name or not os.path.exists(f"{plain}/index.cdx"):
        return 0
    lines = parse_lines(spark.read.text(f"{folder}/index.cdx").select(F.col("value").alias("line")))
    return lines.where(F.col("file") == name).agg(F.max(F.col("offset").cast("bigint") + F.col("raw_size"))).first()[0] or 0


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (filename, offset, raw) at their offsets, spread by ranges of file and offset, so no file is one task's; returns filename and where each task's last row in it ends.

    The same bytes go to the same places whenever a task is tried again, or twice at
    once, so that does no harm; what a file holds before its first row's offset stays.
    """

    def write(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        out = name = None
        done = {}

        def close() -> None:
            if out:
                done[name] = out.tell()
                out.flush()
                os.fsync(out.fileno())
                out.close()

        for b in arrived:
            for n, at, data in zip(b.column("filename").to_pylist(), b.column("offset").to_pylist(), b.column("raw")):
                if n != name:
                    close()
                    name = n
                    out = os.fdopen(os.open(os.path.join(folder, name), os.O_RDWR | os.O_CREAT, 0o644), "r+b")
                if out.tell() != at:
                    out.seek(at)
                out.write(data.as_buffer())
        close()
        yield pa.RecordBatch.from_pydict({"filename": pa.array(list(done), pa.string()), "size": pa.array(list(done.values()), pa.int64())})

    ordered = rows.select("filename", "offset", "raw").repartitionByRange(tasks(rows.sparkSession), "filename", "offset").sortWithinPartitions("filename", "offset")
    return ordered.mapInArrow(write, "filename string, size bigint")


def write_lines(rows: DataFrame, path: str) -> None:
    """CDX lines of rows (record_no and the seven fields) in order, behind those that are there."""
    rows.orderBy("record_no").select(format_line().alias("value")).write.mode("append").text(path)


def _packed(rows: DataFrame, dictionary: bytes, level: int) -> DataFrame:
    """``raw`` compressed; the other columns pass as they are."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        for frame in frames:
            small = pa.array([tool.compress(v) for v in frame.column("raw").to_pylist()], pa.binary())
            yield frame.set_column(frame.schema.get_field_index("raw"), "raw", small)

    return rows.mapInArrow(pack, rows.schema)


def push_stored(
    rows: DataFrame, folder: str, dict_id: int | None = None, threshold: int = SPLIT_THRESHOLD, inclusive: bool = True,
    dictionary: bytes | None = None, level: int = 3, fresh: bool = False, index: str | None = "line",
) -> DataFrame:
    """Appends rows (id, raw, and a CDX line ``line``) to a collection's files: into the last one as long as they fit, then into new ones.

    Returns record_no and the seven fields of the lines with their new places, and adds
    them to ``index.cdx``. With ``fresh`` the last file isn't gone on with; with
    ``index=None`` there are no lines, and id, filename, offset and raw_size are returned.
    ``dictionary``: the bytes aren't encoded yet.
    """
    plain, spark = folder.removeprefix("file://"), rows.sparkSession
    kind = None if dict_id is None else "zstd"
    stored = rows if dictionary is None else _packed(rows, dictionary, level)
    stored = materialise(stored.withColumn("raw_size", F.octet_length("raw").cast("bigint")), "pushed")
    number, name = (1, "") if fresh else last_file(plain, dict_id, kind)
    fill = written_to(spark, folder, name)
    placed = assign_files(stored.withColumn("collection", F.lit("")), threshold, inclusive=inclusive, state=(number, fill, fill == 0))
    named = warc_filename(F.col("file_no"), F.lit(dict_id).cast("bigint"), F.lit(kind).cast("string"))
    placed = materialise(placed.select("id", named.alias("filename"), "offset"), "placed")
    write_files(stored.join(placed, "id"), plain).write.format("noop").mode("overwrite").save()
    both = stored.drop("raw").join(placed, "id")
    if index is None:
        return materialise(both.select("id", "filename", "offset", "raw_size"), "pushed-index")
    both = running(both.withColumn("_one", F.lit(0)), "_one", "id").select(F.col("_place").alias("record_no"), index, "filename", F.col("offset").alias("_at"), F.col("raw_size").alias("_size"))
    fields = parse_lines(both, index).select("record_no", "url", "type", "id", "date", F.col("filename").alias("file"), F.col("_at").cast("string").alias("offset"), F.col("_size").alias("raw_size"))
    fields = materialise(fields, "pushed-index")
    write_lines(fields, f"{folder}/index.cdx")
    return fields


def push(
    records: DataFrame, folder: str, dictionary: bytes | None = None, dict_id: int | None = None, threshold: int = SPLIT_THRESHOLD, level: int = 3, order: str = "id"
) -> DataFrame:
    """Appends records (order, headers, body) to a collection's files; returns record_no (1, 2, ... by ``order``) and the seven CDX fields.

    CDX lines are added below ``index.cdx`` once all files are whole, so a push that fails leaves no index entries.
    """
    spot = records.select(
        F.col(order).alias("record"), "headers", serialise(F.col("headers"), F.col("body")).alias("raw"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("raw_size"),
    )
    fields = from_records(spot, keep={"record": "record", "raw": "raw"})
    return push_stored(fields.select(F.col("record").alias("id"), format_line().alias("line"), "raw"), folder, dict_id, threshold, dictionary=dictionary, level=level)

"""Continuous ingest of WARC files that arrive in a folder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.archive import Archive
from tidemark.schema import WARC
from tidemark.sources.warc import batches_of


def stream_records(spark: SparkSession, path: str, files_per_batch: int = 100, watermark: str | None = "1 hour") -> DataFrame:
    """Records of WARC files, compressed or not, as they arrive, each identifier once within the watermark. A bad record ends its file.

    Spark lists the files; their contents are read in the tasks as streams, so a file may be larger than memory.
    """
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(path)

    def parse(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrived:
            kind = b.schema.field("modificationTime").type
            for name, seen in zip(b.column("path").to_pylist(), b.column("modificationTime")):
                for made in batches_of(re.sub("^file:/+", "/", name)):
                    ids = [dict(h.as_py())["WARC-Record-ID"][0].strip("<>") for h in made.column("headers")]
                    more = [pa.array([name] * made.num_rows, pa.string()), *made.columns[1:], pa.array(ids, pa.string()), pa.array([seen] * made.num_rows, kind)]
                    yield pa.RecordBatch.from_arrays(more, [*made.schema.names, "identifier", "seen"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WARC) + ", identifier string, seen timestamp"
    parsed = files.select("path", "modificationTime").mapInArrow(parse, shape)
    if watermark is None:
        return parsed
    return parsed.withWatermark("seen", watermark).dropDuplicatesWithinWatermark(["identifier"])


def append_batches(records: DataFrame, target: str, checkpoint: str, once: bool = False):
    """Writes a stream of records as Parquet, each batch once; returns the running query."""
    writer = records.select("*", F.to_date("seen").alias("day")).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(target)


def push_stream(archive: Archive, slug: str, path: str, checkpoint: str, once: bool = False, **access):
    """Pushes the records of files that arrive in a folder to a collection, by batches; returns the running query.

    A batch that is tried again adds only the records whose identifiers aren't in the index yet.
    """
    uuid = archive.collection(slug)["uuid"]

    def push(batch: DataFrame, _: int) -> None:
        there = archive.records(uuid).select("identifier")
        fresh = batch.join(there, "identifier", "left_anti").withColumn("id", F.concat("path", F.lpad(F.col("offset").cast("string"), 20, "0")))
        archive.push(slug, fresh.select("id", "headers", "body"), **access)

    writer = stream_records(archive.spark, path).writeStream.foreachBatch(push).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""The folders of an archive: collections, dictionaries, stored bytes."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.checkpoint import tasks
from tidemark.operators.mutations import validate_manifests
from tidemark.schema import MANIFEST, PUSH_BATCH, READ_BATCH
from tidemark.sources.warc import list_files, opened, read_record

FOLDERS = ("data/buffer", "data/dict/zstd", "data/repository")
_WHOLE = (".gz", ".zst", ".xz")


def init_layout(path: str, config: dict | None = None) -> None:
    """Makes the folders and the configuration of an archive; the folder must be empty or not there."""
    if os.path.isdir(path) and os.listdir(path):
        raise FileExistsError(f"{path} isn't empty")
    for f in FOLDERS:
        os.makedirs(os.path.join(path, f))
    anonymous = {f"anonymous_{a}_perms{k}": v for a in ("read", "write", "delete") for k, v in (("_kind", "any"), ("", ""))}
    with open(os.path.join(path, "config.json"), "w") as out:
        json.dump({"listen_addr": "127.0.0.1:8080", "secret_key": None, "database": ""} | anonymous | (config or {}), out, indent=2)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """Manifests below a repository; those that can't be read or used are left out."""
    found = spark.read.schema(MANIFEST).option("multiLine", True).json(f"{path}/*/manifest.json")
    return validate_manifests(found)


def dictionary_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Files that are dictionaries (``<slug>.<id>.<ext>``, id an unsigned 32-bit number) with dict_slug and dict_id; an id that two files have is an error."""
    parts = F.split(name, r"\.", -1)
    number = F.when(F.get(parts, 1).rlike("^[0-9]{1,10}$"), F.get(parts, 1).cast("bigint"))
    good = files.select("*", F.get(parts, 0).alias("dict_slug"), number.alias("dict_id"), F.size(parts).alias("_n")).where((F.col("_n") == 3) & (F.col("dict_id") < 1 << 32)).drop("_n")
    twice = good.groupBy("dict_id").count().where("count > 1")
    clash = twice.first()
    if clash:
        raise ValueError(f"two dictionaries have the id {clash['dict_id']}")
    return good


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """dict_id, dict_slug, path, bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("bytes"))
    return dictionary_names(files).select("dict_id", "dict_slug", "path", "bytes")


def find_collection(collections: DataFrame, uuid: str | None = None, slug: str | None = None) -> DataFrame:
    return collections.where(F.col("uuid") == uuid if uuid is not None else F.col("slug") == slug)


def slice_raw(body: Column, offset: Column, size: Column) -> Column:
    """Stored bytes of one record out of its file's."""
    return F.substring(body, (offset + 1).cast("int"), size.cast("int"))


def dictionary_of(dictionaries: dict[int, bytes] | str | None, number: int) -> bytes:
    """One dictionary, of a folder or of those that are at hand."""
    if not isinstance(dictionaries, str):
        return (dictionaries or {})[number]
    for name in os.listdir(dictionaries):
        if name.split(".")[1:2] == [str(number)] and name.count(".") == 2:
            with open(f"{dictionaries}/{name}", "rb") as data:
                return data.read()
    raise KeyError(number)


def fetch_records(index: DataFrame, root: str, filename: str = "filename", offset: str = "offset", size: str = "raw_size", dictionaries: dict[int, bytes] | str | None = None, raw: bool = False) -> DataFrame:
    """Index rows with ``raw`` (as stored), or with ``headers`` and ``body``.

    Rows are spread by ranges of file and offset and read in that order, each by one seek, so no file is one task's, whatever its size;
    of compressed files that are read from front to back each is. A task holds about READ_BATCH bytes of records, and dates
    stay Arrow's, which go beyond the year 2262. A row with a dict_id is decompressed
    with that dictionary: of those given, which travel with the function, or out of a folder, from which each task reads those it needs.
    """
    kept = [T.StructField(f.name, f.dataType) for f in index.schema]
    headers_type = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
    shape = T.StructType(kept + ([T.StructField("raw", T.BinaryType())] if raw else [T.StructField("headers", headers_type), T.StructField("body", T.BinaryType())]))
    names = shape.names

    def read(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        ready: dict = {}
        stream, name, place, whole = None, None, 0, False
        for b in arrived:
            found, held, first = [], 0, 0

            def made() -> pa.RecordBatch:
                if raw:
                    more = [pa.array(found, pa.binary())]
                else:
                    more = [pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.list_(pa.string()))), pa.array([body for _, body in found], pa.binary())]
                return pa.RecordBatch.from_arrays([*b.slice(first, len(found)).columns, *more], names)

            values = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            for n, start, length, d in zip(values(filename), values(offset), values(size), values("dict_id") if "dict_id" in b.schema.names else [None] * b.num_rows):
                if n != name:
                    if stream:
                        stream.close()
                    name, place, full = n, 0, os.path.join(root.removeprefix("file://"), n)
                    whole = d is None and not raw and full.endswith(_WHOLE)
                    stream = opened(full) if whole else open(full, "rb")
                if whole:  # offsets are those of the decompressed file, which is read from front to back
                    while place < start:
                        place += len(stream.read(min(1 << 20, start - place)) or b" " * (start - place))
                else:
                    stream.seek(start)
                data = stream.read(length)
                place = start + length
                if raw:
                    found.append(data)
                    held += len(data)
                else:
                    if d is not None:
                        if d not in ready:
                            ready[d] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary_of(dictionaries, d)))
                        data = ready[d].decompress(data)
                    headers, body, _ = read_record(io.BytesIO(data), name, start)
                    found.append((headers, body))
                    held += len(data)
                if held >= READ_BATCH:
                    yield made()
                    found, held, first = [], 0, first + len(found)
            if found:
                yield made()
        if stream:
            stream.close()

    front = F.lit(False) if raw else F.col(filename).rlike(r"\.(gz|zst|xz)$")
    if "dict_id" in index.columns:
        front &= F.col("dict_id").isNull()
    spread = index.repartitionByRange(tasks(index.sparkSession), F.col(filename), F.when(front, F.lit(0)).otherwise(F.col(offset)))
    return spread.sortWithinPartitions(filename, offset).mapInArrow(read, shape)


def read_frame_files(spark: SparkSession, path: str) -> DataFrame:
    """Frames of pushed files, each file read by one task as a stream: id (of file and place, in order), line, raw. A bad frame is an error."""
    names = [(k, n) for k, n in enumerate(list_files(path))]
    files = spark.createDataFrame(names, "k int, name string").repartition(max(1, len(names)), "k")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, name in zip(frame.k, frame.name):
                with open(name, "rb") as stream:
                    rows, held, n = [], 0, 0
                    for line, raw in _frames_of(stream):
                        if rows and held + len(raw) > PUSH_BATCH:
                            yield pd.DataFrame(rows, columns=["id", "line", "raw"])
                            rows, held = [], 0
                        rows.append(((int(k) << 40) + n, line, raw))
                        held, n = held + len(raw), n + 1
                    if rows:
                        yield pd.DataFrame(rows, columns=["id", "line", "raw"])

    return files.mapInPandas(read, "id bigint, line string, raw binary")


def _frames_of(stream) -> Iterator[tuple[str, bytes]]:
    while head := stream.readline():
        line = head.rstrip(b"\r\n").decode()
        parts = line.split(" ")
        if len(parts) != 7 or not parts[6].isdigit() or parts[6] == "0":
            raise ValueError(f"not a frame: {line[:80]}")
        raw = stream.read(int(parts[6]))
        if len(raw) < int(parts[6]):
            raise ValueError("the last frame is cut off")
        yield line, raw


def read_frames(data: bytes, most: int = PUSH_BATCH) -> Iterator[list[tuple[str, bytes]]]:
    """Pushed frames (a CDX line, then as many bytes as its last field says) in batches that are written at once."""
    batch, held = [], 0
    for line, raw in _frames_of(io.BytesIO(data)):
        if batch and held + len(raw) > most:
            yield batch
            batch, held = [], 0
        batch.append((line, raw))
        held += len(raw)
    if batch:
        yield batch

"""WARC files as a data source."""

from __future__ import annotations

import gzip
import hashlib
import io
import lzma
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tidemark.schema import READ_BATCH, WARC

VERSION, FOOTER = b"WARC/1.1\r\n", b"\r\n\r\n"
SINGLE = ("WARC-Type", "WARC-Record-ID", "WARC-Date")


class BadRecord(ValueError):
    """What was read isn't a record."""


def read_record(stream, origin: str = "", offset: int = 0, line: bytes | None = None) -> tuple[dict[str, list[str]], bytes, int] | None:
    """Headers, body and stored size of the next record; None at the end.

    Where the id is missing one is derived from ``origin`` and ``offset``, and the
    date is left out, so reading twice gives the same. Without Content-Length the body is empty and no footer is read.
    ``line``: the version line, where it was read already.
    """
    line = stream.readline() if line is None else line
    if not line:
        return None
    if line != VERSION:
        raise BadRecord(f"not a version line: {line[:40]!r}")
    headers: dict[str, list[str]] = {"WARC-Type": [""]}
    size, length = len(line), None
    while True:
        line = stream.readline()
        size += len(line)
        if not line.endswith(b"\n"):
            raise BadRecord("the headers are cut off")
        if line == b"\r\n":
            break
        key, mark, value = line.decode("utf-8", "replace").partition(": ")
        if not mark:
            raise BadRecord(f"not a header: {line[:40]!r}")
        value = value[:-2]
        if key == "Content-Length":
            if not value.isdigit():
                raise BadRecord(f"not a length: {value[:40]}")
            length = int(value)
        elif key in SINGLE:
            headers[key] = [value]
        else:
            headers.setdefault(key, []).append(value)
    headers.setdefault("WARC-Record-ID", [f"<urn:sha256:{hashlib.sha256(f'{origin}#{offset}'.encode()).hexdigest()}>"])
    if length is None:
        return headers, b"", size
    body = stream.read(length)
    if len(body) < length:
        raise BadRecord("the body is cut off")
    if stream.read(4) != FOOTER:
        raise BadRecord("no footer")
    return headers, body, size + length + 4


def write_record(headers: dict[str, list[str]], body: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k in sorted(headers) if k != "Content-Length" for v in headers[k]]
    return VERSION + "".join(lines).encode() + b"Content-Length: %d\r\n\r\n" % len(body) + body + FOOTER


def unpacked(stream, path: str):
    """What a stream of a file holds, by the file's suffix; members that follow each other are read as one."""
    if path.endswith(".gz"):
        return gzip.open(stream)
    if path.endswith((".zst", ".zstd")):
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True, closefd=True))
    if path.endswith(".xz"):
        return lzma.open(stream)
    return stream


def _remote(path: str):
    """The file system of a path of another kind than files of this machine, and the path in it; None where it is one of these."""
    if "://" not in path or path.startswith("file://"):
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def opened(path: str):
    """A stream of a file's own bytes, decompressed by its suffix; files of ``hdfs://``, ``s3a://`` and the like too."""
    there = _remote(path)
    return unpacked(open(path.removeprefix("file://"), "rb") if there is None else io.BufferedReader(there[0].open_input_stream(there[1])), path)


def records_of(path: str, on_error: str = "stop") -> Iterator[tuple]:
    """(path, offset, raw_size, headers, body); offsets count decompressed bytes.

    ``on_error``: stop (the file ends at the first bad record), fail, or skip (goes on at the next version line).
    """
    with opened(path) as stream:
        at, line = 0, None
        while True:
            try:
                found = read_record(stream, path, at, line)
            except BadRecord:
                if on_error == "fail":
                    raise
                if on_error == "stop":
                    return
                line = stream.readline()
                while line and line != VERSION:
                    line = stream.readline()
                if not line:
                    return
                at = stream.tell() - len(VERSION)
                continue
            if found is None:
                return
            headers, body, size = found
            yield path, at, size, headers, body
            at, line = at + size, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, offset, size, headers, body = zip(*rows)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.list_(pa.string())), pa.binary())
    columns = (path, offset, size, [list(h.items()) for h in headers], body)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], WARC.names)


def batches_of(path: str, on_error: str = "stop") -> Iterator[pa.RecordBatch]:
    """``records_of`` in batches of about READ_BATCH bytes, so memory doesn't grow with a file or with how many small records make a batch."""
    rows, held = [], 0
    for row in records_of(path, on_error):
        rows.append(row)
        held += row[2]
        if held >= READ_BATCH:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def list_files(path: str) -> list[str]:
    """Files of a folder, of a pattern or of one name; of a folder or a name on ``hdfs://``, ``s3a://`` and the like."""
    if there := _remote(path):
        from pyarrow import fs

        kind = there[0].get_file_info(there[1]).type
        if kind != fs.FileType.Directory:
            return [path]
        found = there[0].get_file_info(fs.FileSelector(there[1], recursive=True))
        return sorted(path.rstrip("/") + f.path[len(there[1].rstrip("/")) :] for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    plain = path.removeprefix("file://")
    p = Path(plain)
    if p.is_dir():
        return sorted(str(f) for f in p.rglob("*") if f.is_file() and not f.name.startswith((".", "_")))
    if any(c in plain for c in "*?["):
        root = Path(plain[: min(plain.index(c) for c in "*?[" if c in plain)]).parent
        return sorted(str(f) for f in root.rglob("*") if f.is_file() and f.match(plain))
    return [plain]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.on_error = options["path"], options.get("onerror", "stop")
        if self.on_error not in ("stop", "skip", "fail"):
            raise ValueError("onError is stop, skip or fail")

    def partitions(self) -> list[InputPartition]:
        return [_Files([p]) for p in list_files(self.path)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from batches_of(path, self.on_error)


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceArrowWriter):
    """Each task writes one file under a name of its own; on commit those are given their last names, on abort they go."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.overwrite = overwrite

    def write(self, arrived: Iterator[pa.RecordBatch]) -> _Written:
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"_part-{uuid.uuid4().hex}.warc")
        with open(name, "wb") as out:
            for b in arrived:
                for headers, body in zip(b.column("headers"), b.column("body")):
                    out.write(write_record(dict(headers.as_py()), body.as_py() or b""))
        return _Written(name)

    def commit(self, messages) -> None:
        import os

        done = [m.name for m in messages if m]
        old = [p for p in list_files(self.path) if p.endswith(".warc")]
        first = 0 if self.overwrite else len(old)
        if self.overwrite:
            for p in old:
                os.remove(p)
        for k, name in enumerate(sorted(done), first):
            os.replace(name, os.path.join(self.path, f"records.{k}.warc"))

    def abort(self, messages) -> None:
        import os

        for m in messages:
            if m and os.path.exists(m.name):
                os.remove(m.name)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``onError`` stop, skip or fail."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return WARC

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, on_error: str = "stop") -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("onError", on_error).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.select("path", "offset", "raw_size", "headers", "body").write.format("warc").mode(mode).save(path)

"""Sampling, dictionary training, compression and rebuilding of collections."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_active
from tidemark.operators.layout import assign_files, warc_filename
from tidemark.schema import ACTIVE, DICTIONARY_BYTES, DICTIONARY_SAMPLES, SPLIT_THRESHOLD


def sample_records(records: DataFrame, collection: str | None = None, n: int = DICTIONARY_SAMPLES) -> DataFrame:
    """The first ``n`` active records by a hash of their ids: the same every time, spread over the collection. Rows that share the last one's id all come.

    Only hashes and ids are brought together, to find the last of them; the records stay where they are.
    """
    live = records.where(is_active(F.col("flags")))
    if collection is not None:
        live = live.where(F.col("collection") == collection)
    place = F.struct(F.md5(F.col("id").cast("string").cast("binary")).alias("h"), F.col("id").alias("i"))
    last = live.select(place.alias("_p")).orderBy("_p").limit(n).agg(F.max("_p").alias("_last"))
    return live.join(F.broadcast(last), place <= F.col("_last")).drop("_last")


def dictionary_id(data: bytes) -> int:
    return int.from_bytes(data[4:8], "little")


def train_dictionary(samples: DataFrame, taken: set[int] = frozenset(), size: int = DICTIONARY_BYTES, body: str = "body", seed: int | None = None) -> tuple[int, bytes]:
    """A zstd dictionary and its id from a sample table, which is brought to one task; only the dictionary comes to the driver. An id that is taken gives way to a drawn one."""

    def train(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        texts = sorted(v for b in arrived for v in b.column(0).to_pylist())
        if texts:
            fits = max(256, min(size, sum(map(len, texts)) // 8))
            yield pa.RecordBatch.from_pydict({"data": pa.array([zstandard.train_dictionary(fits, texts).as_bytes()], pa.binary())})

    texts = samples.select(F.col(body).cast("binary").alias("body")).where("body IS NOT NULL")
    found = texts.repartition(1).mapInArrow(train, "data binary").collect()
    if not found:
        raise ValueError("there is nothing to train a dictionary on")
    data = bytes(found[0]["data"])
    number, draw = dictionary_id(data), random.Random(seed)
    while number in taken:
        number = draw.randrange(2**31 - 32768) + 32768
    return number, data[:4] + number.to_bytes(4, "little") + data[8:]


def compressed(body: Column, dictionary: bytes | None = None, level: int = 3, back: bool = False) -> Column:
    """Each value as one zstd frame, or out of one (``back``); the dictionary travels with the function. Without a dictionary values stay as they are."""
    if dictionary is None:
        return body.cast("binary")

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary)
        tool = zstandard.ZstdDecompressor(dict_data=known).decompress if back else zstandard.ZstdCompressor(level=level, dict_data=known).compress
        return values.map(lambda v: None if v is None else tool(bytes(v)))

    return run(body.cast("binary"))


def rebuild(records: DataFrame, dictionary: bytes | None, dict_id: int | None, old: bytes | None = None, threshold: int = SPLIT_THRESHOLD, level: int = 3, body: str = "raw") -> DataFrame:
    """Records of a collection encoded anew: ``raw``, raw_size, filename, offset, dict_id and dict_type change; flags and all else stay.

    ``body`` holds the stored bytes, decoded with ``old`` first. Files split above the
    threshold. The result is a snapshot to be written beside the old one; readers keep
    theirs until the pointer to it is changed.
    """
    plain = compressed(F.col(body), old, back=True)
    fresh = records.withColumn("_plain", plain).withColumn(body, compressed(F.col("_plain"), dictionary, level)).drop("_plain")
    fresh = fresh.withColumn("raw_size", F.octet_length(body).cast("bigint"))
    placed = assign_files(fresh, threshold, inclusive=False)
    number, kind = F.lit(dict_id).cast("bigint"), F.lit("zstd" if dictionary is not None else None).cast("string")
    names = placed.select(F.col("id"), warc_filename(F.col("file_no"), number, kind).alias("filename"), "offset")
    kept = fresh.drop("filename", "offset", "dict_id", "dict_type")
    return kept.join(names, "id").withColumns({"dict_id": number, "dict_type": kind})


def inactive(records: DataFrame) -> DataFrame:
    """Rows of a snapshot that isn't in use yet."""
    return records.withColumn("flags", F.col("flags").bitwiseAND(F.lit(~ACTIVE)).cast("int"))

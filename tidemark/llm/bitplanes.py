"""Token ids in fixed-size blocks, shuffled into bit or byte planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._bpe import DEFAULT_VOCABULARY, encode
from tidemark.llm._frames import map_frames
from tidemark.llm._text import batches

#: Ids in a block; the last block of a shard may have fewer.
BLOCK = 1 << 16


def pack(ids: np.ndarray, planes: str = "bit", level: int = 3) -> tuple[bytes, list[int]]:
    """The planes of a block, most significant first, each compressed; and the place where each ends."""
    raw = ids.astype(">u4").view(np.uint8).reshape(len(ids), 4)
    rows = np.packbits(np.unpackbits(raw, axis=1).T, axis=1) if planes == "bit" else np.ascontiguousarray(raw.T)
    coder = zstandard.ZstdCompressor(level=level)
    parts = [coder.compress(r.tobytes()) if r.any() else b"" for r in rows]  # a plane of zeros takes no room
    return b"".join(parts), np.cumsum([len(p) for p in parts]).tolist()


def unpack(payload: bytes, ends: list[int], n: int, planes: str = "bit") -> np.ndarray:
    width = -(-n // 8) if planes == "bit" else n
    rows = np.zeros((len(ends), width), np.uint8)
    coder, start = zstandard.ZstdDecompressor(), 0
    for k, end in enumerate(ends):
        if end > start:
            rows[k] = np.frombuffer(coder.decompress(payload[start:end]), np.uint8)
        start = end
    raw = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1) if planes == "bit" else rows.T
    return np.ascontiguousarray(raw).view(">u4").ravel().astype(np.int32)


def bit_planes(
    docs: DataFrame, planes: str = "bit", block: int = BLOCK, vocabulary: str = DEFAULT_VOCABULARY, level: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encodes texts and stores their ids in blocks of ``block``, as ``planes`` ("bit" or "byte") compressed one by one.

    Each partition of the input is a shard, numbered as Spark numbers it, so a shard's number tells its blocks apart within
    one result and means nothing beyond it: the ids of its documents one after another.
    Nothing is shuffled. Returns a row for each block: shard, block, first_id (its place
    in the shard), n_ids, planes, plane_ends (where each plane ends in the payload; an
    empty plane is all zeros), payload, and of the documents that begin in it doc_ids,
    doc_starts (places in the shard) and doc_lengths.

    - null text: a document of length -1. Empty text: of length 0. A shard without ids has one block of no ids for them.
    - null doc_id: kept as null. Repeated rows: each is a document. A document may go on over any number of blocks.
    - empty table: empty result. Other columns play no part, whatever their names.
    """
    if planes not in ("bit", "byte"):
        raise ValueError("planes must be 'bit' or 'byte'")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["shard", "block", "first_id", "n_ids", "planes", "plane_ends", "payload", "doc_ids", "doc_starts", "doc_lengths"]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, number, place, held = TaskContext.get().partitionId(), 0, 0, 0
        waiting: list[np.ndarray] = []
        index: list[tuple] = []  # documents that begin in blocks that are still to be written

        def row(ids: np.ndarray) -> tuple:
            nonlocal number, place, index
            end = place + len(ids)
            mine = [d for d in index if d[1] < end] if len(ids) == block else index
            index = index[len(mine) :]
            payload, ends = pack(ids, planes, level)
            out = (shard, number, place, len(ids), planes, ends, payload, [d[0] for d in mine], [d[1] for d in mine], [d[2] for d in mine])
            number, place = number + 1, end
            return out

        for frame in batches(frames, "text", 1 << 20):
            out = []
            for i, text in zip(frame.id, frame.text):
                ids = None if text is None else encode(text, vocabulary)
                index.append((None if pd.isna(i) else i, place + held, -1 if ids is None else len(ids)))
                if ids is not None and len(ids):
                    waiting.append(ids)
                    held += len(ids)
                if held >= block:
                    joined = np.concatenate(waiting)
                    whole = held - held % block
                    for at in range(0, whole, block):
                        out.append(row(joined[at : at + block]))
                    waiting, held = [joined[whole:]], held - whole
            if out:
                yield pd.DataFrame(out, columns=names)
        if held or index:
            yield pd.DataFrame([row(np.concatenate(waiting) if waiting else np.zeros(0, np.int32))], columns=names)

    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_frames(
        work,
        write,
        f"shard int, block int, first_id bigint, n_ids int, planes string, plane_ends array<int>, payload binary, doc_ids array<{kind}>, doc_starts array<bigint>, doc_lengths array<int>",
    )


def read_planes(blocks: DataFrame) -> DataFrame:
    """doc_id and ids (null for a null text) of every document of a table from ``bit_planes``; none of an empty one. Other columns must not be left out, more play no part."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, ids, place, open_ = None, np.zeros(0, np.int32), 0, []
        for frame in frames:
            out = []
            for b in frame.itertuples(index=False):
                if b.shard != shard:
                    shard, ids, place, open_ = b.shard, np.zeros(0, np.int32), 0, []
                ids = np.concatenate((ids, unpack(bytes(b.payload), list(b.plane_ends), b.n_ids, b.planes)))
                open_ += list(zip(list(b.doc_ids), b.doc_starts, b.doc_lengths))
                done = 0
                for i, start, length in open_:
                    if start + max(length, 0) > place + len(ids):
                        break
                    out.append((i, None if length < 0 else ids[start - place : start - place + length]))
                    done += 1
                open_ = open_[done:]
                keep = open_[0][1] if open_ else place + len(ids)
                ids, place = ids[keep - place :], keep
            yield pd.DataFrame({"doc_id": pd.Series([i for i, _ in out], dtype=object), "ids": pd.Series([v for _, v in out], dtype=object)})

    return map_frames(blocks.repartition("shard").sortWithinPartitions("shard", "block"), read, f"doc_id {kind}, ids array<int>", exact=("doc_ids",))


def op6_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_planes(spark.read.parquet(f"{sf_dir}/documents.parquet"))

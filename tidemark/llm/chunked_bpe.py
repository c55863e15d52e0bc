"""BPE encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise
from tidemark.llm._bpe import DEFAULT_VOCABULARY, decode, encode, token_bytes
from tidemark.llm._frames import map_frames
from tidemark.llm._text import U64, batches, mix

#: Bytes that the rolling hash looks back on; one place in 2**CUT_BITS is a cut; no chunk is longer than MOST.
WINDOW, CUT_BITS, MOST = 32, 9, 1 << 14
_GEAR = (mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)
#: Characters of text, or ids, that a task handles at a time.
BATCH = 1 << 18
#: Hashes of shared chunks that may be sent to every worker: 8 bytes each, so 32 MB at most.
BROADCAST_HASHES = 4_000_000


@dataclass
class Chunks:
    """Chunks of a batch: document, first and past-the-last byte in that document's UTF-8, both halves of a 128-bit hash; document d owns ``first[d]:first[d+1]``."""

    raw: list[bytes]
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    more: np.ndarray
    first: np.ndarray


def cut_chunks(texts: list[str | None]) -> Chunks:
    """Cuts depend on the WINDOW bytes before them alone, and stand between characters. Null and empty texts have no chunks."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    base = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=base[1:])
    n = len(data)
    at = np.zeros(0, np.int64)
    if n > WINDOW:
        rolled, back = _GEAR[data], 1  # the sum of gear[byte k places back] << k, by doubling the stretch that it covers
        while back < WINDOW:
            rolled[back:] += rolled[:-back] << np.uint32(back)
            back *= 2
        at = np.flatnonzero((rolled[WINDOW - 1 : -1] >> np.uint32(32 - CUT_BITS) == 0) & (data[WINDOW:] & 0xC0 != 0x80)) + WINDOW
        owner = np.searchsorted(base, at, side="right") - 1
        at = at[at - base[owner] >= WINDOW]  # the window lies within one document
    full = np.unique(base)
    ends = np.union1d(at, full[1:])
    start = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    if len(ends) and (ends - start).max() > MOST:
        more = []
        for last, e in zip(start, ends):
            while e - last > MOST:
                last += MOST
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                more.append(last)
            more.append(e)
        ends = np.array(more, np.int64)
        start = np.concatenate(([0], ends[:-1]))
    first = np.searchsorted(start, base)
    owner = np.repeat(np.arange(len(raw)), np.diff(first))
    begin, end = start - base[owner], ends - base[owner]
    digests = b"".join([xxhash.xxh3_128_digest(raw[d][p:q]) for d, p, q in zip(owner.tolist(), begin.tolist(), end.tolist())])
    hashed = np.frombuffer(digests, U64).reshape(-1, 2)
    return Chunks(raw, begin, end, np.ascontiguousarray(hashed[:, 1]), np.ascontiguousarray(hashed[:, 0]), first)


def safe_points(data: np.ndarray) -> np.ndarray:
    """Places of a blank between two visible ASCII characters: the pattern always cuts there, whatever else is around."""
    seen = (data > 0x20) & (data < 0x7F)
    return np.flatnonzero(seen[:-2] & (data[1:-1] == 0x20) & seen[2:]) + 1


def join_parts(parts: list[np.ndarray], vocabulary: str = DEFAULT_VOCABULARY) -> np.ndarray:
    """Ids of a text from the ids of consecutive pieces: what lies around each join is encoded again.

    The stretch from the last safe point before a join to the first one after it is
    re-encoded. If its ends don't fall on token boundaries of the pieces, it grows, at
    last to the whole text, so the result always equals the ids of the whole text.
    """
    parts = [p for p in parts if len(p)]
    if len(parts) < 2:
        return parts[0] if parts else np.zeros(0, np.int32)
    table, sizes = token_bytes(vocabulary)
    ids = np.concatenate(parts)
    raw = b"".join([table[i] for i in ids])
    edge = np.concatenate(([0], np.cumsum(sizes[ids])))
    joins = edge[np.cumsum([len(p) for p in parts])[:-1]]
    safe = np.concatenate(([0], safe_points(np.frombuffer(raw, np.uint8)), [len(raw)]))
    safe = safe[np.isin(safe, edge, assume_unique=True)]  # the pieces agree with these boundaries
    # a safe point holds on its side of a join if its three bytes lie on that side
    low = np.maximum(np.searchsorted(safe, joins - 2, side="right") - 1, 0)
    high = np.minimum(np.searchsorted(safe, joins + 1, side="left"), len(safe) - 1)
    out, last = [], 0
    k = 0
    while k < len(joins):
        a, b = safe[low[k]], safe[high[k]]
        while k + 1 < len(joins) and safe[low[k + 1]] < b:
            k += 1
            b = max(b, safe[high[k]])
        out += [ids[last : np.searchsorted(edge, a)], encode(raw[a:b].decode("utf-8"), vocabulary)]
        last = np.searchsorted(edge, b)
        k += 1
    return np.concatenate([*out, ids[last:]])


def _narrow(ids: np.ndarray) -> bytes:
    return ids.astype(np.uint16).tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\1" + ids.astype(np.int32).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16).astype(np.int32) if len(raw) % 2 == 0 else np.frombuffer(raw[1:], np.int32)


def _chunk_hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, "text", BATCH):
        yield pd.DataFrame({"hash": cut_chunks(frame.text.tolist()).hashes.view(np.int64)})


def encode_chunked(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each text, exactly those of encoding it whole.

    A rolling hash cuts texts into chunks. Chunks that occur more than once in the table
    are encoded once; texts without any are encoded where they are read, and don't move.
    The others are put together from shared chunks, which 128-bit hashes tell apart, and the runs between them, and the
    joins are repaired. Equal texts are put together once.

    Returns doc_id, n_tokens, ids for each row.

    - null text: ids null, n_tokens 0. Empty text: no ids. Null doc_id: handled as any other row.
    - repeated rows: each gives a row. Empty table: empty result. Texts are encoded whole, however long.
    - other columns play no part, whatever their names.
    """
    spark = docs.sparkSession
    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    hashes = work.select("text").mapInPandas(_chunk_hashes, "hash bigint")
    shared = materialise(hashes.groupBy("hash").count().where("count > 1").select("hash"), "shared-chunks")
    small = shared.count() <= BROADCAST_HASHES
    if small:
        known = spark.sparkContext.broadcast(np.sort(shared.toArrow().to_pandas()["hash"].to_numpy(np.int64)))

    def shared_of(hashed: np.ndarray) -> np.ndarray:
        if not small:
            return np.ones(len(hashed), bool)  # which of them are shared is found by a join
        table = known.value
        if not len(table):
            return np.zeros(len(hashed), bool)
        value = hashed.view(np.int64)
        return table[np.minimum(np.searchsorted(table, value), len(table) - 1)] == value

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", BATCH):
            texts = frame.text.tolist()
            cut = cut_chunks(texts)
            common = np.concatenate(([0], np.cumsum(shared_of(cut.hashes))))[cut.first]
            out = []
            for k, (t, moves) in enumerate(zip(texts, np.diff(common))):
                if t is None:
                    out.append((k, 0, None))
                elif not moves:
                    ids = encode(t, vocabulary)
                    out.append((k, len(ids), ids))
            made = pd.DataFrame(out, columns=["at", "n_tokens", "ids"])
            yield made.assign(doc_id=frame.id.array.take(made["at"].to_numpy(np.int64)))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text", BATCH):
            cut = cut_chunks(frame.text.tolist())
            common = shared_of(cut.hashes)
            out = []
            for d, (one, two) in enumerate(zip(frame.k1, frame.k2)):
                a, b = cut.first[d], cut.first[d + 1]
                mine = common[a:b]
                if not mine.any():
                    continue
                run = np.flatnonzero(mine | np.concatenate(([True], mine[:-1]))) + a  # runs of other chunks stay together
                for p, q in zip(run, np.append(run[1:], b)):
                    name = (int(cut.hashes[p].view(np.int64)), int(cut.more[p].view(np.int64))) if common[p] else (None, None)
                    body = None if small and common[p] else cut.raw[d][cut.start[p] : cut.end[q - 1]]
                    out.append((one, two, int(cut.start[p]), *name, body))
            k1, k2, at, one, two, body = zip(*out) if out else ((),) * 6
            # hashes beside nulls would become doubles
            yield pd.DataFrame({"k1": k1, "k2": k2, "at": at, "hash": pd.array(one, "Int64"), "more": pd.array(two, "Int64"), "body": pd.Series(body, dtype=object)})

    def shared_bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each shared chunk once for each batch."""
        for frame in batches(frames, "text", BATCH):
            cut = cut_chunks(frame.text.tolist())
            owner = np.repeat(np.arange(len(frame)), np.diff(cut.first))
            on = np.flatnonzero(shared_of(cut.hashes))
            on = on[np.unique(np.stack((cut.hashes[on], cut.more[on]), axis=1), axis=0, return_index=True)[1]]
            body = [cut.raw[d][p:q] for d, p, q in zip(owner[on], cut.start[on], cut.end[on])]
            yield pd.DataFrame({"hash": cut.hashes[on].view(np.int64), "more": cut.more[on].view(np.int64), "body": body})

    def encoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "body", BATCH):
            yield frame.assign(body=[_narrow(encode(bytes(b).decode("utf-8"), vocabulary)) for b in frame.body])

    def together(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of equal texts follow each other; only the first of them is put together."""
        last, ids = None, np.zeros(0, np.int32)
        for frame in frames:
            parts, keys = frame.column("parts"), list(zip(frame.column("k1").to_pylist(), frame.column("k2").to_pylist()))
            body, rows = parts.values.field("body"), parts.offsets.to_numpy()
            ends, data = np.frombuffer(body.buffers()[1], np.int32)[body.offset :].tolist(), memoryview(body.buffers()[2] or b"")
            out, begin, held = [], 0, 0
            for r, key in enumerate(keys):
                if key != last:
                    last, ids = key, join_parts([_wide(data[ends[j] : ends[j + 1]]) for j in range(rows[r], rows[r + 1])], vocabulary)
                out.append(ids)
                held += len(ids)
                if held > BATCH or r + 1 == len(keys):
                    sizes = np.fromiter(map(len, out), np.int32, len(out))
                    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.concatenate(out).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([frame.column("id").slice(begin, len(out)), pa.array(sizes), lists], ["doc_id", "n_tokens", "ids"])
                    out, begin, held = [], r + 1, 0
            pa.default_memory_pool().release_unused()  # what Arrow keeps of past batches counts as the executor's

    shape = f"doc_id {kind}, n_tokens int, ids array<int>"
    keyed = work.where(F.length("text") > 0).select("id", F.xxhash64("text").alias("k1"), F.hash("text", F.length("text")).alias("k2"), "text")
    cut = keyed.select("k1", "k2", "text").mapInPandas(pieces, "k1 bigint, k2 int, at bigint, hash bigint, more bigint, body binary")
    cut = materialise(cut.groupBy("k1", "k2", "at").agg(F.first("hash").alias("hash"), F.first("more").alias("more"), F.first("body").alias("body")), "chunks")
    single = cut.where("hash IS NULL")
    many = cut.where("hash IS NOT NULL")
    if not small:
        once = many.join(shared, "hash", "left_anti")
        single, many = single.unionByName(once.select(single.columns)), many.join(shared, "hash", "left_semi")
    # where a task knows what is shared, the bodies of shared chunks are brought together by themselves
    bodies = keyed.select("text").mapInPandas(shared_bodies, "hash bigint, more bigint, body binary") if small else many
    book = bodies.groupBy("hash", "more").agg(F.first("body").alias("body")).mapInPandas(encoded, "hash bigint, more bigint, body binary")
    placed = many.select("k1", "k2", "at", "hash", "more").join(book, ["hash", "more"]).select("k1", "k2", "at", "body")
    rest = single.select("k1", "k2", "at", "body").mapInPandas(encoded, "k1 bigint, k2 int, at bigint, body binary")
    lists = placed.union(rest).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
    named = lists.join(keyed.select("id", "k1", "k2"), ["k1", "k2"]).select("id", "k1", "k2", "parts").mapInArrow(together, shape)
    return map_frames(work, alone, shape).union(named)


def decode_ids(tokens: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids.

    Null ids give a null text, no ids an empty one; null doc_ids and repeated rows each give a row, an empty table gives none. Other columns play no part.
    """

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame.id.array, "text": [None if v is None else decode(v, vocabulary) for v in frame.ids]}, columns=["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return map_frames(tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), decoded, f"doc_id {kind}, text string")


def op8_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_chunked(spark.read.parquet(f"{sf_dir}/documents.parquet"))

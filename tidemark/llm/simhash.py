"""SimHash near-duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise
from tidemark.llm._frames import map_frames
from tidemark.llm._graph import components, forest
from tidemark.llm._text import U64, batches, mix, split_words
from tidemark.llm._tiles import Side, compare_all, near_by_parts, near_in_tiles, parts_pay

BITS, WORDS = 256, 4
HASHES = [f"h{k}" for k in range(WORDS)]
#: Rows of a task that compares: the more, the more of them share a value of a part.
MOST_ROWS = 1 << 17
#: Ids that may be broadcast: some 32 bytes each, so about 32 MB at most.
BROADCAST_IDS = 1_000_000
_SPREAD = np.array([int.from_bytes(bytes(b >> k & 1 for k in range(8)), "little") for b in range(256)], U64)
_STEP = U64(0x9E3779B97F4A7C15)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words and word pairs of each text: document index and 48-bit hash, sorted by both."""
    w = split_words(texts)
    doc = w.doc.astype(U64)
    pair = (w.hashes[:-1] * _STEP + w.hashes[1:])[doc[:-1] == doc[1:]]
    owner = np.concatenate((doc, doc[:-1][doc[:-1] == doc[1:]]))
    key = np.sort((owner << U64(48)) | (mix(np.concatenate((w.hashes, pair))) >> U64(16)))
    key = key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))]
    return (key >> U64(48)).astype(np.int64), key & U64((1 << 48) - 1)


def fingerprints(texts: list[str | None], slab: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) words of the 256-bit SimHash of each text's distinct words and word pairs, and how many these are.

    Bit k is set if more than half of the features' hashes have it. The sums are kept
    in byte lanes of 64-bit words, at most 255 features each, and then added up.
    """
    doc, hashed = features(texts)
    counts = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    votes = np.zeros((len(texts), BITS), np.int32)
    shift = np.arange(1, WORDS + 1, dtype=U64) * _STEP
    for at in range(0, len(hashed), slab):
        owner = doc[at : at + slab]
        lanes = _SPREAD[mix(hashed[at : at + slab, None] + shift).view(np.uint8)]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        since = np.arange(len(owner)) - np.repeat(first, np.diff(first, append=len(owner)))
        cut = np.flatnonzero(since % 255 == 0)
        part = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).reshape(len(cut), BITS)
        head = np.flatnonzero(np.diff(owner[cut], prepend=-1))
        votes[owner[cut][head]] += np.add.reduceat(part, head, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view(U64).reshape(len(texts), WORDS), counts


def _fingerprint_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, "text", 1 << 20):
        prints, counts = fingerprints(frame.text.tolist())
        signed = prints.view(np.int64)
        yield pd.DataFrame({"id": frame.id.array, "n": counts} | {h: signed[:, k] for k, h in enumerate(HASHES)})


def _forest_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what ``pairs`` join, one less than the nodes of each component."""
    a, b = (np.concatenate(x) for x in zip(*pairs))
    nodes, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = forest(len(nodes), where[: len(a)], where[len(a) :])
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def near_pairs(rows: Side, chunk: Side, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that differ in at most ``radius`` bits, each once, by parts of words or in tiles, whichever is cheaper."""
    if parts_pay(rows, chunk, radius, same):
        yield from near_by_parts(rows, chunk, radius, same)
        return
    # three words, 192 bits, are compared for all; the fourth for what is left
    for p, q in near_in_tiles(rows, chunk, radius, same, (0, 1, 2), radius):
        ok = np.bitwise_count(rows.words[p] ^ chunk.words[q]).sum(1) <= radius
        yield p[ok], q[ok]


def _compare(radius: int):
    def compare(rows: Side, chunk: Side, same: bool) -> pd.DataFrame:
        links, others, pairs, held = np.zeros(len(rows.ids), np.int64), np.zeros(len(chunk.ids), np.int64), [], 0
        for p, q in near_pairs(rows, chunk, radius, same):
            np.add.at(links, p, chunk.copies[q])
            np.add.at(others, q, rows.copies[p])
            pairs.append((p, len(rows.ids) + q))
            held += len(p)
            if held > 1 << 20:
                pairs, held = [_forest_of(pairs)], 0
        a, b = _forest_of(pairs) if pairs else (np.zeros(0, np.int64),) * 2
        ids = np.concatenate((rows.ids, chunk.ids))
        on, off = np.flatnonzero(links), np.flatnonzero(others)
        edges = pd.DataFrame({"a": ids[a], "b": ids[b]})
        counts = pd.DataFrame({"a": np.concatenate((rows.ids[on], chunk.ids[off])), "links": np.concatenate((links[on], others[off]))})
        return pd.DataFrame({
            "a": np.concatenate((edges.a.to_numpy(), counts.a.to_numpy())),
            "b": pd.Series(np.append(edges.b.to_numpy().astype(object), np.full(len(counts), None))),
            "links": np.concatenate((np.zeros(len(edges), np.int64), counts.links.to_numpy(np.int64))),
        })

    return compare


def near_duplicates(docs: DataFrame, radius: int = 56, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose SimHashes are near; the least doc_id of each group is kept.

    Two documents are near if their 256-bit SimHashes differ in at most ``radius`` bits.
    The comparison is exact: equal fingerprints are first made one, then all pairs of
    distinct ones are compared in tiles, in order of population count (see ``_tiles``);
    tile pairs whose population counts differ beyond the radius are passed over. Groups
    are the connected components. Tasks return spanning forests and counts, never the
    pairs, so groups of any size stay linear; the comparison itself is quadratic in the
    distinct fingerprints.

    Returns doc_id, fingerprint (hexadecimal), group_id, n_links (how many other documents
    are near), keep; one row for each distinct doc_id.

    - null or empty text, or one without words: fingerprint null, a group of its own, no links, kept.
    - null doc_id: such rows can't be named in a group and give no row.
    - repeated doc_id: one document. If its texts differ, the least fingerprint stands for it.
    - empty table: empty result. Other columns play no part, whatever their names.
    """
    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(id_col).isNotNull())
    kind = docs.schema[id_col].dataType.simpleString()
    raw = map_frames(work, _fingerprint_frames, f"id {kind}, n bigint, " + ", ".join(f"{h} bigint" for h in HASHES))
    prints = materialise(raw.groupBy("id").agg(F.min(F.struct(*HASHES, (F.col("n") > 0).alias("some"))).alias("p")).select("id", "p.*"), "fingerprints")
    size = sum((F.bit_count(h) for h in HASHES[1:]), F.bit_count(HASHES[0])).cast("int")
    same = prints.where("some").groupBy(*HASHES).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    same = materialise(same.select("id", "copies", size.alias("size"), *HASHES), "distinct-fingerprints")
    found = materialise(compare_all(same, HASHES, [], radius, _compare(radius), f"a {kind}, b {kind}, links bigint", "near-fingerprints", MOST_ROWS), "near-fingerprints")
    root = components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("links"))
    known = same.join(links.withColumnRenamed("a", "id"), "id", "left").join(root.withColumnRenamed("node", "id"), "id", "left")
    known = known.select(*HASHES, F.coalesce("root", "id").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.lit(True).alias("some"))
    out = prints.join(known, [*HASHES, "some"], "left")
    shown = F.when(F.col("some"), F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in HASHES])))
    group = F.coalesce("root", "id")
    return out.select(
        F.col("id").alias("doc_id"), shown.alias("fingerprint"), group.alias("group_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"), (group == F.col("id")).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The input's rows without those that ``near_duplicates`` doesn't keep; of rows with the same doc_id, one stays.

    Rows with a null doc_id, or without words, all stay. Of rows with one doc_id and different texts, the
    first by hash of the whole row stays. An empty table gives an empty one; all columns stay as they are.
    """
    gone = near_duplicates(docs, id_col=id_col, **how).where(~F.col("keep")).select(F.col("doc_id").alias(id_col))
    gone = materialise(gone, "near-duplicates")
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(docs.columns)
    many = materialise(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "repeated-ids")
    repeated = many.count()
    if not repeated:
        return left
    # only rows with repeated ids are brought together
    many = F.broadcast(many) if repeated <= BROADCAST_IDS else many
    spare = "hash"
    while spare in docs.columns:
        spare += "_"
    alike = left.join(many, id_col, "left_semi").withColumn(spare, F.xxhash64(*docs.columns))
    first = Window.partitionBy(id_col).orderBy(spare)
    one = alike.withColumn(spare, F.row_number().over(first)).where(F.col(spare) == 1)
    return left.join(many, id_col, "left_anti").select(docs.columns).union(one.select(docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

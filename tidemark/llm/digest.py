"""Document fingerprints: quartile bucket digests of byte triplets, and their difference score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise
from tidemark.llm._frames import map_frames
from tidemark.llm._text import U64, batches, mix
from tidemark.llm._tiles import Side, compare_all, near_in_tiles

BUCKETS = 128
#: Places within five bytes whose triplets are counted.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
#: A shorter text, in bytes, has no digest, nor one whose third quartile is 0.
LEAST = 50
#: One step of the length code is a tenth in length; a difference of more than one step costs this much a step, as in the quartile ratios.
STEP = 12
_TABLE = [(mix(np.arange(256, dtype=U64) + U64(1000 * k + 7)) >> U64(32)).astype(np.uint32) for k in range(3 * len(TRIPLETS))]


def bucket_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many triplets of each text fall in each bucket, and the texts' lengths in bytes."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    total = np.zeros(len(raw) * BUCKETS, np.int64)
    n = len(data) - 4
    if n > 0:
        owner = np.repeat(np.arange(len(raw)), sizes)
        inside = owner[:n] == owner[4:]  # the five bytes are of one text
        base = (owner[:n] * BUCKETS)[inside]
        for k, places in enumerate(TRIPLETS):
            h = sum(_TABLE[3 * k + j][data[p : p + n]] * np.uint32(0x9E3779B1 + 2 * j) for j, p in enumerate(places))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            total += np.bincount(base + (h >> np.uint32(25))[inside], minlength=len(total))
    return total.reshape(len(raw), BUCKETS), sizes


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: whether it has a digest; head (length code, two quartile ratios); six 64-bit words of thermometer codes.

    A bucket's code 0-3 is the number of quartiles that its count exceeds. Words 0-1
    have a bit for each bucket above the first quartile, 2-3 the second, 4-5 the third.
    """
    count, sizes = bucket_counts(texts)
    order = np.sort(count, axis=1)
    q = order[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    good = (sizes >= LEAST) & (q[:, 2] > 0)
    code = np.minimum(np.log(np.maximum(sizes, 1)) / np.log(1.1), 255).astype(np.int64)
    third = np.maximum(q[:, 2], 1)
    head = np.stack((code, q[:, 0] * 100 // third % 16, q[:, 1] * 100 // third % 16), axis=1)
    above = np.stack([np.packbits(count > q[:, k, None], axis=1, bitorder="little") for k in range(3)], axis=1)
    return good, head, np.ascontiguousarray(above).reshape(len(texts), -1).view(U64)


def hexadecimal(head: np.ndarray, words: np.ndarray) -> list[str]:
    """Length code, quartile ratios and two bits a bucket, in 68 digits."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 3, 16), axis=2, bitorder="little")
    codes = bits.sum(1, dtype=np.uint8)
    body = (codes[:, 0::4] << 6) | (codes[:, 1::4] << 4) | (codes[:, 2::4] << 2) | codes[:, 3::4]
    return [f"{a:02x}{b:x}{c:x}{bytes(row).hex()}" for (a, b, c), row in zip(head.tolist(), body)]


def difference(head_a: np.ndarray, a: np.ndarray, head_b: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """Difference scores of digests row by row; those beyond ``bound`` are bound + 1.

    Length codes and quartile ratios (a ring of 16) cost their difference if it is 0 or
    1, else STEP for each further step. Buckets cost the difference of their codes, 6
    where it is 3. Buckets aren't looked at where the head alone is beyond the bound.
    """
    gap = np.abs(head_a - head_b)
    gap[:, 1:] = np.minimum(gap[:, 1:], 16 - gap[:, 1:])
    length = np.where(gap[:, 0] <= 1, gap[:, 0], gap[:, 0] * STEP)
    ratio = np.where(gap[:, 1:] <= 1, gap[:, 1:], (gap[:, 1:] - 1) * STEP).sum(1)
    score = np.minimum(length + ratio, bound + 1)
    on = np.flatnonzero(score <= bound)
    x = a[on] ^ b[on]
    body = np.bitwise_count(x).sum(1, dtype=np.int64) + 3 * np.bitwise_count(x[:, 0:2] & x[:, 2:4] & x[:, 4:6]).sum(1, dtype=np.int64)
    score[on] = np.minimum(score[on] + body, bound + 1)
    return score


_WORDS = [f"w{k}" for k in range(6)]
_HEAD = ["length", "q1", "q2"]


def _digest_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames, "text", 1 << 19):
        good, head, words = digests(frame.text.tolist())
        text = np.array(hexadecimal(head, words), object)
        text[~good] = None
        yield pd.DataFrame({"id": frame.id.array, "digest": text} | {h: head[:, k] for k, h in enumerate(_HEAD)} | {w: words[:, k].view(np.int64) for k, w in enumerate(_WORDS)})


def _compare(bound: int):
    def compare(rows: Side, chunk: Side, same: bool) -> pd.DataFrame:
        near = [np.zeros(len(x.ids), np.int64) for x in (rows, chunk)]
        # best is score << 32 | place of the other's least id among its side's
        best = [np.full(len(x.ids), (bound + 1) << 32, np.int64) for x in (rows, chunk)]
        order = [np.argsort(x.more["least"], kind="stable") for x in (rows, chunk)]
        place = [np.empty(len(o), np.int64) for o in order]
        for o, at in zip(order, place):
            at[o] = np.arange(len(o))
        head = [np.stack((x.size, x.more["q1"], x.more["q2"]), axis=1).astype(np.int64) for x in (rows, chunk)]
        # the second quartile's bits alone can't differ in more bits than the score
        for p, q in near_in_tiles(rows, chunk, 1, same, (2, 3), bound):
            for at in range(0, len(p), 1 << 16):
                a, b = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                score = difference(head[0][a], rows.words[a], head[1][b], chunk.words[b], bound)
                on = np.flatnonzero(score <= bound)
                a, b, score = a[on], b[on], score[on]
                np.add.at(near[0], a, chunk.copies[b])
                np.add.at(near[1], b, rows.copies[a])
                np.minimum.at(best[0], a, score << 32 | place[1][b])
                np.minimum.at(best[1], b, score << 32 | place[0][a])
        out = []
        for k, (x, other) in enumerate(((rows, chunk), (chunk, rows))):
            on = np.flatnonzero(near[k])
            out.append(pd.DataFrame({"a": x.ids[on], "near": near[k][on], "score": best[k][on] >> 32, "nearest": other.more["least"][order[1 - k][best[k][on] & 0xFFFFFFFF]]}))
        return pd.concat(out, ignore_index=True)

    return compare


def fingerprint(docs: DataFrame, bound: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest of each document and, of all others within ``bound``, how many there are and which is nearest.

    Equal digests are made one first. All pairs of distinct ones whose length codes differ
    by no more than one are then compared in tiles (see ``_tiles``); others can't be within
    the bound. So counts and nearest ones are exact, and the comparison is quadratic in the
    digests of about equal length.

    Returns doc_id, digest, n_near, nearest_id (the least id of those nearest), nearest_score; a row for each row.

    - null text, a text of less than 50 bytes (too short for quartiles of 128 buckets to say
      anything) or of too few different triplets: digest null, n_near 0, no nearest.
    - null doc_id: has a digest, but isn't searched for and finds nothing.
    - repeated rows: a doc_id counts once for each digest that it has; rows with the same doc_id aren't neighbours unless their digests differ.
    - ties: of several nearest documents, the one with the least id.
    - empty table: empty result. Other columns play no part, whatever their names.
    """
    if bound >= 2 * STEP:
        raise ValueError(f"bound must be below {2 * STEP}, where length codes further apart can agree")
    kind = docs.schema[id_col].dataType.simpleString()
    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = ", ".join([f"id {kind}", "digest string", *[f"{h} int" for h in _HEAD], *[f"{w} bigint" for w in _WORDS]])
    all_ = materialise(map_frames(work, _digest_frames, shape), "digests")
    named = all_.where("digest IS NOT NULL AND id IS NOT NULL").dropDuplicates(["digest", "id"])
    same = named.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in (*_HEAD, *_WORDS)])
    # stored numbers stand for digests, which are longer
    same = materialise(same.withColumnRenamed("length", "size").withColumn("id", F.monotonically_increasing_id()), "distinct-digests")
    found = compare_all(same.drop("digest"), _WORDS, ["q1", "q2", "least"], 1, _compare(bound), f"a bigint, near bigint, score bigint, nearest {kind}", "near-digests")
    summed = found.groupBy("a").agg(F.sum("near").alias("near"), F.min(F.struct("score", "nearest")).alias("best"))
    copied = same.where("copies > 1").select("digest", "least")
    second = named.select("digest", "id").join(copied, "digest").where(F.col("id") != F.col("least")).groupBy("digest").agg(F.min("id").alias("second"))
    base = same.select("id", "digest", "least", "copies").join(summed.withColumnRenamed("a", "id"), "id", "left").drop("id").join(second, "digest", "left")
    joined = all_.select("id", "digest").join(base, "digest", "left")
    known = F.col("id").isNotNull() & F.col("digest").isNotNull()
    twin = F.when(F.col("copies") > 1, F.when(F.col("id") == F.col("least"), F.col("second")).otherwise(F.col("least")))
    return joined.select(
        F.col("id").alias("doc_id"), "digest",
        F.when(known, F.col("copies") - 1 + F.coalesce("near", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_near"),
        F.when(known, F.coalesce(twin, F.col("best.nearest"))).alias("nearest_id"),
        F.when(known, F.when(twin.isNotNull(), F.lit(0)).otherwise(F.col("best.score"))).cast("int").alias("nearest_score"),
    )


def op5_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))

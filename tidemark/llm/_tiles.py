"""Every pair of a table's rows compared in tiles, without a cross join or copies of rows.

The table is in order of a small number, ``size``, that two near rows can't differ in by
more than ``reach``. It is cut into chunks of at most about CHUNK rows; one after another,
each is sent to all tasks and compared with the rows that stand at or behind it. Tile pairs
whose sizes differ by more than ``reach`` are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise
from tidemark.llm._frames import map_frames
from tidemark.llm._text import U64

#: Rows of a chunk: at most about 90 bytes each are broadcast, so 47 MB whatever the corpus; and rows that a task compares with it.
CHUNK, ROWS = 1 << 19, 8192
TILE, WIDE = 16, 4096
#: Parts into which each word is cut by ``near_by_parts``, words that it compares at a time, and what it costs to look up one value of a part, to compare one pair there, and one pair in tiles (ns, measured).
PARTS, SPAN, VALUE_NS, PAIR_NS, TILE_NS = 5, 1 << 17, 45_000, 3.2, 4.0


class Side:
    """Rows of one side, in order of size: ``words`` has a row of 64-bit words for each."""

    def __init__(self, frame: pd.DataFrame, words: list[str], more: list[str]):
        ids = frame.id.to_numpy()
        order = np.lexsort((ids, frame["size"].to_numpy()))
        self.ids, self.size = ids[order], frame["size"].to_numpy()[order].astype(np.int64)
        self.copies = frame.copies.to_numpy()[order].astype(np.int64)
        self.words = np.stack([frame[w].to_numpy(np.int64)[order] for w in words], axis=1).view(U64)
        self.more = {m: frame[m].to_numpy()[order] for m in more}
        self._columns: np.ndarray | None = None

    @property
    def columns(self) -> np.ndarray:
        """``words`` column by column; made where it is needed and not sent."""
        if self._columns is None:
            self._columns = np.ascontiguousarray(self.words.T)
        return self._columns


def near_in_tiles(one: Side, two: Side, reach: int, same: bool, test: tuple[int, ...], limit: int, tile: int = TILE, wide: int = WIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row of ``one``, row of ``two``) whose words ``test`` differ in at most ``limit`` bits.

    With ``same`` both are parts of one chunk, and only rows of ``two`` that come before in (size, id) are paired.
    """
    spare, tested, total = np.empty((tile, wide), U64), np.empty((tile, wide), np.uint8), np.empty((tile, wide), np.uint8)
    kind = np.uint8 if 64 * len(test) < 256 else np.uint16
    total = total.astype(kind)
    for i in range(0, len(one.size), tile):
        ie = min(i + tile, len(one.size))
        begin = np.searchsorted(two.size, one.size[i] - reach)
        end = np.searchsorted(two.size, one.size[ie - 1] + (0 if same else reach), side="right")
        for j in range(begin, end, wide):
            je = min(j + wide, end)
            x, y, s = spare[: ie - i, : je - j], tested[: ie - i, : je - j], total[: ie - i, : je - j]
            for n, k in enumerate(test):
                np.bitwise_xor(one.columns[k, i:ie, None], two.columns[k, j:je], out=x)
                np.bitwise_count(x, out=y)
                if n:
                    np.add(s, y, out=s)
                else:
                    s[...] = y
            near = np.flatnonzero(s.ravel() <= limit)
            if len(near):
                p, q = np.divmod(near, je - j)
                p, q = p + i, q + j
                ok = np.abs(one.size[p] - two.size[q]) <= reach
                if same:
                    ok &= (two.size[q] < one.size[p]) | ((two.size[q] == one.size[p]) & (two.ids[q] < one.ids[p]))
                if ok.any():
                    yield p[ok], q[ok]


@lru_cache
def _flips(bits: int, most: int) -> np.ndarray:
    """All numbers of ``bits`` bits of which at most ``most`` are set."""
    every = np.arange(1 << bits)
    return every[np.bitwise_count(every) <= most]


def parts_of(words: int, limit: int, parts: int = PARTS) -> list[tuple[int, int, int, int, int]]:
    """(word, shift, bits, most differing bits of the part, of its word) of the parts of each word.

    If rows differ in at most ``limit`` bits, some word and some part of that word keep
    their most: one more than the most of each part, added up, is ``limit`` + 1.
    """
    each, more = divmod(limit + 1, words * parts)
    most = [each - (k >= more) for k in range(words * parts)]  # part k % words of each word after the other
    out = []
    for w in range(words):
        shift, mine = 0, most[w::words]
        for k, m in enumerate(mine):
            bits = 64 // parts + (k < 64 % parts)
            out.append((w, shift, bits, m, sum(mine) + parts - 1))
            shift += bits
    return out


def _values(side: Side, word: int, shift: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's value of a part, and how many rows have each value."""
    value = ((side.columns[word] >> U64(shift)) & U64((1 << bits) - 1)).astype(np.int64)
    return value, np.bincount(value, minlength=1 << bits)


def parts_pay(one: Side, two: Side, limit: int, same: bool) -> bool:
    """Whether ``near_by_parts`` takes less time than tiles: pairs with a near part are counted, not guessed."""
    half = 2 if same else 1
    budget, cost = len(one.ids) * len(two.ids) / half * TILE_NS, 0.0
    for word, shift, bits, most, _ in parts_of(len(one.columns), limit):
        (_, mine), (_, others) = _values(one, word, shift, bits), _values(two, word, shift, bits)
        on = np.flatnonzero(others)
        near = sum((mine[on ^ m] for m in _flips(bits, most)), np.zeros(len(on), np.int64))
        cost += len(on) * VALUE_NS + float(near @ others[on]) / half * PAIR_NS
        if cost >= budget:
            return False
    return True


def near_by_parts(one: Side, two: Side, limit: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row of ``one``, row of ``two``) that differ in at most ``limit`` bits, each once, by parts that are near.

    Rows are put in order of a part's value; those of a value are compared, by the whole
    word, with the rows whose values are near. No pair is missed (see ``parts_of``). One that is near in several
    parts counts in the first. With ``same`` both are parts of one chunk, and of a pair and its reverse one is given.
    """
    plan = parts_of(len(one.columns), limit)
    spare, bits_of = np.empty(max(SPAN, len(one.ids)), U64), np.empty(max(SPAN, len(one.ids)), np.uint8)

    def sift(k: int, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        p, q = (np.concatenate(x) for x in zip(*found))
        x = one.words[p] ^ two.words[q]
        apart = np.bitwise_count(x)
        ok = apart.sum(1) <= limit
        word, shift, bits, _, _ = plan[k]
        if same:  # of equal values both orders come by
            level = (x[:, word] >> U64(shift)) & U64((1 << bits) - 1) == 0
            ok &= ~level | (two.size[q] < one.size[p]) | ((two.size[q] == one.size[p]) & (two.ids[q] < one.ids[p]))
        p, q, x, apart = p[ok], q[ok], x[ok], apart[ok]
        new = np.ones(len(p), bool)
        for word, shift, bits, most, all_most in plan[:k]:
            new &= (apart[:, word] > all_most) | (np.bitwise_count((x[:, word] >> U64(shift)) & U64((1 << bits) - 1)) > most)
        return p[new], q[new]

    for k, (word, shift, bits, most, all_most) in enumerate(plan):
        (a, mine), (b, others) = _values(one, word, shift, bits), _values(two, word, shift, bits)
        by_a, by_b, flips = np.argsort(a.astype(np.uint64), kind="stable"), np.argsort(b.astype(np.uint64), kind="stable"), _flips(bits, most)
        at_a, at_b = (np.concatenate(([0], np.cumsum(n))) for n in (mine, others))
        words_a, words_b = one.columns[word][by_a], two.columns[word][by_b]
        found, held = [], 0
        for v in np.flatnonzero(others).tolist():
            near = flips ^ v
            if same:
                near = near[near >= v]
            n = mine[near]
            wide = int(n.sum())
            if not wide:
                continue
            rows = np.repeat(at_a[near] - np.cumsum(n) + n, n) + np.arange(wide)
            values, step = words_a[rows], max(1, SPAN // wide)
            for lo in range(at_b[v], at_b[v + 1], step):
                hi = min(lo + step, at_b[v + 1])
                x, y = (s[: (hi - lo) * wide].reshape(hi - lo, wide) for s in (spare, bits_of))
                np.bitwise_xor(words_b[lo:hi, None], values, out=x)
                np.bitwise_count(x, out=y)
                hit = np.flatnonzero(y.ravel() <= all_most)
                if len(hit):
                    q, p = np.divmod(hit, wide)
                    found.append((by_a[rows[p]], by_b[lo + q]))
                    held += len(hit)
                    if held > 1 << 18:
                        yield sift(k, found)
                        found, held = [], 0
        if found:
            yield sift(k, found)


def compare_all(table: DataFrame, words: list[str], more: list[str], reach: int, compare: Callable[[Side, Side, bool], pd.DataFrame], shape: str, tag: str, most_rows: int = ROWS) -> DataFrame:
    """``compare(rows, chunk, whether the rows are of that chunk)`` over all pairs of rows of ``table`` (id, copies, size, words, more).

    ``table`` should be a stored one. Its sizes must be few: a row for each comes to the driver.
    A task has from ROWS to about ``most_rows`` rows, fewer where there would be less than two tasks for each core.
    """
    spark = table.sparkSession
    counts = sorted((r["size"], r["rows"]) for r in table.groupBy("size").agg(F.count("*").alias("rows")).collect())
    first, parts, ranges, room = {}, {}, [], 0
    for size, n in counts:
        g = -(-n // CHUNK)
        if g > 1 or n > room:  # a new chunk, or several of one size
            ranges += [[size, size] for _ in range(g)]
            room = CHUNK - n if g == 1 else 0
        else:
            ranges[-1][1], room = size, room - n
        first[size], parts[size] = len(ranges) - g, g
    if not ranges:
        return spark.createDataFrame([], shape)
    pick = lambda d: F.element_at(F.create_map(*[F.lit(int(x)) for kv in d.items() for x in kv]), F.col("size").cast("int"))
    placed = table.withColumn("chunk", (pick(first) + F.pmod(F.xxhash64("id", F.lit(3)), pick(parts))).cast("int"))
    if len(ranges) > 1:
        placed = materialise(placed, f"{tag}-placed")
    total, done = sum(n for _, n in counts), []
    each = max(ROWS, min(most_rows, total // (2 * spark.sparkContext.defaultParallelism)))
    for c, (low, high) in enumerate(ranges):
        chunk = spark.sparkContext.broadcast(Side(placed.where(F.col("chunk") == c).drop("chunk").toArrow().to_pandas(), words, more))

        def run(frames: Iterator[pd.DataFrame], c=c, chunk=chunk) -> Iterator[pd.DataFrame]:
            held, n = [], 0

            def now() -> Iterator[pd.DataFrame]:
                rows = pd.concat(held, ignore_index=True)
                for same in (True, False):
                    mine = rows[(rows.chunk == c) == same]
                    if len(mine):
                        yield compare(Side(mine, words, more), chunk.value, same)

            for frame in frames:
                held.append(frame)
                n += len(frame)
                if n >= 2 * each:
                    yield from now()
                    held, n = [], 0
            if n:
                yield from now()

        rows = placed.where((F.col("chunk") >= c) & (F.col("size") <= high + reach))
        spread = rows.repartition(max(1, -(-total // each)), F.xxhash64("id"))
        part = map_frames(spread, run, shape, exact=())
        if len(ranges) > 1:  # a chunk's results are stored before the next chunk is sent
            part = materialise(part, tag)
            chunk.destroy()
        done.append(part)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out

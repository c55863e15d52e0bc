"""Vectorised byte, word and shingle hashing over batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: 1 where a byte belongs to a word: ASCII letters and digits, and every byte of a non-ASCII character.
WORD_BYTE = np.zeros(256, np.bool_)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_a:_b] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of a batch: hash, first and past-the-last byte in ``data``; document d owns words ``first[d]:first[d+1]``."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    base: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(texts: Iterable[str | None]) -> Words:
    """Words of each text (null counts as empty), ASCII case folded, other characters as they are.

    A word is a run of ASCII letters, digits and non-ASCII characters, so case and
    punctuation don't matter and byte positions are those of the text in UTF-8.
    """
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    base = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(sizes + 1, out=base[1:])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8) if raw else np.zeros(0, np.uint8)
    inside = np.zeros(len(data) + 1, np.bool_)
    inside[:-1] = WORD_BYTE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, U64)
    if len(data):
        np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start])
    return Words(data, hashes, start, end, np.searchsorted(start, base), base)


def batches(frames: Iterator, column: str, most_bytes: int = 4 << 20) -> Iterator:
    """The frames cut so that each holds about ``most_bytes`` characters of ``column``, or one row."""
    for frame in frames:
        sizes = np.fromiter((len(t) if isinstance(t, (str, bytes)) else 0 for t in frame[column]), np.int64, len(frame))
        total, begin = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield frame.iloc[begin:i]
                total, begin = 0, i
            total += int(n)
        if begin < len(frame):
            yield frame.iloc[begin:]


def whole_groups(frames: Iterator, keys: list[str]) -> Iterator:
    """Frames of rows sorted by ``keys``, cut again so that no group of equal keys is split: each frame holds whole groups."""
    import pandas as pd

    held: list = []
    for frame in frames:
        if not len(frame):
            continue
        k = [frame[c].to_numpy() for c in keys]
        change = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        if held and any(held[-1][c].iat[-1] != frame[c].iat[0] for c in keys):
            yield pd.concat(held, ignore_index=True)
            held = []
        if len(change):
            yield pd.concat([*held, frame.iloc[: change[-1]]], ignore_index=True)
            held = []
            frame = frame.iloc[change[-1] :]
        held.append(frame)
    if held:
        yield pd.concat(held, ignore_index=True)

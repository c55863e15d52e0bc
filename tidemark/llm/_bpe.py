"""Public byte-level BPE vocabularies, loaded once in each Python worker."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = DEFAULT_VOCABULARY):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str = DEFAULT_VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The bytes of each id, and how many they are."""
    coder = encoding(path)
    table = [b""] * coder.n_vocab
    for token in coder.token_byte_values():
        table[coder.encode_single_token(token)] = token
    return table, np.fromiter(map(len, table), np.int64, len(table))


def encode(text: str, path: str = DEFAULT_VOCABULARY) -> np.ndarray:
    return np.asarray(encoding(path).encode_ordinary(text), np.int32)


def decode(ids: np.ndarray, path: str = DEFAULT_VOCABULARY) -> str:
    table = token_bytes(path)[0]
    return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

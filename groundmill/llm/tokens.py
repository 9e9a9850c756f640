"""Sizes in tokens of a public byte-level tokenizer, read from a rank file whose path is a parameter.

The file must be at the same path on every executor (it is never copied into this repository).
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import tiktoken

#: The rank file to use where none is named.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max(ranks.values()) + 1
        self._bytes = np.zeros(size, dtype=np.int64)
        self._blank_first = np.zeros(size, dtype=bool)
        self._blank_last = np.zeros(size, dtype=bool)
        for token, rank in ranks.items():
            self._bytes[rank] = len(token)
            self._blank_first[rank] = token[:1].isspace()
            self._blank_last[rank] = token[-1:].isspace()

    def size(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))

    def tokens(self, text: str) -> np.ndarray:
        return np.array(self._encoding.encode_ordinary(text), dtype=np.int64)

    def starts(self, tokens: np.ndarray) -> np.ndarray:
        """Byte offset of each token's start, and of the end."""
        return np.concatenate(([0], np.cumsum(self._bytes[tokens])))

    def word_ends(self, tokens: np.ndarray) -> np.ndarray:
        """Whether a word ends before token i (there is white space on either side of the cut)."""
        ends = self._blank_first[tokens].copy()
        ends[1:] |= self._blank_last[tokens[:-1]]
        return ends


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process and path."""
    return Tokenizer(path)

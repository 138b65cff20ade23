"""Words of a text, and their ids, for the Arrow operators.

A word is a maximal run of Unicode letters and digits (categories L and N) of the lower-cased text.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Python's \w is L, N and the underscore, so this is exactly a run of L and N.
WORD = re.compile(r"[^\W_]+")
#: The same in Java's and RE2's syntax.
SEPARATOR_SQL = r"[^\p{L}\p{N}]+"
#: Entries after which a worker starts its word memo anew, so that its memory is bounded.
MEMO = 500_000


class Ids(dict):
    """word -> 64-bit id, kept by each worker for the words it has met."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def flat_ids(texts: list, ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """The word ids of all texts in one array, and the offsets at which each text starts (one more than texts)."""
    flat: list[int] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            flat.extend(map(ids.__getitem__, WORD.findall(text.lower())))
        offsets[i + 1] = len(flat)
    return np.array(flat, np.uint64), offsets


def grams(flat: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of n words that stay within a text, and the offsets by text."""
    counts = np.maximum(np.diff(offsets) - (n - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(offsets[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    mixed = np.zeros(len(at), np.uint64)
    for k in range(n):
        mixed = (mixed ^ flat[at + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed, bounds

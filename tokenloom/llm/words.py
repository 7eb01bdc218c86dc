"""Hashes of words, computed on the bytes of a whole slice of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tokenloom.llm.batches import flat

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words are runs of ASCII letters, digits and underscores and of any characters beyond ASCII.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            make = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, dtype=np.uint64)]), dtype=np.uint64)
            self.up, self.down = make(np.uint64(BASE)), make(np.uint64(INVERSE))
        return self.up, self.down


def word_hashes(texts: pa.Array, powers: Powers, heads: tuple[int, ...] = (), kinds: np.ndarray = WORD, lower: bool = True) -> tuple:
    """Hash of every word (runs of the bytes in `kinds`, in lower case if `lower`) in reading order, and the n + 1 offsets of the texts'
    words. A word's hash is a polynomial of its bytes, found as a difference of running sums. For each length in
    `heads`, also the hashes of the beginnings of that many bytes, and the words (by number) that are longer."""
    texts = pc.fill_null(texts, "")
    data, offsets = flat(pc.utf8_lower(texts) if lower else texts)
    n = len(data)
    if not n:
        nothing = np.zeros(0, dtype=np.uint64)
        return (nothing, np.zeros(len(texts) + 1, dtype=np.int64), *[(nothing, np.zeros(0, dtype=np.int64))] * len(heads))
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = kinds[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(VALUE[data] * up[:n], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        begun = []
        for size in heads:
            longer = np.flatnonzero(ends - starts > size)
            first = starts[longer]
            begun.append((mix((sums[first + size] - sums[first]) * down[first] + np.uint64(size)), longer))
    return hashes, np.searchsorted(starts, offsets), *begun

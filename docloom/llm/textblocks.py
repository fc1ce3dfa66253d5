"""Vectorised hashing of words in blocks of texts, used by the Arrow stages of this subpackage.

A block is the UTF-8 bytes of some whole texts, joined by line feeds, so that one set of numpy operations serves
thousands of documents.  A word is a run of bytes between separator bytes; as UTF-8 never uses bytes below 0x80
inside a longer character, working on bytes and on code points gives the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a block.  A longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}

#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for exponents 0 to n - 1."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base % (1 << 64)))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive whole texts as bytes (null: empty), at most ``block_bytes`` together, with the first row's index."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    first, held, size = 0, [], 0
    for i, value in enumerate(texts.cast(pa.binary()).to_pylist()):
        value = value or b""
        if held and size + len(value) > block_bytes:
            yield first, held
            first, held, size = i, [], 0
        held.append(value)
        size += len(value) + 1
    if held:
        yield first, held


class Words:
    """The words of a block: their 64-bit hashes in text order, and where each document's words begin."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACE, fold: np.ndarray | None = LOWER):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if fold is not None:
            data = fold[data]
        self.data = data
        apart = separators[data]
        apart[np.cumsum([len(t) + 1 for t in texts]) - 1] = True
        edge = np.flatnonzero(np.diff(apart, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _powers(len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * down[self.start])
        limits = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        #: Word indexes: document i has the words first[i] to first[i + 1] - 1.
        self.first = np.searchsorted(self.start, limits)

    def grams(self, n: int) -> np.ndarray:
        """Hashes of n consecutive words from each word on; only meaningful where all n belong to one document."""
        h = self.hash
        size = max(0, len(h) - n + 1)
        out = np.full(size, np.uint64(n))
        for i in range(n):
            out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + size])
        return out


def sequence_hash(words: np.ndarray) -> np.uint64:
    """One hash of a whole (short) sequence of word hashes; equals that of :meth:`Words.grams` for its length."""
    out = np.full(1, np.uint64(len(words)))
    for w in words:
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + w)
    return out[0]

"""Sets of word shingles, and what the similarity join knows of a set: shingles no other set has, and signatures.

Lone shingles.  A set has at most a known share of its shingles outside any set linked with it.  One with more shingles
than that which occur in no other set is linked with nothing.  To show that, the shingles in a part of the hash range
are looked up, a part little above that share; it is larger for smaller sets, so each set also lists what the smallest
set that can be linked with it looks up.

Signatures.  A document's shingle set is cut by hash into as many classes as two linked documents can differ in
shingles, and some more: then at least one class holds the same shingles in both, so both emit that class's
signature.  How many shingles may differ depends on the sizes, so sizes are cut into geometric bands.  A linked pair
belongs to the band of its larger set; a set just below a band's edge, within the ratio that the triangle inequality
leaves (measured from the empty set), is replicated into the band above.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from docloom.llm.textblocks import Words, mix64, sequence_hash

#: Ratio of the bounds of a size band.
BAND_RATIO = 1.35
#: Classes beyond those that the differences need: this share of them, and some.  So many classes agree in linked sets.
SPARE, MORE = 1 / 6, 3
#: Part of the hash range that is looked up, as a multiple of the share of shingles that may differ; small sets look up more.
LOOK = 1.25
#: Hash functions by whose smallest values sets find pivots.
PIVOTS = 6
#: Binary logarithm of the least number of a profile's parts, and hashes in a part, at most about.
LEAST_BITS, PER_PART = 6, 8


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """For each document of the block, its distinct shingle hashes in ascending order.

    A document of fewer than ``n`` words has its whole sequence as its one shingle; one without words has none.
    """
    grams, sets = words.grams(n), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            sets.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            sets.append(np.array([sequence_hash(words.hash[a:b])], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit hash of each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(np.concatenate([*sets, np.empty(0, np.uint64)])), dtype=np.uint64)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    return mix64(mix64(total[first[1:]] - total[first[:-1]]) + sizes.astype(np.uint64)).view(np.int64)


@lru_cache(maxsize=None)
def band(size: int, percent: int) -> tuple[int, int, int, int, int]:
    """Of the size band that holds ``size``: its number, lower bound, upper bound, number of classes, and how many of
    them at least agree in two linked sets."""
    at, low = 0, 1
    while True:
        high = max(low + 1, int(low * BAND_RATIO))
        if size < high:
            # |x ^ y| <= (100 - p) / (100 + p) * (|x| + |y|), with both sets below the upper bound
            differ = (100 - percent) * 2 * (high - 1) // (100 + percent)
            agree = MORE + int(differ * SPARE) + 1
            return (at, low, high, differ + agree, agree) if differ else (at, low, high, 1, 1)
        at, low = at + 1, high


def _range_end(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Where the looked-up part of the hash range ends, in units of 2**32 of it; never ascends with the size."""
    share = (100 - percent) / 100
    return (np.minimum(1.0, LOOK * share + np.sqrt(share / np.maximum(sizes, 1))) * float(1 << 32)).astype(np.uint64)


def occurrences(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The looked-up shingles of distinct sets, each once: shingle, the least and the greatest hash of a set that has it,
    and how many lone shingles that set may have and still be linked (-1 where it does not look this shingle up)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    row, top = np.repeat(np.arange(len(sets)), sizes), every >> np.uint64(32)
    # a linked set has at least percent/100 of this one's shingles
    listed = np.flatnonzero(top < _range_end(-(-sizes * percent // 100), percent)[row])
    row, top, every = row[listed], top[listed], every[listed]
    spare = np.where(top < _range_end(sizes, percent)[row], (sizes * (100 - percent) // 100)[row], -1)
    order = np.argsort(every, kind="stable")
    every, node, spare = every[order], set_hashes(sets)[row[order]], spare[order]
    at = np.flatnonzero(np.diff(every, prepend=~every[:1]) != 0)
    if not len(at):
        return every.view(np.int64), node, node, spare
    return every[at].view(np.int64), np.minimum.reduceat(node, at), np.maximum.reduceat(node, at), np.maximum.reduceat(spare, at)


def least_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PIVOTS values per non-empty set: its smallest shingle hash under each of so many hash functions."""
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    every = np.concatenate(sets)
    return np.stack([mix64(np.minimum.reduceat(mix64(every + np.uint64(i + 1)), first) + np.uint64(i)) for i in range(PIVOTS)], 1).view(np.int64)


def profiles(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Per set a row of counts (255 at most): how many of its hashes lie in each of equal parts of their range.

    The number of parts is a power of two that grows with the set, so that there are PER_PART hashes in a part or fewer:
    then sets that have nothing in common differ visibly at every size.
    """
    out = []
    for s in sets:
        bits = max(LEAST_BITS, (len(s) // PER_PART).bit_length())
        out.append(np.minimum(255, np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)).astype(np.uint8))
    return out


def profile_gaps(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """For each pair of profiles the sum of their counts' differences, in as many parts as the shorter one has.

    By the triangle inequality two sets differ in at least so many shingles: neither adding up parts nor cutting counts
    off at 255 makes the sum greater.
    """
    out = np.zeros(len(one), np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(one, two, strict=True)], np.int64).reshape(-1, 2)
    for m, k in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == m) & (sizes[:, 1] == k))
        x, y = (np.frombuffer(b"".join([c[i] for i in at]), np.uint8).reshape(len(at), min(m, k), -1).sum(2, dtype=np.int32) for c in (one, two))
        out[at] = np.abs(x - y).sum(1)
    return out


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each set (ascending, distinct hashes): its hash, its signatures, and a tag for each of these.

    A set has the signatures of its band, and those of the band above where a set of that band can still be linked
    with it.  Bands whose linked sets must be equal have no signatures.  Empty classes have none, unless a set has more
    of them than it has classes to spare.  A tag is the band's number times 65536, plus how many of the set's
    signatures in that band at least are shared by any set linked with it in that band.
    """
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate([*sets, np.empty(0, np.uint64)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(every), dtype=np.uint64)])
    whole = set_hashes(sets)
    none = (0, 0, 0, 1, 1)
    own = [band(int(n), percent) if n else none for n in sizes]
    above = [band(b[2], percent) if n and 100 * n >= percent * b[2] else none for n, b in zip(sizes, own, strict=True)]
    out: list[list[np.ndarray]] = [[] for _ in sets]
    tags: list[list[np.ndarray]] = [[] for _ in sets]
    top = every >> np.uint64(32)
    for held in (own, above):
        k = np.array([b[3] for b in held], np.uint64)
        code = np.array([b[0] for b in held], np.uint64)
        row = np.repeat(np.arange(len(sets)), sizes)
        which = (top * k[row]) >> np.uint64(32)  # ascends within a set, as the hashes do
        start = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(which, prepend=np.uint64(0)) != 0))
        end = np.append(start[1:], len(every))
        sig = mix64(mix64(total[end] - total[start] + (end - start).astype(np.uint64)) + (which[start] << np.uint64(32)) + code[row[start]])
        cut = np.searchsorted(row[start], np.arange(len(sets) + 1))
        for i, b in enumerate(held):
            if b[3] > 1:
                mine = sig[cut[i] : cut[i + 1]]
                slack = b[4] - (b[3] - len(mine))
                if slack < 1:  # rare: its empty classes count too
                    empty = np.setdiff1d(np.arange(b[3], dtype=np.uint64), which[start[cut[i] : cut[i + 1]]])
                    mine = np.concatenate([mine, mix64(mix64(np.zeros(len(empty), np.uint64)) + (empty << np.uint64(32)) + code[i])])
                    slack = 1  # a linked set may leave out its empty classes
                out[i].append(mine)
                tags[i].append(np.full(len(mine), b[0] << 16 | slack, np.int32))
    return whole, [np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in out], [np.concatenate(x) if x else np.empty(0, np.int32) for x in tags]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of hashes reach the similarity; an empty set is linked with nothing."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return bool(common) and 100 * common >= percent * union

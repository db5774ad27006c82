"""Soft-decision Golay keys: what near copies at a word-shingle similarity of about 0.8 have in common.

A SimHash fingerprint keeps only the signs of its bit counts, and a hard distance in it cannot reach a similarity
of 0.8: of 64 bits about ten differ there. Here the counts themselves are kept. Of a document's set of shingle
hashes, the surplus of ones over zeros in each of 128 bits is a direction in space whose cosine between two
documents follows their overlap. Fixed random rotations turn it into segments of 23 real values; each segment is
decoded to the few nearest codewords of the binary Golay code (23, 12), by correlation with all 4,096. Three
segments make a group; all triples of their codeword indices are the keys (36 bits and the group's number).
With 6 groups of 3 x 3 x 3 keys, two documents of similarity 0.8 share a key in about 96 of 100 cases, and nearly
always at 0.85.

Pairs that meet are first judged by one-permutation min-hash signatures: 512 bins of 8 bits. They estimate the
Jaccard similarity of the shingle sets with a standard deviation below 0.018 at 0.8, and nearly exactly for
documents of few shingles. Pairs within four deviations of the limit are decided on the shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from attestor.llm.golay import codebook

DIRECTIONS, GROUPS, PER_GROUP, NEAREST, BINS = 128, 6, 3, 3, 512
#: Signs of the first 64 directions may differ in so many places: mean 9.7, deviation 2.9 at similarity 0.8.
MOST_SIGNS = 18
#: Estimates so near to the limit are decided on the sets themselves.
DOUBT = 0.07
_SEGMENTS = GROUPS * PER_GROUP
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
_STATE: dict[str, np.ndarray] = {}


def _rotations() -> np.ndarray:
    if "r" not in _STATE:
        _STATE["r"] = np.random.default_rng(42).standard_normal((DIRECTIONS, _SEGMENTS * 23)).astype(np.float32)
        _STATE["c"] = (2 * codebook() - 1).T.astype(np.float32)
    return _STATE["r"]


def mixed(x: np.ndarray) -> np.ndarray:
    """Another 64 bits from each of some 64 (uint64)."""
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return (x ^ (x >> np.uint64(32))) * _ODD[1]


def sketch(hashes: np.ndarray) -> bytes:
    """The 128 surpluses of a set of shingle hashes (uint64, sorted), scaled to bytes; no hashes give zeros."""
    ones = np.zeros(DIRECTIONS, np.int64)
    for k in range(0, len(hashes), 1 << 13):
        part = hashes[k : k + (1 << 13)]
        both = np.stack([part, mixed(part)], 1).astype(">u8")
        ones += np.unpackbits(both.view(np.uint8).reshape(len(part), 16), axis=1).sum(0, dtype=np.int64)
    surplus = (2 * ones - len(hashes)).astype(np.float64)
    most = np.abs(surplus).max()
    return np.rint(surplus * (127 / most if most else 0)).astype(np.int8).tobytes()


def signature(hashes: np.ndarray) -> bytes:
    """Least hash of each bin (sorted uint64 in), as 8 bits of it; 0 marks an empty bin."""
    out = np.zeros(BINS, np.uint8)
    bins, at = np.unique(hashes & np.uint64(BINS - 1), return_index=True)
    out[bins.astype(np.int64)] = 1 + (hashes[at] >> np.uint64(16)) % np.uint64(255)
    return out.tobytes()


def estimates(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Estimated Jaccard similarity of each pair of signatures."""
    return likeness(*(np.frombuffer(b"".join(s), np.uint8).reshape(-1, BINS) for s in (a, b)))


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``estimates`` of signatures as rows of bins; one bin in 255 agrees by chance."""
    equal = ((x == y) & (x != 0)).sum(1) / np.maximum(((x != 0) | (y != 0)).sum(1), 1)
    return (equal * 255 - 1) / 254


def signs(sketches: np.ndarray) -> np.ndarray:
    """Signs of the first 64 directions (rows of int8) as one signed 64-bit number."""
    return np.packbits(sketches[:, :64] > 0, axis=1).view(np.int64)[:, 0]


def soft_keys(sketches: np.ndarray) -> np.ndarray:
    """Keys of each row: one column for each group and triple of nearby codewords."""
    turned = (sketches.astype(np.float32) @ _rotations()).reshape(-1, 23)
    score = turned @ _STATE["c"]
    rows, near = np.arange(len(score)), []
    for _ in range(NEAREST):
        near.append(score.argmax(1))
        score[rows, near[-1]] = -np.inf
    x = np.stack(near, 1).astype(np.int64).reshape(len(sketches), GROUPS, PER_GROUP, NEAREST)
    triples = (x[:, :, 0, :, None, None] << 24) | (x[:, :, 1, None, :, None] << 12) | x[:, :, 2, None, None, :]
    return (triples.reshape(len(sketches), GROUPS, -1) | (np.arange(GROUPS) << 36)[:, None]).reshape(len(sketches), -1)


def in_order(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Order of rows by key and, within it, by a shuffle of the nodes; it is the same in all keys, so that what copies
    have in common leads them wherever they meet."""
    return np.lexsort((mixed(node.view(np.uint64)), key))


def close_pairs(key: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows (as places, rows sorted by key) with equal key and near signs."""
    a, b, active, lag = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.arange(len(key)), 1
    while len(active := active[active + lag < len(key)]) and len(active := active[key[active] == key[active + lag]]):
        near = active[np.bitwise_count((sign[active] ^ sign[active + lag]).view(np.uint64)) <= MOST_SIGNS]
        a.append(near)
        b.append(near + lag)
        lag += 1
    return np.concatenate(a), np.concatenate(b)


def stars(key: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Some pairs of rows (as places, rows sorted by key): leaders and members, and first leaders and later ones.

    The first row of a key leads; those whose signs are near it are its members; the first of the others
    leads next, until none is left. Members don't meet one another here: this joins the bulk of a group of
    copies, and what it leaves apart is for the caller to compare. Both lists together connect all rows of a key.
    """
    none = np.zeros(0, np.int64)
    active, lead, member, head, later = np.arange(len(key)), [none], [none], [none], [none]
    begin = np.searchsorted(key, key, "left")
    while len(active):
        k = key[active]
        first = np.r_[True, k[1:] != k[:-1]]
        leader = active[np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))]
        near = np.bitwise_count((sign[active] ^ sign[leader]).view(np.uint64)) <= MOST_SIGNS
        lead.append(leader[near & ~first])
        member.append(active[near & ~first])
        other = active[first][begin[active[first]] != active[first]]
        head.append(begin[other])
        later.append(other)
        active = active[~(near | first)]
    return tuple(map(np.concatenate, (lead, member, head, later)))


def apart(sign: np.ndarray, root: np.ndarray, side: np.ndarray, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places with near signs and different roots, some rows at a time; of two sides only pairs across."""
    two = len(side) and (side != side[0]).any()
    for k in range(0, len(sign), rows):
        part = slice(k, k + rows)
        good = root[part, None] != root[None, k:]
        if two:
            good &= side[part, None] != side[None, k:]
        x, y = np.nonzero(good)
        x, y = x[x < y] + k, y[x < y] + k
        near = np.bitwise_count((sign[x] ^ sign[y]).view(np.uint64)) <= MOST_SIGNS
        yield x[near], y[near]


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingle hashes."""
    return xxhash.xxh3_128_digest(hashes.tobytes())

"""Sets of character n-grams as sorted integer arrays, for whole batches of texts at once."""

from __future__ import annotations

import numpy as np

#: Texts handled at once, so that a record's number fits the bits left beside a token.
RECORDS = 1 << 13
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x * _MIX[0]
    x ^= x >> np.uint64(30)
    x *= _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in a row, and the length of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def windows(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """``(gram, record)`` of every window of ``q`` code points that lies within one text; grams are 64-bit hashes.

    For ``q`` up to 3 the hash is a bijection of the code points, hence free of collisions.
    """
    points, lengths = code_points(texts)
    if len(points) < q:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    wide = points.astype(np.uint64)
    n = len(wide) - q + 1
    gram = wide[:n].copy()
    for k in range(1, q):
        if k % 3 == 0:
            gram = mix(gram)
        gram = (gram << np.uint64(21)) ^ wide[k : k + n] if k % 3 else gram ^ wide[k : k + n]
    record = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    inside = np.arange(n) + q <= ends[record[:n]]
    return mix(gram[inside]), record[:n][inside]


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in a sorted array."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def _byte_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number and 4-gram, sorted, each once; different 4-grams of each text)`` of ASCII texts; a gram is its four bytes."""
    points = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = max(0, len(points) - 3)
    gram = (points[:n] << np.uint64(24)) | (points[1 : n + 1] << np.uint64(16)) | (points[2 : n + 2] << np.uint64(8)) | points[3 : n + 3]
    owner = np.repeat(np.arange(len(texts)), lengths)[:n]
    inside = np.arange(n) + 4 <= np.cumsum(lengths)[owner]
    key = np.sort((owner[inside].astype(np.uint64) << np.uint64(32)) | gram[inside])
    key = key[runs(key)]
    return key, np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def similar(x: list[str], y: list[str], q: int, threshold: float) -> np.ndarray:
    """For each pair of texts whether their sets of ``q``-grams have at least that Jaccard similarity, exactly: pairs of ASCII texts with
    ``q`` 4 as whole arrays, others as sets."""
    out = np.zeros(len(x), bool)
    plain = np.fromiter((q == 4 and a.isascii() and b.isascii() for a, b in zip(x, y)), bool, len(x))
    for k in np.flatnonzero(~plain):
        a, b = ({t[i : i + q] for i in range(len(t) - q + 1)} for t in (x[k], y[k]))
        out[k] = alike(a, b, threshold)
    at = np.flatnonzero(plain)
    for s in range(0, len(at), RECORDS):
        here = at[s : s + RECORDS]
        a, m = _byte_grams([x[k] for k in here])
        b, n = _byte_grams([y[k] for k in here])
        both = np.sort(np.concatenate([a, b]))
        common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(here))
        out[here] = (common > 0) & (common * 10_000 >= round(threshold * 10_000) * (m + n - common))
    return out


def alike(x: set[str], y: set[str], threshold: float) -> bool:
    """Whether the Jaccard similarity of two sets of grams reaches ``threshold``, in whole numbers so that the bound itself counts."""
    both = len(x & y)
    parts = round(threshold * 10_000)
    return both > 0 and both * 10_000 >= parts * (len(x) + len(y) - both)

"""Vectorised byte kernels: words, hashes and shingles of many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (new array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept and grown."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums that give the polynomial hash of any span of ``buf`` in constant time."""
    n = len(buf)
    out = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * _powers(_BASE, n)[:n], out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, mixed with their lengths; equal spans have equal hashes."""
    h = (pre[ends] - pre[starts]) * _powers(_INVERSE, len(pre))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def join_texts(texts: list[bytes], sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One buffer with ``sep`` after each text, and the start of each text (and the end)."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offs = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lens + len(sep), out=offs[1:])
    return np.frombuffer(sep.join(texts) + sep, dtype=np.uint8), offs


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of every run of bytes that are not ASCII white space."""
    solid = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def shingle_hashes(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k successive words of one text, and the index of each one's first word."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _U(0x9FB21C651E98DF25) + word_hash[i : i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), at


def spans_from_points(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True as (starts, ends)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def union_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the pairs (a, b)."""
    lab = np.arange(n) if labels is None else labels
    while True:
        la, lb = lab[a], lab[b]
        if np.array_equal(la, lb):
            return lab
        low = np.minimum(la, lb)
        np.minimum.at(lab, la, low)
        np.minimum.at(lab, lb, low)
        while not np.array_equal(lab, nxt := lab[lab]):
            lab = nxt

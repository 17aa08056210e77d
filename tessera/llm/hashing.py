"""Words and hashes of runs of words, vectorised over a whole text.

A run's hash is a polynomial over its bytes (words joined by one space) with a table of random 64-bit values,
taken from prefix sums, then mixed. Equal runs of words have equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of splitmix64); another seed, another order of the values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _M)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(256, dtype=np.uint64), 12345)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i for i < n; tables of up to a million entries are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    found = []
    with np.errstate(over="ignore"):
        for r in (_R, _R_INV):
            x = np.full(1 << (n - 1).bit_length(), r, np.uint64)
            x[0] = 1
            found.append(np.cumprod(x))
    if len(found[0]) <= 1 << 20:
        _powers[:] = found
    return found[0][:n], found[1][:n]


def words(text: str | None, lower: bool) -> list[bytes]:
    """Runs of bytes other than space and \\t to \\r; only A-Z are lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def runs(parts: list[bytes], k: int, short: bool = False) -> np.ndarray:
    """Hashes of all runs of k words; with fewer words none, or with `short` that of the whole sequence."""
    n = len(parts)
    if n < k:
        if not short or not n:
            return np.zeros(0, np.uint64)
        k = n
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    up, down = _power(len(raw))
    ends = np.flatnonzero(raw == 32)
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up, out=total[1:])
        first = starts[: n - k + 1]
        return mix((total[ends[k - 1 :]] - total[first]) * down[first])


def sets(texts: list[str | None], k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text's runs of k words (with fewer words the whole sequence), as sorted hashes one after another, and where each set begins.

    One pass over all texts, as most texts are short and calls cost more than bytes.
    """
    parts = [words(t, lower) for t in texts]
    count = np.array([len(p) for p in parts], np.int64)
    if not count.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(b" ".join(b" ".join(p) for p in parts if p) + b" ", np.uint8)
    up, down = _power(len(raw))
    ends = np.flatnonzero(raw == 32)
    starts = np.r_[0, ends[:-1] + 1]
    doc = np.repeat(np.arange(len(texts)), count)
    last = np.cumsum(count) - 1
    word = np.arange(len(ends))
    word = word[(word + k - 1 <= last[doc]) | (word == (last - count + 1)[doc])]
    doc = doc[word]
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * up, out=total[1:])
        first = starts[word]
        hashes = mix((total[ends[np.minimum(word + k - 1, last[doc])]] - total[first]) * down[first])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))

"""Word shingles of texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

import numpy as np

SIZE = 5
_M = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, SIZE, dtype=np.uint64) | np.uint64(1)
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def shingle_sets(texts: list[str | None], size: int = SIZE) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted.

    Words are runs of bytes other than space and 0x09 to 0x0D, A-Z lower-cased.  A text
    of fewer words than ``size`` has its whole sequence as one shingle; one without
    words, or a null, has none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
    gap = _SPACE[data]
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    end = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    if not len(start):
        return [np.zeros(0, np.uint64) for _ in texts]
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), dtype=np.uint64)]
    word = mix((total[end] - total[start]) * _powers(_BACK, len(data))[start]
               + (end - start).astype(np.uint64))
    owner = np.searchsorted(ends_of_texts, start, side="right")
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    padded = np.r_[word, np.zeros(size, np.uint64)]
    joined = np.zeros(len(word), np.uint64)
    for j in range(size):
        place = _PLACE[j % SIZE] * np.uint64(2 * (j // SIZE) + 1)
        joined += mix(padded[j:j + len(word)] ^ place) * place
    joined = mix(joined)
    out = []
    for f, c in zip(first, count, strict=True):
        if c >= size:
            out.append(np.unique(joined[f:f + c - size + 1]))
        elif c:
            h = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in word[f:f + c]:
                    h = mix(np.array([h * np.uint64(_STEP) + w], dtype=np.uint64))[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

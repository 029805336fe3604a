"""Sets of hashed word n-grams, computed for many texts at once.

Words are runs of bytes other than white space, with A-Z lowered. Every word gets a 64-bit polynomial
hash from one running sum over the bytes of many texts; every n-gram mixes the hashes of its words.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 1)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of a piece that no word crosses the ends of."""
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * down[starts]
    return starts, mixed(values + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word, working on segments so that memory stays bounded."""
    starts, hashes, low = [], [], 0
    while low < len(data):
        high = min(len(data), low + SEGMENT)
        while high < len(data) and not SPACE[data[high]]:
            gap = np.flatnonzero(SPACE[data[high : high + SEGMENT]])
            high += int(gap[0]) if len(gap) else min(SEGMENT, len(data) - high)
        s, h = _word_hashes(data[low:high])
        starts.append(s + low)
        hashes.append(h)
        low = high
    return np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(hashes or [np.empty(0, np.uint64)])


def sets_of(texts: list[str], n: int = 4) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; fewer words than ``n`` are one n-gram."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    starts, words = word_hashes(np.frombuffer(b" ".join(parts) + b" ", np.uint8))
    at = np.searchsorted(starts, bounds)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = (grams + words[k : k + len(grams)]) * np.uint64(0xFF51AFD7ED558CCD)
    grams = mixed(grams)
    out = []
    for low, high in zip(at[:-1], at[1:]):
        count = high - low
        if count >= n:
            out.append(np.unique(grams[low : high - n + 1]))
        elif count:
            short = np.array([count], np.uint64)
            for w in words[low:high]:
                short = mixed(short * np.uint64(31) ^ w)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def batches_of(texts: list[str], size: int = 4 << 20):
    """Index ranges of ``texts`` with about ``size`` characters each."""
    low, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield low, i + 1
            low, total = i + 1, 0
    if low < len(texts):
        yield low, len(texts)

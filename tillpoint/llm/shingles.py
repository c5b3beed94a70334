"""Word shingles of whole texts as sorted arrays of distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np

#: An odd base, its inverse modulo 2^64 and odd factors of the words of a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FACTOR = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0.. and INVERSE^0.., at least n of each; kept by the worker."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, b in (("up", BASE), ("down", INVERSE)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            _POWERS[name] = np.cumprod(run)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (run of bytes that are no ASCII white space)."""
    b = np.frombuffer(raw, np.uint8)
    solid = np.concatenate([[False], ~_SPACE[b], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, np.uint64)
    up, down = powers(len(b))
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * FACTOR)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles, A-Z in lower case.
    A text with fewer words has its whole sequence as the one shingle; without words it has none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):  # some megabytes at a time
        part, size = [], 0
        while at < len(texts) and (not part or size < 2_000_000):
            part.append((texts[at] or "").encode().lower())
            size += len(part[-1])
            at += 1
        out += _sets(part, width)
    return out


def _sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    start, h = word_hashes(b" ".join(raws))
    cut = np.searchsorted(start, begins)
    factors = [np.uint64(pow(int(FACTOR), k + 2, 1 << 64)) for k in range(width)]
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += h[k:k + n] * factors[k]
    rolled = mix(rolled)
    out = []
    for i in range(len(raws)):
        a, e = cut[i], cut[i + 1]
        if e - a >= width:
            out.append(np.unique(rolled[a:e - width + 1]))
        elif e > a:
            whole = np.array([e - a], np.uint64)
            for k in range(e - a):
                whole += h[a + k:a + k + 1] * factors[k]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Blocks of equal-minimizer windows of byte strings."""

from __future__ import annotations

import numpy as np

from .shingles import FACTOR, mix, powers

#: Length of the byte grams whose least hash stands for a window.
GRAM = 24
_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    have, done = key, 1
    while 2 * done <= width:
        have = np.minimum(have[:-done], have[done:])
        done *= 2
    return np.minimum(have[:len(key) - width + 1], have[width - done:width - done + len(key) - width + 1])


def blocks(raws: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Cut the starts of all ``length``-byte windows of each text into runs that share their minimizer.

    A window's minimizer is its leftmost gram of least hash, so it depends on the window's bytes alone:
    equal windows, wherever they stand, have equal minimizers at the same place in them. Returns for
    each run: text number, first start, number of starts, place of the minimizer from the first
    start, the minimizer's hash, and a hash of the run's bytes with that place."""
    sizes = np.array([len(r) for r in raws], np.int64)
    begins = np.cumsum(sizes) - sizes
    b = np.frombuffer(b"".join(raws), np.uint8)
    n = len(b)
    empty = np.zeros(0, np.int64)
    if n < length or not (sizes >= length).any():
        return (empty,) * 4 + (empty.astype(np.uint64),) * 2
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    gram = mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1])
    key = (gram >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(gram), dtype=np.uint64)
    place = (sliding_least(key, length - GRAM + 1) & _PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(raws)), sizes)[:len(place)]
    ends = begins + sizes
    valid = np.arange(len(place)) + length <= ends[text]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(place)))
    keep = valid[first]
    first, count = first[keep], count[keep]
    at = place[first]
    stop = first + count + length - 1
    body = mix((total[stop] - total[first]) * down[first] + (at - first).astype(np.uint64) * FACTOR)
    body = mix(body + count.astype(np.uint64))
    which = text[first]
    return which, first - begins[which], count, at - first, gram[at], body

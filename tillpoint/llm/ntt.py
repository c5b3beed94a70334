"""Exact number-theoretic transforms of many rows at once, for numpy inside tasks.

Arrays are (N, rows): a butterfly works on whole blocks of memory. Forward transforms
leave their frequencies in bit-reversed order, the inverse takes them so."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: 3 * 2^30 + 1, with root 5: products of two residues fit 64 bits, lengths up to 2^30.
PRIME = 3221225473
_ROOT = 5
_P = np.uint64(PRIME)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a * b
    t -= t // _P * _P
    return t


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a + b
    return np.minimum(t, t - _P)  # below zero wraps to a large number


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = a + (_P - b)
    return np.minimum(t, t - _P)


@lru_cache(maxsize=64)
def roots(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of a root of order 2 half."""
    w = pow(_ROOT, (PRIME - 1) // (2 * half), PRIME)
    if inverse:
        w = pow(w, PRIME - 2, PRIME)
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, times(out, np.uint64(pow(w, len(out), PRIME)))])
    return out


@lru_cache(maxsize=32)
def negated(n: int) -> np.ndarray:
    """Where frequency -k stands, for the place of each frequency k, in bit-reversed order."""
    rev = np.zeros(1, np.int64)
    while len(rev) < n:
        rev = np.concatenate([2 * rev, 2 * rev + 1])
    place = np.empty(n, np.int64)
    place[rev] = np.arange(n)
    return place[-rev % n]


def forward(a: np.ndarray) -> np.ndarray:
    n, rows = a.shape
    half = n // 2
    while half:
        a = a.reshape(-1, 2 * half, rows)
        u, v = a[:, :half], a[:, half:]
        w = np.repeat(roots(half, False)[:, None], rows, axis=1)
        a = np.concatenate([plus(u, v), times(minus(u, v), w)], axis=1)
        half //= 2
    return a.reshape(n, rows)


def inverse(a: np.ndarray) -> np.ndarray:
    n, rows = a.shape
    half = 1
    while half < n:
        a = a.reshape(-1, 2 * half, rows)
        w = np.repeat(roots(half, True)[:, None], rows, axis=1)
        u, v = a[:, :half], times(a[:, half:], w)
        a = np.concatenate([plus(u, v), minus(u, v)], axis=1)
        half *= 2
    return times(a.reshape(n, rows), np.uint64(pow(n, PRIME - 2, PRIME)))

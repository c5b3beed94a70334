"""Periodic runs of words, seeded by block convolution.

A run is a stretch of words with smallest period q, at least max(MIN_LENGTH, MIN_EXPONENT q)
long, that can't be extended. Documents are taken some megabytes at a time; their words
become numbers, different ones in different documents.

1. Every word of a run stands MIN_EXPONENT times in it. Words that are rarer in their document
   are cut out, and stretches shorter than MIN_LENGTH between them; what is left is set apart
   by numbers that occur once. For most documents little is left; nothing that could be in a
   run is lost.
2. At every scale B = 1, 2, 4, ... the numbers are cut into blocks of B. A run with a period
   q in [B, 2B) holds a whole block and that block's copy q further on. So each block is held
   against the window of the following 2B numbers: the sum of squared differences at
   every distance comes from one convolution, an exact number-theoretic transform of
   length 2B for all blocks at once. A window's transform is put together from those of the
   next two blocks, so one transform a block goes forward and one back.
3. A distance with a sum of zero is a seed. Seeds whose distance is a multiple of the period
   of a run found at a smaller scale, and which lie inside it, are not seeds of smallest
   periods. The others are extended both ways, by doubling over sums of hashes.
4. Extended seeds long enough are compared number by number; those with a smaller
   period, a divisor of the distance, are dropped.

The sums are exact modulo the prime of ``ntt``: a copy always gives zero; another zero is
found out by the extension. Work is n log^2 n for a text of n words, memory a few times the
text; a text of any length that a row can hold is taken whole. Each document is
searched where it is read; nothing is shuffled.

Defined results: null or blank texts have no words and no runs; rows are independent, so
repeated rows and doc_ids give a result each; a null doc_id counts as the text '' where
its crc32 is asked for; ties of the greatest run go to the smallest start, then period; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ntt

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Bytes of text searched at once (at least one document).
SLICE_BYTES = 4_000_000
#: Numbers transformed at once (at least three blocks).
SLAB = 1 << 17

RUNS = "array<struct<start: long, length: long, period: long>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed binary"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# ---- numpy inside tasks

def block_seeds(y: np.ndarray, sel: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, in [size, 2 size), at which the block of ``size`` numbers at ``size`` * sel
    stands again, by convolution. ``y`` is padded so that three blocks follow any."""
    places, distances = [], []
    squares = np.concatenate([[0], np.cumsum(ntt.times(y, y))]).astype(np.uint64)
    step = max(SLAB // (2 * size), 1)
    for lo in range(0, len(sel), step):
        part = sel[lo:lo + step]
        used, at = np.unique(np.concatenate([part, part + 1, part + 2]), return_inverse=True)
        own, nxt, over = at.reshape(3, -1)
        blocks = np.zeros((2 * size, len(used)), np.uint64)
        blocks[:size] = y[used * size + np.arange(size)[:, None]]
        f = ntt.forward(blocks)
        # the window is the next block, and the one after it moved by size: that turns the sign of odd frequencies
        window = np.concatenate([ntt.plus(f[:size, nxt], f[:size, over]), ntt.minus(f[size:, nxt], f[size:, over])])
        product = ntt.inverse(ntt.times(f[ntt.negated(2 * size)][:, own], window))[:size]
        start = part * size
        from_ = start + size + np.arange(size)[:, None]
        total = (squares[start + size] - squares[start]) + (squares[from_ + size] - squares[from_])
        total -= total // ntt._P * ntt._P
        j, b = np.nonzero(total == ntt.plus(product, product))
        places.append(start[b])
        distances.append(size + j)
    return np.concatenate(places), np.concatenate(distances)


class Extender:
    """Longest common extensions of two places of one array, many at once, over sums of hashes modulo 2^64."""

    def __init__(self, y: np.ndarray):
        n = len(y)
        z = y * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        base = np.full(n + 1, 0x5851F42D4C957F2D, np.uint64)
        base[0] = 1
        self.powers = np.multiply.accumulate(base)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(z * self.powers[:n], dtype=np.uint64)])

    def same(self, a: np.ndarray, length: int, d: np.ndarray) -> np.ndarray:
        """Whether y[a : a + length] equals y[a + d : a + d + length], by hash."""
        s = self.sums
        return (s[a + length] - s[a]) * self.powers[d] == s[a + d + length] - s[a + d]

    def forward(self, a: np.ndarray, d: np.ndarray, longest: int) -> np.ndarray:
        n = len(self.sums) - 1
        got = np.zeros(len(a), np.int64)
        step = 1 << max(longest.bit_length() - 1, 0)
        while step:
            can = np.flatnonzero(a + got + d + step <= n)
            ok = can[self.same(a[can] + got[can], step, d[can])]
            got[ok] += step
            step //= 2
        return got

    def backward(self, a: np.ndarray, d: np.ndarray, longest: int) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        step = 1 << max(longest.bit_length() - 1, 0)
        while step:
            can = np.flatnonzero(a - got - step >= 0)
            ok = can[self.same(a[can] - got[can] - step, step, d[can])]
            got[ok] += step
            step //= 2
        return got


def prime_divisors(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return out + [n] * (n > 1)


def _has_period(y: np.ndarray, lo: int, hi: int, q: int) -> bool:
    return bool(np.array_equal(y[lo:hi - q], y[lo + q:hi]))


def _stretches(y: np.ndarray, lo: int, hi: int, q: int) -> list[tuple[int, int]]:
    """The parts of y[lo:hi] that do have period q and are long enough: the whole, unless two different
    passages share a sum of hashes."""
    equal = y[lo:hi - q] == y[lo + q:hi]
    if equal.all():
        return [(lo, hi)]
    edge = np.diff(np.concatenate([[0], equal.astype(np.int8), [0]]))
    parts = [(lo + int(a), lo + int(b) + q) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
    return [(a, b) for a, b in parts if b - a >= max(MIN_LENGTH, MIN_EXPONENT * q)]


def find_runs(x: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, end, period) of the numbers ``x`` of several documents that start at ``bounds`` (the last is the
    end); no number stands in two documents."""
    if not len(x):
        return []
    live = np.bincount(x)[x] >= MIN_EXPONENT
    edge = np.diff(np.concatenate([[0], live.astype(np.int8), [0]]))
    # a stretch may run over the end of a document; no copy does
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = hi - lo >= MIN_LENGTH
    lo, hi = lo[long], hi[long]
    if not len(lo):
        return []
    length = hi - lo
    starts = np.concatenate([[0], np.cumsum(length + 1)])[:-1]  # one number between stretches
    n = int(starts[-1] + length[-1])
    stretch = np.repeat(np.arange(len(lo)), length + 1)[:n]
    place = np.arange(n) - starts[stretch]
    within = place < length[stretch]
    origin = np.where(within, lo[stretch] + place, 0)
    ids = np.unique(x[origin[within]], return_inverse=True)[1]
    y = np.empty(n, np.uint64)
    y[within] = ids + 1
    y[~within] = ids.max() + 2 + np.arange(int((~within).sum()))
    longest, end = int(length.max()), starts + length
    ext = Extender(y)
    period, until = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of a run over each place
    runs: list[tuple[int, int, int]] = []
    size = 1
    while max(MIN_LENGTH, MIN_EXPONENT * size) <= longest:
        at = np.arange(0, n - size + 1, size)
        seg = stretch[at]
        sel = at[(at + 2 * size <= end[seg]) & (length[seg] >= max(MIN_LENGTH, MIN_EXPONENT * size))] // size
        if len(sel):
            padded = np.concatenate([y, np.zeros(4 * size, np.uint64)])
            s, d = block_seeds(padded, sel, size)
            keep = s + d + size <= end[stretch[s]]
            keep &= ~((period[s] > 0) & (d % np.maximum(period[s], 1) == 0) & (s + d + size <= until[s]))
            s, d = s[keep], d[keep]
            left = s - ext.backward(s, d, longest)
            right = s + d + ext.forward(s, d, longest)
            good = right - left >= np.maximum(MIN_LENGTH, MIN_EXPONENT * d)
            for a, b, q in sorted(set(zip(left[good].tolist(), right[good].tolist(), d[good].tolist()))):
                for a, b in _stretches(y, a, b, q):
                    if any(_has_period(y, a, b, q // r) for r in prime_divisors(q)):
                        continue
                    runs.append((int(origin[a]), int(origin[a]) + b - a, q))
                    wider = np.arange(a, b)[until[a:b] < b]
                    period[wider], until[wider] = q, b
        size *= 2
    return sorted(set(runs))


# ---- Spark

def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's documents: one in ten goes round in a loop from some word on."""
    h, n = crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _search(ids: list, texts: list, reword: Callable | None) -> pa.RecordBatch:
    docs = [(t or b"").split() for t in texts]  # bytes split at ASCII white space only
    if reword:
        docs = [reword(i, w) for i, w in zip(ids, docs)]
    sizes = np.array([len(w) for w in docs], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary: dict[bytes, int] = {}
    number = [vocabulary.setdefault(w, len(vocabulary)) for ws in docs for w in ws]
    of_doc = np.repeat(np.arange(len(docs)), sizes)
    x = np.unique(of_doc * max(len(vocabulary), 1) + np.array(number, np.int64), return_inverse=True)[1]
    runs: list[list] = [[] for _ in docs]
    for start, end, q in find_runs(x, bounds):
        k = int(np.searchsorted(bounds, start, "right")) - 1
        runs[k].append((start - int(bounds[k]), end - start, q))
    collapsed = []
    for words, found in zip(docs, runs):
        if found:
            keep = np.ones(len(words), bool)
            for start, length, q in found:
                keep[start + q:start + length] = False
            words = [w for w, k in zip(words, keep.tolist()) if k]
        collapsed.append(b" ".join(words))
    rows = [dict(zip(("start", "length", "period"), r)) for found in runs for r in found]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in runs])]), pa.int32()), pa.array(rows, _RUN))
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes), lists, pa.array(collapsed, pa.binary())],
                           names=["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reword: Callable | None = None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; words from 0) and the collapsed text (bytes): the words that no run
    contains after its first period, joined by one space. ``reword(doc_id, words)`` may replace a document's words."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = size = 0
            for hi, t in enumerate(texts):
                if hi > lo and size + len(t or b"") > SLICE_BYTES:
                    yield _search(ids[lo:hi], texts[lo:hi], reword)
                    lo, size = hi, 0
                size += len(t or b"")
            if texts:
                yield _search(ids[lo:], texts[lo:], reword)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(search, FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The contract's row per document."""
    # greatest length, then smallest start, then smallest period
    best = F.try_element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                             r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

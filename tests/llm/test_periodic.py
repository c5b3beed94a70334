"""Periodic runs against brute force, and the transforms under them against plain sums."""

import hashlib
import os
import random
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import SF, read, write_tables  # noqa: E402


def brute_runs(w):
    """Every maximal stretch by its smallest period, straight from the definition."""
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    a, out = np.array([ids[x] for x in w], np.int64), {}
    for q in range(1, len(a) // 4 + 1):
        same = np.concatenate([[0], (a[:-q] == a[q:]).astype(np.int8), [0]])
        edge = np.diff(same)
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if hi - lo + q >= max(6, 4 * q):
                out.setdefault((lo, hi + q), q)  # the first q to give a stretch is its smallest
    return sorted((lo, hi - lo, q) for (lo, hi), q in out.items())


def brute(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def check(spark, queries, path, rows):
    got = sorted(map(tuple, queries["op12_periodic_runs"](spark, path).collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)
    return got


def test_awkward_texts(spark, queries, tricky, empty):
    check(spark, queries, tricky, read(tricky))
    assert queries["op12_periodic_runs"](spark, empty).collect() == []


def test_given_table(spark, queries):
    got = check(spark, queries, SF, read(SF))
    assert sum(r[1] for r in got) > 10


def test_nested_touching_and_long_periods(spark, queries):
    rng = random.Random(12)
    def some(n, k):
        return [rng.choice("abcdefghij"[:k]) for _ in range(n)]
    texts = ["a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "a b a b a b a b c c c c c c c d c d c d c d", "a a b " * 40, "a a a a a a b " * 9,
             ("a b " * 9 + "c ") * 5, "  　 x y " * 8, " ".join(some(97, 10) * 4), " ".join(some(97, 10) * 4)[:-2],
             " ".join(some(1500, 10) * 3), "x " * 9000, "x y z " * 3000 + "q " + "x y z " * 3000, "".join(f"w{i % 1023} " for i in range(5000)),
             "".join(f"w{i % 1024} " for i in range(5000)), "".join(f"w{i % 1025} " for i in range(5000))]
    for k in (1, 2, 2, 2, 3, 3):
        texts += [" ".join(some(rng.randint(1, 300), k)) for _ in range(40)]
    for _ in range(60):
        base = some(rng.randint(1, 25), 3)
        texts.append(" ".join(some(5, 3) + base * rng.randint(2, 9) + base[:rng.randint(0, len(base))] + some(5, 3) + base * 4))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "a b " * 9, None, None, None), (3, texts[3], None, None, None)]
    got = check(spark, queries, write_tables(rows), [r[:2] for r in rows])
    assert {len(r) for r in got} == {8} and max(r[4] or 0 for r in got) >= 1025


def test_a_text_of_many_megabytes(spark, queries):
    unit = [f"w{i}" for i in range(70_000)]
    text = " ".join(["start"] + unit * 5 + ["end"])
    assert len(text) > 2_000_000 and zlib.crc32(b"1") % 10
    r = queries["op12_periodic_runs"](spark, write_tables([(1, text, None, None, None)])).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 1, 350_000, 70_000, 5000)


def test_general_runs_and_other_columns(spark):
    from tillpoint.llm.periodic_runs import find
    docs = spark.createDataFrame([(5, "go go go go go go on", 1, 2), (6, None, 1, 2)], "key int, body string, runs int, n_words int")
    got = {r.doc_id: r for r in find(docs, "key", "body").collect()}
    assert [tuple(x) for x in got[5].runs] == [(0, 6, 1)] and got[5].collapsed == b"go on" and got[6].n_words == 0


def test_transforms_are_exact():
    from tillpoint.llm import ntt
    rng = np.random.default_rng(0)
    for n in (2, 4, 8, 64):
        a, b = rng.integers(0, ntt.PRIME, (2, n, 3)).astype(np.uint64)
        assert (ntt.inverse(ntt.forward(a)) == a).all()
        got = ntt.inverse(ntt.times(ntt.forward(a)[ntt.negated(n)], ntt.forward(b)))
        for r in range(3):
            want = [sum(int(a[i, r]) * int(b[(i + j) % n, r]) for i in range(n)) % ntt.PRIME for j in range(n)]
            assert got[:, r].tolist() == want


def test_seeds_are_all_copies():
    from tillpoint.llm.periodic_runs import block_seeds
    rng = np.random.default_rng(1)
    y = rng.integers(1, 3, 400).astype(np.uint64)
    for size in (1, 2, 4, 8):
        sel = np.arange((400 - 2 * size) // size)
        got = set(zip(*(v.tolist() for v in block_seeds(np.concatenate([y, np.zeros(4 * size, np.uint64)]), sel, size))))
        padded = np.concatenate([y, np.zeros(4 * size, np.uint64)])
        assert got == {(s, d) for s in (sel * size).tolist() for d in range(size, 2 * size)
                       if (padded[s:s + size] == padded[s + d:s + d + size]).all()}

"""The conversation trie against brute force and SQL."""

import collections
import hashlib
import os
import random
import sys
import tempfile
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


def write(rows, extra=False):
    d = tempfile.mkdtemp(prefix="llm-conv-")
    cols = list(zip(*rows)) if rows else [[]] * 4
    t = {"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()),
         "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string())}
    if extra:
        t |= {n: pa.array([7] * len(rows), pa.int64()) for n in ("n", "h", "pos", "_n", "_range", "bytes", "depth")}
    pq.write_table(pa.table(t), f"{d}/conversations.parquet")
    return d


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn, role.encode(), text[:64].encode(),
                           hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text.encode()))
    for c in own:
        own[c] = [(r, t) for *_, r, _, _, t in sorted(own[c])]
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(c - rest, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    for node, convs in members.items():
        sub = [m for m in members if m[:len(node)] == node]
        kids = [m for m in sub if len(m) == len(node) + 1]
        leaves = sum(not any(x[:len(m)] == m and len(x) == len(m) + 1 for x in sub) for m in sub)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in sub if m)
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(node))))
        out.add((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def awkward():
    rng = random.Random(11)
    rows = []
    for c in range(60):  # blocks of five share openings; few texts, so sequences repeat and nest
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bé", "long text " * 20])))
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]  # a hot group of copies
    rows += [(200, t, "user", f"turn {t % 4}") for t in range(40)]  # a long one
    rows += [(200, t, "user", f"turn {t % 4}") for t in range(40)]  # every row of it twice
    rows += [(301, None, None, None), (301, 1, None, "x"), (301, 1, "user", "x"), (301, 1, None, "x"), (303, 0, "a", ""), (303, None, "a", "z"),
             (None, 0, "user", "nobody"), (None, None, None, None), (-7, 0, "u", "neg"), (-6, 0, "u", "neg"), (-5, 0, "u", "first"),
             (402, 1, "u", "p" * 64 + "b"), (402, 1, "u", "p" * 64 + "a"), (10 ** 12 + 3, 0, "u", "big")]
    rng.shuffle(rows)
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(queries, spark, path):
    rows = queries["op11_prefix_trie"](spark, path).select(*COLUMNS).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_nodes_by_brute_force(spark, queries):
    rows = awkward()
    assert got(queries, spark, write(rows, extra=True)) == brute(rows)


def test_long_conversations_and_end_lists_are_split(spark, queries, monkeypatch):
    from tillpoint.llm import prefix_trie
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "END_PIECE", 7)
    rows = awkward()
    assert got(queries, spark, write(rows)) == brute(rows)


def test_empty_and_null_tables_have_no_nodes(spark, queries):
    assert got(queries, spark, write([])) == set()
    assert got(queries, spark, write([(None, 1, "u", "t")])) == set()


def test_numbers_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F
    from tillpoint.llm.numbering import numbered
    rows = spark.range(3000).select((F.col("id") % 10 < 7).cast("int").alias("k"), F.when(F.col("id") % 50 > 0, F.col("id") % 400).alias("v"))
    want = {}
    for n in (1, 7):
        out = numbered(rows.repartition(n), ["k"], [F.col("v")], "test").collect()
        by = collections.defaultdict(list)
        for r in out:
            by[r.k].append((r._n, r.v is not None, r.v))
        for k, v in by.items():
            assert [x[0] for x in sorted(v)] == list(range(1, len(v) + 1))
            assert [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v)
            assert want.setdefault(k, sorted(v)) == sorted(v)


def test_sql_twin(spark, queries):
    from tillpoint.llm.queries import QUERIES
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(QUERIES["op11_prefix_trie"][1])
    assert want.columns == COLUMNS
    assert got(queries, spark, SF) == set(want.fetchall())

import os
import random
import sys
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


def prose(rng, n, stems=("al", "be", "cor", "du", "en", "fi", "gra", "ho", "is", "lo", "mu", "ne")):
    return " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n))


def tricky_rows():
    """Nulls, empty and blank texts, repeats, ties, near copies in a chain, one long text."""
    rng = random.Random(4)
    a, b = prose(rng, 120), prose(rng, 300)
    near = b.split()
    near[150] = "changed"
    chain = near[:]
    chain[20] = "again"
    passage = prose(rng, 60)
    lines = "\n".join(prose(rng, 12) for _ in range(30))
    # two words from each other, eight words apart: only links through the middle text hold
    texts = [None, "", "   \n\t ", "word", "Four words are here", a, a, b, " ".join(near), " ".join(chain),
             prose(rng, 40) + " " + passage + " " + prose(rng, 30), prose(rng, 35) + " " + passage,
             lines, "intro line one\nintro two\n" + lines + "\ntail", "é" * 300 + " ü", "#### $$$ %%%", "same\nsame\nsame\nother",
             "x" * 5000, prose(rng, 20_000), "一二三 四五", "a  b   c \n d ", "you idiot. fine day.\nscum!"]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0]]  # repeated in full
    return rows


SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def write_tables(rows, labels=(), vectors=()):
    d = tempfile.mkdtemp(prefix="llm-fixture-")
    cols = list(zip(*rows)) if rows else [[]] * 5
    pq.write_table(pa.table({f.name: pa.array(c, f.type) for f, c in zip(SCHEMA, cols)}, schema=SCHEMA), f"{d}/documents.parquet")
    cols = list(zip(*labels)) if labels else [[]] * 3
    pq.write_table(pa.table({"doc_id": pa.array(cols[0], pa.int64()), "quality": pa.array(cols[1], pa.int32()),
                             "toxic": pa.array(cols[2], pa.int32())}), f"{d}/labels.parquet")
    cols = list(zip(*vectors)) if vectors else [[]] * 3
    pq.write_table(pa.table({"vec_id": pa.array(cols[0], pa.int64()), "embedding": pa.array(cols[1], pa.list_(pa.float32())),
                             "label": pa.array(cols[2], pa.int32())}), f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def tricky():
    rows = tricky_rows()
    return write_tables(rows, [(3, 1, 0), (5, 1, 0), (21, 0, 1), (21, 0, 0), (99, 1, 1), (7, 1, None)])


@pytest.fixture(scope="session")
def empty():
    return write_tables([])


@pytest.fixture(scope="session")
def queries(spark):
    from tillpoint.llm.queries import QUERIES
    from tillpoint.session import apply_defaults
    apply_defaults(spark)
    return {name: fn for name, (fn, _) in QUERIES.items()}


def read(path):
    t = pq.read_table(f"{path}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in t]

"""Every pipeline stage on its own input, against brute force."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import read  # noqa: E402
from test_operators import brute_components, brute_spans  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, tricky):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    stages = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    for name in ("toxicity", "line_dedup", "near_dedup", "substring_dedup"):
        assert stages[name](spark, docs, tricky).columns == COLUMNS

    rows = read(tricky)
    _, want = brute_components(rows, 80)
    kept = [r.doc_id for r in stages["near_dedup"](spark, docs, tricky).collect()]
    assert sorted(set(kept)) == sorted(i for i in want if want[i] == i)

    spans = brute_spans(rows)
    for r in stages["substring_dedup"](spark, docs, tricky).collect():
        raw, gone = spans[r.doc_id]
        if r.text is not None:
            assert r.text.encode() == bytes(x for x, g in zip(raw, gone) if not g).decode(errors="ignore").encode()
            assert r.n_chars == len(r.text)


def test_runs_through_on_given_and_empty_tables(spark, empty):
    import corpus_pipeline as P
    assert P.run(spark, empty).collect() == []
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_toxic_documents_go_and_clean_ones_stay(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = P.toxicity(spark, docs, sf).select("doc_id").join(labels, "doc_id")
    n = {r["toxic"]: r["count"] for r in kept.groupBy("toxic").count().collect()}
    all_n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert n.get(1, 0) <= 0.25 * all_n[1] and n[0] >= 0.99 * all_n[0]

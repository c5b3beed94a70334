"""Near duplicates by circulant MinHash.

All signature coordinates come from two permutations of one universe: the first
scatters a shingle's hash, the second, shifted circularly by k, gives the value
whose minimum is coordinate k. So a shingle contributes a run of neighbouring
table entries and no second hash is ever computed. Signatures are cut into
bands; documents that share a band value are candidates, and every link is
confirmed by the Jaccard similarity of the full shingle sets.

Work per group, never per pair of a group:

1. documents with equal sets are one class (its least doc_id stands for it);
2. every bucket of a band has a head, its least class. Each class is checked
   against the least of its buckets' heads: one check a class, however large its
   buckets are. Confirmed links give components;
3. a class whose other heads still lie in other components is checked against
   these, too;
4. classes of buckets that still hold several components are compared by their
   rare shingles. In one order of all their shingles, rarest first, two linked sets
   share one among the first n - ceil(limit n) + 1 of each. So classes meet by each of
   these that another has; a class whose first shingles stand nowhere else makes no row. Where
   classes meet they are held against each other inside the task, a block of BLOCK with
   another. If the shingle is the first they share, what comes after it bounds all they
   share; only pairs for which that is enough, in different components, leave the
   task to be verified. No link is lost, and copies that are alike but
   below the limit, which share every band, are hardly ever paired.

A class is told apart by doc_id and text, so rows of one doc_id with several texts
are each checked; as one document they share a component.

Defined results: texts without words have no shingles, link with nothing and
are their own component; texts with fewer words than a shingle have their whole
sequence as one; rows with a null doc_id get a null component and are kept;
repeated rows share their component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise
from .components import components
from .shingles import FACTOR, mix, shingle_sets

WIDTH = 5
#: Similarity in hundredths that links two documents.
PERCENT = 80
COORDINATES = 256
UNIVERSE = 1 << 20
#: Classes of a block that meet by one shingle.
BLOCK = 512
MISS = 1e-4
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def bands_for(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most selective bands that miss a pair at the threshold with a chance below ``miss``."""
    best = (coordinates, 1)
    for rows in range(1, coordinates + 1):
        bands = coordinates // rows
        if (1 - (percent / 100) ** rows) ** bands < miss:
            best = (bands, rows)
    return best


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the shifted one's runs of ``coordinates`` entries by place."""
    if coordinates not in _TABLES:
        rng = np.random.default_rng(20)
        scatter = rng.permutation(UNIVERSE).astype(np.int32)
        ring = rng.permutation(UNIVERSE).astype(np.int32)
        ring = np.concatenate([ring[UNIVERSE - coordinates + 1:], ring])
        _TABLES[coordinates] = scatter, np.lib.stride_tricks.sliding_window_view(ring, coordinates)
    return _TABLES[coordinates]


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Coordinate k: the least value, over the set, of the second permutation shifted by k."""
    scatter, runs = permutations(coordinates)
    place = scatter[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    least = np.full(coordinates, UNIVERSE, np.int32)
    for at in range(0, len(place), 2048):
        np.minimum(least, runs[place[at:at + 2048]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    x = sig[:bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows):
        key = mix(key * FACTOR + x[:, k])
    return key.astype(np.int64)


def signatures(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, text_md5, n_shingles, set_hash and band keys (null without shingles)."""
    bands, rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sets = shingle_sets(batch.column(2).to_pylist(), width)
                keys = [band_keys(signature(s), bands, rows) if len(s) else None for s in sets]
                yield pa.record_batch([
                    batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "text_md5", "n_shingles", "set_hash", "bands"])

    return docs.mapInArrow(run, "doc_id long, text_md5 string, n_shingles long, set_hash binary, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, a_md5, b, b_md5) with the sizes of their sets' intersection and union."""
    t = texts.select(F.col("doc_id").alias("b"), F.col("text_md5").alias("b_md5"), F.col("text").alias("b_text"))
    u = texts.select(F.col("doc_id").alias("a"), F.col("text_md5").alias("a_md5"), F.col("text").alias("a_text"))
    rows = pairs.join(t, ["b", "b_md5"]).join(u, ["a", "a_md5"]).select("a", "a_md5", "b", "b_md5", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 300):
                batch = whole.slice(lo, 300)
                ta, tb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
                distinct = sorted(set(ta) | set(tb))
                sets = dict(zip(distinct, shingle_sets(distinct, width)))
                both = [len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(ta, tb)]
                size = [len(sets[x]) + len(sets[y]) - n for x, y, n in zip(ta, tb, both)]
                yield pa.record_batch([*[batch.column(i) for i in range(4)], pa.array(both, pa.int64()), pa.array(size, pa.int64())],
                                      names=["a", "a_md5", "b", "b_md5", "both", "size"])

    return rows.mapInArrow(run, "a long, a_md5 string, b long, b_md5 string, both long, size long")


def link(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (least doc_id with the same set)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"), F.col(text_col).alias("text"))
    s = materialise(signatures(texts, percent, width), "signatures")
    classes = materialise(s.filter("doc_id is not null and n_shingles > 0").groupBy("set_hash")
                          .agg(F.min(F.struct("doc_id", "text_md5")).alias("rep"), F.first("n_shingles").alias("n"),
                               F.first("bands").alias("bands"))
                          .select("set_hash", F.col("rep.doc_id").alias("a"), F.col("rep.text_md5").alias("a_md5"),
                                  "n", "bands"), "classes")
    rows = classes.select("a", "a_md5", "n", F.explode("bands").alias("bucket"))
    head = (rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("a", "a_md5", "n")).alias("h"))
            .filter("size > 1").select("bucket", F.col("h.a").alias("b"), F.col("h.a_md5").alias("b_md5"), F.col("h.n").alias("bn")))
    members = materialise(rows.join(head, "bucket"), "buckets")

    def sizes_allow(n, m):
        return 100 * F.least(n, m) >= percent * F.greatest(n, m)

    heads = (members.filter("a <> b").filter(sizes_allow(F.col("n"), F.col("bn")))
             .select("a", "a_md5", "b", "b_md5").distinct())
    least = heads.groupBy("a", "a_md5").agg(F.min(F.struct("b", "b_md5")).alias("h")).select("a", "a_md5", "h.*")
    checked = materialise(verify(least, texts, width).distinct(), "checked")
    found = materialise(components(_linked(checked, percent), "a", "b"), "components")

    pair = ["a", "a_md5", "b", "b_md5"]
    apart = (_with_component(_with_component(heads, found, "a"), found, "b").filter("a_component <> b_component")
             .join(checked.select(*pair), pair, "left_anti").select(*pair))
    checked = materialise(checked.union(verify(materialise(apart, "apart"), texts, width)).distinct(), "checked")
    found = materialise(components(_linked(checked, percent), "a", "b"), "components")

    more = _across(members, found, texts, percent, width)
    if not more.isEmpty():
        links = materialise(_linked(checked, percent).union(_linked(verify(more, texts, width), percent)), "links")
        found = materialise(components(links, "a", "b"), "components")

    return (s.join(classes.select("set_hash", F.col("a").alias("class_id")), "set_hash", "left")
            .join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id")).alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.coalesce("component", "class_id", "doc_id"), F.lit(True)).alias("kept"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "text_md5"))


def _linked(checked: DataFrame, percent: int) -> DataFrame:
    return checked.filter(F.col("both") * 100 >= F.col("size") * percent).select("a", "b")


def _with_component(df: DataFrame, found: DataFrame, node: str) -> DataFrame:
    """Adds <node>_component: the component of column ``node``, itself where it has no link."""
    got = found.select(F.col("node").alias(node), F.col("component").alias(f"{node}_component"))
    return df.join(got, node, "left").withColumn(f"{node}_component", F.coalesce(f"{node}_component", node))


def _shingle_rows(classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, a_md5, shingle): the sets of the classes, one row a shingle."""
    t = texts.select(F.col("doc_id").alias("a"), F.col("text_md5").alias("a_md5"), "text").dropDuplicates(["a", "a_md5"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 300):
                batch = whole.slice(lo, 300)
                sets = shingle_sets(batch.column(2).to_pylist(), width)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))],
                                      names=["a", "a_md5", "shingles"])

    return (t.join(classes.select("a", "a_md5"), ["a", "a_md5"], "left_semi").select("a", "a_md5", "text")
            .mapInArrow(run, "a long, a_md5 string, shingles array<long>").select("a", "a_md5", F.explode("shingles").alias("shingle")))


def _across(members: DataFrame, found: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs in different components, of classes that lie in a bucket with several, which rare shingles don't rule out."""
    key = ["a", "a_md5"]
    m = _with_component(members, found, "a").select("bucket", *key, "n", F.col("a_component").alias("component"))
    several = m.groupBy("bucket").agg((F.min("component") != F.max("component")).alias("x")).filter("x").select("bucket")
    m = materialise(m.join(several, "bucket", "left_semi").select(*key, "n", "component").distinct(), "mixed")
    rows = materialise(_shingle_rows(m, texts, width), "mixed-shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    # shingles that stand in one class alone are the rarest; they fill the first places and match nothing
    shared = (rows.join(common, "shingle").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared")))
    first = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    own = F.col("n") - F.size("shared")
    rare = (m.join(shared, key).select(*key, "n", "component", F.posexplode(F.slice("shared", 1, F.greatest(first - own, F.lit(0)).cast("int"))).alias("k", "s"), own.alias("own"))
            .select(*key, "n", "component", F.col("s.shingle").alias("shingle"), (F.col("own") + F.col("k")).cast("long").alias("place")))
    rare = materialise(rare, "rare-shingles")
    met = (rare.groupBy("shingle").agg(F.count("*").alias("size"), (F.min("component") != F.max("component")).alias("x")).filter("x")
           .select("shingle", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    r = rare.join(met, "shingle").withColumn("own", F.pmod(F.xxhash64(*key), F.col("blocks")).cast("int"))
    r = r.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    at = ["shingle", "low", "high"]
    r = r.select("shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", *key, "n", "component", "place")
    pairs = r.repartition(*at).sortWithinPartitions(*at).mapInArrow(_possible(percent), "a long, a_md5 string, b long, b_md5 string")
    return materialise(pairs.distinct(), "across")


def _possible(percent: int):
    """Pairs that can be linked, from rows sorted by (shingle, low, high): one group of these at a time is held."""
    def pairs_of(group: list[tuple]) -> list[tuple]:
        own, n, component, place = (np.array([row[k] for row in group], np.int64) for k in (3, 6, 7, 8))
        ok = np.triu(component[:, None] != component[None, :], 1)
        if group[0][1] != group[0][2]:
            ok &= own[:, None] != own[None, :]
        ok &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))  # of shared shingles, by the limit on their share of the union
        left = n - place  # from this shingle on
        ok &= (left[:, None] >= need) & (left[None, :] >= need)
        return [(*group[i][4:6], *group[j][4:6]) for i, j in zip(*(x.tolist() for x in np.nonzero(ok)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple] = []

        def settled() -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string()) * 2)], names=["a", "a_md5", "b", "b_md5"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if held and row[:3] != held[0][:3]:
                    if len(held) > 1:
                        found += pairs_of(held)
                    held = []
                held.append(row)
            yield settled()
            found = []
        if len(held) > 1:
            found += pairs_of(held)
        yield settled()

    return run


def dedup(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The documents that are kept, one of each component, with their columns."""
    keep = (link(docs, percent, width).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct())
    md5 = F.md5(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_id"]) & (md5 == keep["_md5"]), "left_semi")

"""Nearest neighbours by collision counting over query-centred hash windows.

Every vector is projected on LINES random directions; the projections on one
line form a sorted array. A query opens a window around its own projection on
each line; virtual rehashing widens all windows by a factor, so a round only
looks at what the windows gained. A vector that lies in the windows of at least
THRESHOLD of the lines is verified by its exact distance. A query is done when
its k verified vectors of least distance lie within the round's radius: a vector
within the radius collides on a line with probability P_NEAR, so hardly any
such vector misses the threshold. The windows end when they hold all vectors,
so a query always gets k neighbours if there are so many.

Vectors are dealt into shards of at most about SHARD rows by a hash of their id
and each shard keeps its own sorted arrays; queries come in blocks to every
shard and bring back k rows each, which are merged by an aggregate. Collisions
are thus counted where the vector is, none is shuffled, and a hot vector value
only adds rows to all shards alike.

Defined results: a vector that is null, zero, empty or has a null or non-finite
component takes no part; vectors of another dimension are no candidates of a
query; equal distances go to the smaller vec_id, including thousands of exact
copies, since equal vectors collide alike and a round is always finished;
repeated rows with one id are candidates once each but for the query's own id,
and one query;
a query with fewer candidates than k gets all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LINES = 48
THRESHOLD = 33
#: Half a window is WIDTH x radius: a vector at the radius collides with probability P_NEAR.
WIDTH = 1.36
P_NEAR = 0.826
GROWTH = 1.2
SHARD = 20_000
QUERY_BLOCK = 2_000


class Shard:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        lines = np.random.default_rng(seed).normal(size=(vectors.shape[1], LINES))
        self.lines = lines
        projected = self.vectors @ lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(projected, self.order.T, axis=0).T.copy()

    def nearest(self, own: int, query: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """ids and distances of the k nearest found, by distance, then id."""
        n = len(self.ids)
        center = query @ self.lines
        lo = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, center)])
        hi = lo.copy()
        hits = np.zeros(n, np.int16)
        checked = np.zeros(n, bool)
        found = np.zeros(0, np.int64)
        distance = np.zeros(0)
        while True:
            half = WIDTH * radius
            gained = []
            for j in range(LINES):
                a = np.searchsorted(self.sorted[j], center[j] - half, "left")
                b = np.searchsorted(self.sorted[j], center[j] + half, "right")
                gained += [self.order[j, a:lo[j]], self.order[j, hi[j]:b]]
                lo[j], hi[j] = min(a, lo[j]), max(b, hi[j])
            gained = np.concatenate(gained)
            if len(gained):
                hits += np.bincount(gained, minlength=n).astype(np.int16)
                new = np.flatnonzero((hits >= THRESHOLD) & ~checked)
                if len(new):
                    checked[new] = True
                    found = np.concatenate([found, new])
                    distance = np.concatenate([distance, np.sqrt(((self.vectors[new] - query) ** 2).sum(1))])
            other = self.ids[found] != own
            if (distance[other] <= radius).sum() >= k or checked.all():
                break
            radius *= GROWTH
        found, distance = found[other], distance[other]
        best = np.lexsort((self.ids[found], distance))[:k]
        return self.ids[found[best]], distance[best]

    def first_radius(self) -> float:
        """A small step of the projections' spread, below any useful radius."""
        spread = float(np.median(self.sorted[:, -1] - self.sorted[:, 0]))
        return max(spread / 200, 1e-12)


def usable(vector: Column) -> Column:
    """Not null, some component not zero, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return (vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")))


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, itself left out."""
    base, asked = _rows(vectors, id_col, vec_col), _rows(queries, id_col, vec_col).distinct()
    shards = base.count() // SHARD + 1
    blocks = asked.count() // QUERY_BLOCK + 1
    seat = F.pmod(F.xxhash64("id", "v"), F.lit(shards))
    data = (base.withColumn("shard", seat).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    ask = (asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
           .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))
    keys = ["shard", "block", "dim"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            shard = Shard(left.column("id").to_numpy(), left.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim))
            points = right.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            radius = shard.first_radius()
            for q, point in zip(right.column("id").to_pylist(), points):
                ids, d = shard.nearest(q, point, k, radius)
                out.append(pa.table({"query_id": pa.array(np.full(len(ids), q, np.int64)), "vec_id": pa.array(ids), "score": pa.array(d)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
                                                           "score": pa.array([], pa.float64())})

    found = (data.groupBy(*keys).cogroup(ask.groupBy(*keys))
             .applyInArrow(run, "query_id long, vec_id long, score double"))
    # Spark keeps k rows of a query per task before it shuffles them
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

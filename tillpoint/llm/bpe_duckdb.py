"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one per batch of a partition.

Encoding: the distinct pre-tokens (matches of the pattern) of a batch become
token-position rows, one per byte. A recursive query joins every row and its
successor to the merge table, contracts each pre-token's leftmost pair of least
rank, and repeats with the pre-tokens that changed until none has a pair left.
Rows link to their successor, so a step is hash aggregates and hash joins, no
sort. Decoding joins ids to the vocabulary's bytes and concatenates them by an
ordered aggregate.

A Python worker keeps the ids of pre-tokens it has met (bounded), so one that
repeats costs a lookup. DuckDB runs in the task's own process, on one thread,
in memory, over one bounded batch at a time. A pre-token of more than LONG bytes would need
that many recursion steps over that many rows; such rare ones are contracted by
the same rule over a heap of pairs in Python.

Defined results: null text counts as empty and gives zero ids; invalid pairs do
not exist, since every byte is a token; repeated rows are encoded once each;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import space_chunks

#: Pre-tokens of more bytes than this go to the heap.
LONG = 256
#: Pre-tokens in a generation of a worker's memory, pre-tokens in one recursive query, documents in a batch.
CACHE_WORDS = 400_000
QUERY_WORDS = 40_000
BATCH_DOCS = 1000

# One step: ``b`` holds each pre-token's leftmost pair of least rank (p, id), its right half (q) and what
# follows that; rows of a pre-token without a pair end there, so its last step holds its ids.
ENCODE = """
WITH RECURSIVE s(it, w, g, tok, nx, ntok, k) AS (
  SELECT 0, i.w, i.g, i.tok, i.nx, i.ntok, (m.id::BIGINT << 32) | i.g
  FROM start i LEFT JOIN merges m ON m.l = i.tok AND m.r = i.ntok
  UNION ALL
  SELECT u.it, u.w, u.g, u.tok, u.nx, u.ntok, (m.id::BIGINT << 32) | u.g
  FROM (SELECT s.it + 1 AS it, s.w, s.g,
               CASE WHEN s.g = b.p THEN b.id ELSE s.tok END AS tok,
               CASE WHEN s.g = b.p THEN b.qnx ELSE s.nx END AS nx,
               CASE WHEN s.g = b.p THEN b.qntok WHEN s.nx = b.p THEN b.id ELSE s.ntok END AS ntok
        FROM s JOIN (SELECT a.w, a.p, a.id, q.g AS q, q.nx AS qnx, q.ntok AS qntok
                     FROM (SELECT w, (min(k) & 4294967295)::INT AS p, (min(k) >> 32)::INT AS id, arg_min(nx, k) AS q
                           FROM s WHERE k IS NOT NULL GROUP BY w) a
                     JOIN s q ON q.g = a.q) b ON s.w = b.w
        WHERE s.g <> b.q) u
  LEFT JOIN merges m ON m.l = u.tok AND m.r = u.ntok
)
SELECT s.w, list(s.tok ORDER BY s.g) AS ids
FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) e ON s.w = e.w AND s.it = e.it
GROUP BY s.w
"""
DECODE = """
SELECT s, string_agg(v.hexed, '' ORDER BY pos) AS hexed FROM seq JOIN vocab v USING (id) GROUP BY s
"""


class DuckBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # every way to write a token as two tokens: the pair's rank is the token's
        left, right, ids = [], [], []
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), ids.append(i)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(":memory:")
        self.con.execute("SET threads = 1; SET memory_limit = '350MB'; SET preserve_insertion_order = false")
        self._fill("merges", {"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()),
                              "id": pa.array(ids, pa.int32())})
        self._fill("vocab", {"id": pa.array(self.ranks.values(), pa.int32()),
                             "hexed": pa.array([t.hex() for t in self.ranks])})
        self.recent: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _fill(self, name: str, columns: dict) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _ask(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table()

    # ---- encoding

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        for at in range(0, len(short), QUERY_WORDS):
            part = short[at:at + QUERY_WORDS]
            for k, ids in self._query([words[i] for i in part]):
                out[part[k]] = ids
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = self._heap(w)
        return out

    def _query(self, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        size = np.array([len(w) for w in words], np.int64)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(tok)
        g = np.arange(n, dtype=np.int32)
        last = np.zeros(n, bool)
        last[np.cumsum(size) - 1] = True
        nx, ntok = np.roll(g, -1), np.roll(tok, -1)
        self.con.register("start", pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), size), "g": g, "tok": tok,
            "nx": pa.array(nx, mask=last), "ntok": pa.array(ntok, mask=last)}))
        got = self._ask(ENCODE)
        self.con.unregister("start")
        which = got.column("w").to_numpy()
        ids = got.column("ids").combine_chunks()
        flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        for k, w in enumerate(which.tolist()):
            yield w, flat[offsets[k]:offsets[k + 1]]

    def _heap(self, word: bytes) -> np.ndarray:
        """The same contraction for one long pre-token: a heap of (rank, position), stale entries skipped."""
        n = len(word)
        tok = [word[i:i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(word[i:i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and nxt[i] < n and (r := rank(tok[i] + tok[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, len(tok[i]) + len(tok[nxt[i]])))

        while heap:
            r, i, width = heapq.heappop(heap)
            if tok[i] is None or nxt[i] >= n:
                continue
            j = nxt[i]
            pair = tok[i] + tok[j]
            if len(pair) != width or rank(pair) != r:
                continue
            tok[i], tok[j] = pair, None
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(i)
            push(prv[i])
        return np.array([self.ranks[t] for t in tok if t is not None], np.int32)

    # ---- decoding

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """Bytes of each id sequence, by an ordered aggregate over the vocabulary join."""
        out = [b""] * len(sequences)
        size = np.array([len(s) for s in sequences], np.int64)
        if not size.sum():
            return out
        self.con.register("seq", pa.table({
            "s": np.repeat(np.arange(len(sequences), dtype=np.int32), size),
            "pos": np.arange(size.sum()), "id": np.concatenate(sequences).astype(np.int32)}))
        got = self._ask(DECODE)
        self.con.unregister("seq")
        for s, h in zip(got.column("s").to_pylist(), got.column("hexed").to_pylist()):
            out[s] = bytes.fromhex(h)
        return out

    # ---- texts

    def _words(self, wanted: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """Of each pre-token its ids in decimal and the bytes they decode to. Two generations are kept:
        a full one becomes the older one, and what is not used again leaves with it."""
        known = {w: v for w in wanted if (v := self.recent.get(w) or self.older.get(w)) is not None}
        new = sorted(wanted.difference(known))
        ids = self.encode_words([w.encode() for w in new])
        for w, i, b in zip(new, ids, self.decode(ids)):
            known[w] = (" ".join(map(str, i.tolist())).encode(), b)
        if len(self.recent) > CACHE_WORDS:
            self.recent, self.older = {}, self.recent
        self.recent.update(known)
        return known

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens of a space and ``chunk``; the usual shapes (letters, then at most one mark) need no pattern."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[:-1].isalpha() and chunk[-1:] in ".,;:!?":
            return [" " + chunk[:-1], chunk[-1:]]
        return self.pattern.findall(" " + chunk)

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text: its ids in decimal joined by a space, and the bytes these ids decode to."""
        cuts = [space_chunks(t) for t in texts]
        heads = [self.pattern.findall(t if c is None else c[0]) for t, c in zip(texts, cuts)]
        split = {c: self._split(c) for c in set().union(*(c[1:] for c in cuts if c))}
        known = self._words(set().union(*heads, *split.values()))
        chunk = {}
        for c, ws in split.items():
            if len(ws) == 1:
                chunk[c] = known[ws[0]]
            else:
                got = [known[w] for w in ws]
                chunk[c] = (b" ".join([a for a, _ in got]), b"".join([b for _, b in got]))
        out = []
        for head, c in zip(heads, cuts):
            got = [known[w] for w in head]
            if c:
                got += [chunk[x] for x in c[1:]]
            out.append((b" ".join([a for a, _ in got]), b"".join([b for _, b in got])))
        return out


_WORKERS: dict[tuple[str, str], DuckBpe] = {}


def worker(path: str, pattern: str) -> DuckBpe:
    """One encoder per Python worker, kept between its tasks."""
    key = (path, pattern)
    if key not in _WORKERS:
        _WORKERS[key] = DuckBpe(path, pattern)
    return _WORKERS[key]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (decimal, joined by one space), decoded (bytes the ids decode to)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(lo, BATCH_DOCS)
                got = bpe.encode_texts(batch.column(1).to_pylist())
                yield pa.record_batch([batch.column(0), pa.array([a.decode() for a, _ in got], pa.string()),
                                       pa.array([b for _, b in got], pa.binary())], names=["doc_id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, ids string, decoded binary")


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's row per document; digests are taken where the ids are made."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path, pattern)
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(lo, BATCH_DOCS)
                got = bpe.encode_texts(batch.column(1).to_pylist())
                yield pa.record_batch([
                    batch.column(0), pa.array([a.count(b" ") + bool(a) for a, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(a).hexdigest() for a, _ in got], pa.string()),
                    pa.array([hashlib.sha256(b).hexdigest() for _, b in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Repeated-substring dedup by merging Burrows-Wheeler transforms of shards.

Every byte covered by a LENGTH-byte string that also starts anywhere else, in
any document, is removed. All comparisons are on the input.

1. Windows of LENGTH bytes are grouped by their minimizer (``windows.blocks``);
   equal windows always meet in one group. A run of windows with the same
   minimizer is one row. Runs whose bytes occur twice are repeated as a whole;
   a group with a single run holds nothing repeated. Both are settled by counts.
2. Groups with several different runs - the ends of matches - are compared
   byte by byte. Their distinct runs are dealt out by group, so each task has
   whole groups, some megabytes at a time. These are cut into shards; each
   shard's suffixes are sorted by themselves into a Burrows-Wheeler transform
   over two-byte symbols. The transforms are merged by interleave refinement:
   starting from one interval, each round reads the symbol before every
   suffix, deals the suffixes out by it (stable, so the earlier order holds)
   and splits intervals where the symbol or the earlier interval differs. After
   r rounds an interval's suffixes share 2 r bytes. No suffix is compared or
   sorted anew; suffixes alone in their interval, and those that can't become
   the start of a window, take no further part. After LENGTH / 2 rounds the
   intervals left are the repeated windows.
3. A group of more than MERGE_RUNS distinct runs would not fit a task's
   memory. Its windows are counted by a 64-bit hash instead, one row each, which
   Spark spreads and pre-aggregates.

Identity of runs (step 1) and of windows in step 3 is by 64-bit hashes within a
minimizer's group.

Defined results: null text is empty; texts shorter than LENGTH lose nothing;
a row repeated in full is another place, so its windows count as repeated;
rows of one doc_id with different texts are told apart by a hash of the text;
extra columns pass through ``dedup``. What is left of a text can end inside a
multi-byte character; ``dedup`` drops the incomplete bytes of such a character
from its text, ``digest`` hashes the exact bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import drop_table
from .common import materialise
from .shingles import mix, powers
from .windows import blocks

LENGTH = 200
SHARD_BYTES = 1 << 20
MERGE_BYTES = 3 << 20
MERGE_RUNS = 10_000
BATCH_BYTES = 2_000_000
#: A run's first start times this, plus its number of starts (less than a window's length), is one number.
PLACE = 1 << 16


# ---- numpy inside tasks

def shard_transform(strings: list[np.ndarray], symbol_of: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Burrows-Wheeler transform of a shard, over two-byte symbols.

    Every string gets two end marks. Returns, by rank of the suffix: the symbol before it (0: none), the
    rank of the suffix two bytes earlier; and the rank by place. Sorted to ``depth`` bytes by doubling: first by as many
    bytes as fit a number, then only suffixes whose bytes so far are not theirs alone, inside their interval."""
    sizes = np.array([len(s) + 2 for s in strings])
    n = int(sizes.sum())
    ends = np.cumsum(sizes)
    byte = np.zeros(n + 2, np.int64)
    mark = np.zeros(n, bool)
    mark[ends - 1] = mark[ends - 2] = True
    byte[:n][~mark] = symbol_of[np.concatenate(strings)] if strings else []
    base = int(byte.max()) + 1
    symbol = byte[:-1] * base + byte[1:]
    symbol[:n][mark] = 0  # end marks are empty suffixes, all alike
    left = np.repeat(ends, sizes) - np.arange(n)  # places to the string's end, this one included
    width, key = 1, byte[:n].copy()
    while width < min(depth, n) and base ** (width + 1) < 1 << 62:
        key *= base
        key[:-width] += np.where(left[:-width] > width, byte[width:n], 0)
        width += 1
    rank = np.zeros(n, np.int64)  # where a suffix's interval begins
    tied = np.arange(n)
    while True:
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        opens = np.ones(len(tied) + 1, bool)
        opens[1:-1] = key[1:] != key[:-1]
        first = np.flatnonzero(opens)
        inside = first[np.cumsum(opens[:-1]) - 1]  # the first of those with the same bytes
        old = rank[tied]
        outer = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]])) if len(tied) else first
        counts = np.diff(np.append(outer, len(tied)))
        rank[tied] = old + inside - np.repeat(outer, counts)
        tied = tied[~(opens[:-1] & opens[1:])]
        if not len(tied) or width >= depth:
            break
        later = np.zeros(len(tied), np.int64)
        has = left[tied] > width
        later[has] = rank[tied[has] + width] + 1
        key = rank[tied] * (n + 2) + later
        width *= 2
    # those still tied keep their order in the shard
    place = rank
    tied = np.sort(tied)
    tied = tied[np.argsort(rank[tied], kind="stable")]
    old = rank[tied]
    outer = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]])) if len(tied) else np.zeros(0, np.int64)
    place[tied] = old + np.arange(len(tied)) - np.repeat(outer, np.diff(np.append(outer, len(tied))))
    order = np.empty(n, np.int64)
    order[place] = np.arange(n)
    begin = np.repeat(ends - sizes, sizes)
    has = order - begin[order] >= 2
    before = np.zeros(n, np.int64)
    before[has] = symbol[order[has] - 2]
    back = np.zeros(n, np.int64)
    back[has] = place[order[has] - 2]
    return before, back, place


def merge(strings: list[np.ndarray], starts: list[int], length: int = LENGTH,
          shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each string, which of its first ``starts`` windows of ``length`` bytes occur twice among all.

    Each string has ``starts + length - 1`` bytes. ``length`` must be even."""
    used = np.zeros(256, np.int64)
    for s in strings:
        used[s] = 1
    symbol_of = np.cumsum(used)
    kind = np.uint16 if (int(symbol_of[-1]) + 1) ** 2 < 1 << 16 else np.uint32
    before, back, first = [], [], []
    at = base = 0
    while at < len(strings):
        part, size = [], 0
        while at < len(strings) and (not part or size < shard_bytes):
            part.append(strings[at])
            size += len(strings[at]) + 2
            at += 1
        own_before, own_back, place = shard_transform(part, symbol_of, length + 2)
        # symbols of all shards must compare alike
        largest = int(symbol_of[np.concatenate(part)].max()) + 1
        high, low = own_before // largest, own_before % largest
        before.append((high * (int(symbol_of[-1]) + 1) + low).astype(kind))
        back.append((own_back + base).astype(np.int32))
        begin = 0
        for s in part:
            first.append(place[begin + length:begin + len(s) + 1] + base)  # where the windows' chains begin
            begin += len(s) + 2
        base += size
    before, back = np.concatenate(before), np.concatenate(back)
    suffix = np.concatenate(first).astype(np.int32)
    window = np.arange(len(suffix), dtype=np.int32)  # the window a suffix will become
    interval = np.zeros(len(suffix), np.int32)
    for _ in range(length // 2):
        symbol = before[suffix]
        order = np.argsort(symbol, kind="stable")
        symbol, interval = symbol[order], interval[order]
        opens = np.ones(len(order) + 1, bool)
        opens[1:-1] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(opens[:-1] & opens[1:])
        order = order[shared]
        suffix, window = back[suffix[order]], window[order]
        interval = np.cumsum(opens[:-1], dtype=np.int32)[shared]
        if not len(suffix):
            break
    twice = np.zeros(sum(starts), bool)
    twice[window] = True
    return np.split(twice, np.cumsum(starts)[:-1])


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def window_hashes(body: np.ndarray, length: int = LENGTH) -> np.ndarray:
    up, down = powers(len(body) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:len(body)])])
    return mix((total[length:] - total[:-length]) * down[:len(body) - length + 1])


# ---- Spark

def _runs_table(texts: DataFrame, length: int) -> DataFrame:
    """One row per run of windows: text's key, place (first start and starts), minimizer hash, hash of the bytes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = np.array([len(x) for x in batch.column(2).to_pylist()])
            while at < batch.num_rows:
                stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_BYTES)))
                part = batch.slice(at, stop - at)
                which, start, count, _, group, body = blocks([x.encode() for x in part.column(2).to_pylist()], length)
                ids, keys = part.column(0).take(pa.array(which)), part.column(1).take(pa.array(which))
                yield pa.record_batch([ids, keys, pa.array(start * PLACE + count),
                                       pa.array(group.view(np.int64)), pa.array(body.view(np.int64))],
                                      names=["doc_id", "text_key", "place", "grp", "body"])
                at = stop

    return texts.mapInArrow(cut, "doc_id long, text_key long, place long, grp long, body long")


def _contents(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Adds the bytes of each wanted run (grp, body, n, doc_id, text_key, first, starts)."""
    per_text = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("grp", "n", "place")).alias("runs"))
    rows = per_text.join(texts, ["doc_id", "text_key"])
    rows = rows.select("doc_id", "text_key", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                for r in wanted:
                    first, starts = divmod(r["place"], PLACE)
                    out.append((doc_id, key, r["grp"], r["n"], first, starts, raw[first:first + starts + length - 1]))
            for at in range(0, len(out), 5000):
                cols = list(zip(*out[at:at + 5000]))
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                       pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()),
                                       pa.array(cols[6], pa.binary())],
                                      names=["doc_id", "text_key", "grp", "n", "first", "starts", "bytes"])

    return rows.mapInArrow(cut, "doc_id long, text_key long, grp long, n long, first int, starts int, bytes binary")


_SPAN = "doc_id long, text_key long, lo int, hi int"


def _merged(rows: DataFrame, tasks: int, length: int) -> DataFrame:
    """Spans of repeated windows in runs that occur once, by merging the transforms of each task's groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def settle() -> pa.RecordBatch:
            found = merge([np.frombuffer(r[6], np.uint8) for r in held], [r[5] for r in held], length)
            spans = [(r[0], r[1], r[4] + a, r[4] + b - 1 + length) for r, flags in zip(held, found) if r[3] == 1
                     for a, b in runs(flags)]
            cols = list(zip(*spans)) if spans else [[], [], [], []]
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                                    pa.array(cols[3], pa.int32())], names=["doc_id", "text_key", "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if size > MERGE_BYTES and row[2] != held[-1][2]:
                    yield settle()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield settle()

    return rows.repartition(tasks, "grp").sortWithinPartitions("grp").mapInArrow(run, _SPAN)


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """The same for groups too large to merge: one row per window, counted by hash."""
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, key, grp, n, first, starts, body in zip(*(batch.column(i).to_pylist() for i in range(7))):
                h = window_hashes(np.frombuffer(body, np.uint8), length)
                yield pa.record_batch([pa.array(np.full(starts, doc_id)), pa.array(np.full(starts, key)),
                                       pa.array(np.full(starts, grp)), pa.array(np.full(starts, n)),
                                       pa.array(np.arange(first, first + starts, dtype=np.int32)), pa.array(h.view(np.int64))],
                                      names=["doc_id", "text_key", "grp", "n", "start", "h"])

    each = rows.mapInArrow(explode, "doc_id long, text_key long, grp long, n long, start int, h long")
    twice = each.groupBy("grp", "h").agg(F.count("*").alias("c")).filter("c > 1").select("grp", "h")
    return (each.filter("n = 1").join(twice, ["grp", "h"])
            .select("doc_id", "text_key", F.col("start").alias("lo"), (F.col("start") + length).alias("hi")))


def spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and ``spans``: repeated byte ranges (lo, hi) of each text that has any; they can overlap."""
    texts = keyed(docs, id_col, text_col)
    table = materialise(_runs_table(texts.filter(F.octet_length("text") >= length), length), "runs")
    same = materialise(table.groupBy("grp", "body").agg(F.count("*").alias("n"),
                                                        F.min(F.struct("doc_id", "text_key", "place")).alias("at")), "run-counts")
    repeated = materialise(same.filter("n > 1").select("grp", "body"), "repeated-runs")
    first, starts = F.shiftright("place", 16), F.col("place").bitwiseAND(F.lit(PLACE - 1))
    whole = materialise(table.join(repeated, ["grp", "body"]).select(
        "doc_id", "text_key", first.cast("int").alias("lo"), (first + starts - 1 + length).cast("int").alias("hi")), "whole-runs")
    drop_table(table)  # one row a run; only the few that repeat are read below
    kinds = same.groupBy("grp").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).filter("kinds > 1 and fewest = 1")
    wanted = same.join(kinds.select("grp", "kinds"), "grp").select("grp", "n", "kinds", "at.*")
    wanted = materialise(wanted, "wanted-runs")
    drop_table(same)
    size = wanted.agg(F.sum(starts + length).alias("b"), F.max("kinds").alias("k")).first()
    found = whole
    if size["b"]:
        tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["b"] // MERGE_BYTES + 1)
        found = found.union(_merged(_contents(wanted.filter(F.col("kinds") <= MERGE_RUNS), texts, length), tasks, length))
        if size["k"] > MERGE_RUNS:
            found = found.union(_counted(_contents(wanted.filter(F.col("kinds") > MERGE_RUNS), texts, length), length))
    return found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("doc_id"), F.xxhash64(text).alias("text_key"),
                       text.alias("text"))


def cover(ranges: list[dict], n: int) -> np.ndarray:
    """Bytes that some range covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, [r["lo"] for r in ranges], 1)
    np.add.at(step, [r["hi"] for r in ranges], -1)
    return np.cumsum(step[:-1]) > 0


def _applied(docs: DataFrame, length: int, each: Callable, schema: str, extra: list, id_col: str, text_col: str) -> DataFrame:
    """``each(raw bytes, removed flags)`` for every row, beside ``extra`` columns."""
    found = spans(docs, length, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1 << 63)).alias("_own"), F.xxhash64(text).alias("_own_key"),
                       text.alias("_text"), F.struct(*extra).alias("_row"))
    rows = (rows.join(found, (F.col("_own") == F.col("_id")) & (F.col("_own_key") == F.col("_key")), "left")
            .select("_row", "_text", "spans"))
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                out.append(each(raw, cover(ranges, len(raw)) if ranges else None))
            cols = list(zip(*out)) or [[]] * len(schema.split(", "))
            names = [c.split()[0] for c in schema.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.record_batch([batch.column(0)] + [pa.array(c, kinds[s.split()[1]]) for c, s in zip(cols, schema.split(", "))],
                                  names=["_row", *names])

    return rows.mapInArrow(run, f"_row {kind}, {schema}")


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The contract's row per document."""
    def each(raw: np.ndarray, gone: np.ndarray | None) -> tuple:
        if gone is None:
            return len(raw), 0, 0, hashlib.sha256(raw.tobytes()).hexdigest()
        return len(raw), int(gone.sum()), len(runs(gone)), hashlib.sha256(raw[~gone].tobytes()).hexdigest()

    got = _applied(docs, length, each, "n_bytes long, n_removed long, n_spans long, kept_sha256 string",
                   [F.col("doc_id")], "doc_id", "text")
    return got.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated substrings cut out of their text; null texts stay null."""
    def each(raw: np.ndarray, gone: np.ndarray | None) -> tuple:
        return ((raw if gone is None else raw[~gone]).tobytes().decode(errors="ignore"),)

    got = _applied(docs, length, each, "_new string", [F.col(c) for c in docs.columns], id_col, text_col)
    new = F.when(F.col("_row")[text_col].isNotNull(), F.col("_new"))
    return got.select(*[new.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])

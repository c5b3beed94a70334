"""Language-model scoring by a hierarchical Pitman-Yor model.

Dishes are all training words, the end of a text and one unseen word. Every
one-word and every two-word context of the training texts is a restaurant; a
two-word context's parent is its last word's restaurant, and all of these share
the root. Customers are the corpus' n-gram counts; a table of a child is a
customer of its parent. The root has a diffuse base: every word has one table
and the unseen word the mass of a new one. Nothing is left out: the model grows
with the corpus.

Seating starts with one table a dish. A round of Gibbs moves seats each dish's
customers anew given all other tables of the round before: customer by customer,
and from BLOCK on in blocks of 1/16 of those seated, whose new tables are their
expected number, rounded by chance. SAMPLES chains run side by side; the scored
probability is the average of their predictive probabilities. A dish with one
customer always has one table, so rounds read only the other n-grams. Chances
come from a hash of the n-gram, so a task that runs again draws the same.

Each token w after t u goes once, packed, to the cell of u. There the restaurants
of t u and of u, their n-grams and the tables at them are all at hand; only tables
by word are summed over cells, once a round, and answered to them. A word u met more than CELL_TOKENS
times is spread over several cells by t; these have the customers of its pairs
summed, too. Rounds read the packed tokens again and keep only what they seated.
The last pass sends each text's part of the score from every cell. No n-gram is
written with its keys, so disk stays at a few bytes a token.

Words and n-grams are compared by 64-bit hashes. Defined results: a null text is
empty and has the end token alone; without training texts every score is 0.0
(the unseen word has probability 1); repeated rows are scored once each; other
columns are ignored. A text is known by its slice and place there, so a task that
runs again must read its rows in the same order, as a scan of files does.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import fold, materialise
from .shingles import mix, word_hashes

#: Length of text that a task turns into tokens at a time: a slice.
PART_BYTES = 8_000_000
#: Tokens that a task trains on together; a word that is met more often is spread over several cells.
CELL_TOKENS = 1_400_000
#: A text's part of a score goes out as a multiple of its inverse.
FIXED = float(1 << 32)
#: The most frequent words go out as numbers.
NUMBERED = 1 << 17
SAMPLES = 4
ROUNDS = 2
BLOCK = 64
STRENGTH = 1.0
END = np.uint64(0xA5A5A5A55A5A5A5B)
#: Stand for the begin of a text, and for a word that training doesn't have.
BEGIN = np.uint64(0x5A5A5A5BA5A5A5A5)
UNSEEN = np.uint64(0x3C3C3C3BC3C3C3C5)
PAIR = np.uint64(0x9E3779B97F4A7C15)
TRIPLE = np.uint64(0xD6E8FEB86659FD93)


# ---- tokens

def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token (words with A-Z in lower case, then an end) and the number of tokens of each text."""
    got = [_tokens(run) for run in _runs(texts)]
    return tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of about a megabyte."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size > 1_000_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raws = [(t or "").encode().lower() for t in texts]
    begins = np.cumsum([0] + [len(r) + 1 for r in raws])
    start, h = word_hashes(b" ".join(raws))
    words = np.diff(np.searchsorted(start, begins))
    ends = np.cumsum(words + 1) - 1
    out = np.empty(len(h) + len(raws), np.uint64)
    place = np.ones(len(out), bool)
    place[ends] = False
    out[place], out[ends] = h, END
    return out, words + 1


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * PAIR + w)


def triple_key(context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Of the pairs (t, u) and (u, w)."""
    return mix(context * TRIPLE + pair)


def before(h: np.ndarray, first: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The second and the first token before each, in texts that begin at ``first``; ``begin`` stands for none."""
    one = np.roll(h, 1)
    one[first] = begin
    two = np.roll(one, 1)
    two[first] = begin
    return two, one


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place of each, and each place's key.

    Places stand in the low bits while the keys are sorted; where that makes two keys alike, they are sorted whole."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int32)
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    both = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    found = keys[order]
    other = found[1:] != found[:-1]
    if (other & ((both[1:] ^ both[:-1]) <= low)).any():
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        other = found[1:] != found[:-1]
    new = np.concatenate([[True], other])
    number = np.empty(len(keys), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], order[new], number


def _batches(batches: Iterator[pa.RecordBatch], text: int = 0) -> Iterator[list[tuple]]:
    """Rows, some megabytes of text at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[text] or "")
            if size > PART_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counted(texts: DataFrame) -> DataFrame:
    """How often each token occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            h, n = np.unique(tokens([t for t, in part])[0], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["k", "n"])

    return materialise(texts.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")), "lm-words")


# ---- seating

def seat(c: np.ndarray, p: np.ndarray, others: np.ndarray, d: float, key: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers, base probability ``p`` and ``others`` tables of other dishes."""
    t = np.minimum(c, 1).astype(float)
    alive = np.flatnonzero(c > 1)
    done = 1
    while len(alive):
        block = 1 if done < BLOCK else done // 16
        new = (STRENGTH + d * (others[alive] + t[alive])) * p[alive]
        chance = new / (new + np.maximum(done - d * t[alive], 1e-9))
        size = np.minimum(block, c[alive] - done)
        luck = (mix(key[alive] + np.uint64(done * int(PAIR) % (1 << 64))) >> np.uint64(11)) / float(1 << 53)
        t[alive] += np.floor(size * chance + luck)
        done += block
        alive = alive[c[alive] > done]
    return t


def discount(ones: int, twos: int) -> float:
    """The usual estimate from how many counts are 1 and 2."""
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones else 0.5


# ---- what goes from task to task

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: first, second, ... bytes of all numbers side by side, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    return pickle.dumps(([(a.dtype.str, len(a)) for a in arrays], len(raw), pa.compress(raw, codec="zstd", asbytes=True)))


def unpack(data: bytes) -> list[np.ndarray]:
    kinds, size, body = pickle.loads(data)
    raw = np.frombuffer(pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _at(number: int) -> int:
    """Where a slice's results meet."""
    return int(mix(np.array([number], np.uint64))[0] >> np.uint64(33))


class Codes:
    """Short numbers of the most frequent words, with their counts, and the words dealt out by what stands before them.
    It only shortens what is sent: a word without a number (0) goes out as its hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, deal: int):
        self.hashes, self.counts = np.concatenate([[np.uint64(0), BEGIN], hashes]), np.concatenate([[0, 0], counts])
        self.order = np.argsort(self.hashes[1:]) + 1
        self.sorted = self.hashes[self.order]
        often = counts > CELL_TOKENS
        by = np.argsort(hashes[often])
        self.often, self.cells = hashes[often][by], -(-counts[often][by] // CELL_TOKENS)
        self.deal = deal

    def code(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], 0).astype(np.uint32)

    def place(self, t: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each token after t u, and whether u is so frequent that its contexts are spread over several."""
        cell, split = np.zeros(len(u), np.uint64), np.zeros(len(u), bool)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, u), len(self.often) - 1)
            split = self.often[at] == u
            cell[split] = mix(t[split]) % self.cells[at[split]].astype(np.uint64)
        return (mix(u + cell * PAIR) % np.uint64(self.deal)).astype(np.int64), split


def _sent(codes: Codes, floor: float, part: list[tuple], number: int) -> Iterator[tuple[int, bytes]]:
    """A slice's tokens by bucket, and what its own words tell of each text."""
    ids, texts, held = zip(*part)
    h, sizes = tokens(list(texts))
    first = np.cumsum(sizes) - sizes
    two, one = before(h, first, BEGIN)
    code = codes.code(h)
    code = [*before(code, first, 1), code]
    logs = np.where(code[2] > 0, np.log10((codes.counts[code[2]] + 0.1) / floor), 0.0)
    yield _at(number), pickle.dumps(("docs", number, (list(ids), list(held), sizes, np.add.reduceat(logs, first),
                                                      np.add.reduceat((code[2] > 0).astype(np.int64), first))))
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    out = np.repeat(np.array(held, np.uint8), sizes)
    bucket, split = codes.place(two, one)
    bucket = _small(bucket * 2 + split)
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, ends):
        kind = int(bucket[rows[0]])
        rare = [x[rows][c[rows] == 0] for x, c in zip((two, one, h), code)]
        yield kind // 2, pickle.dumps(("split" if kind % 2 else "own", number,
                                       pack(*(_small(c[rows]) for c in code), *rare, _small(np.diff(doc[rows], prepend=np.uint32(0))), out[rows])))


class Cell:
    """Tokens of some words u with all before and after them: their contexts, triples and pairs, trained by rounds.

    Tokens of held-out texts are looked up as n-grams with no customers. ``split``: pairs are
    shared with other cells, so their customers have to come from ``shared``, and the totals of u from ``all_u``."""

    def __init__(self, pieces: list[tuple[int, bytes]], codes: Codes, split: bool):
        self.split, self.turn = split, 0
        cols: list[list] = [[], [], [], [], [], []]
        pieces = sorted(pieces)
        for _, data in pieces:
            a = unpack(data)
            for col, code, rare in zip(cols, a[:3], a[3:6]):
                h = codes.hashes[code]
                h[code == 0] = rare
                col.append(h)
            cols[3].append(a[7])
            cols[4].append(np.cumsum(a[6], dtype=np.int32))
            cols[5].append(a[2] == 0)
        self.slices = [(number, len(c)) for (number, _), c in zip(pieces, cols[4])]
        t, u, w, held, self.doc, self.rare = (np.concatenate(cols.pop(0)) for _ in range(6))
        c, p = pair_key(t, u), pair_key(u, w)
        del t
        self.triples, at, self.of_token = groups(triple_key(c, p))
        u, w, c, p = u[at], w[at], c[at], p[at]
        self.n = np.bincount(self.of_token[held == 0], minlength=len(at))
        self.contexts, _, self.c = groups(c)
        self.pairs, at, self.p = groups(p)
        u, w = u[at], w[at]
        self.luck = triple_key(u, w)
        self.us, _, self.u = groups(u)
        self.ws, _, self.w = groups(w)
        del u, w, c, p, at, held
        self.known = np.bincount(self.w[self.p], weights=self.n, minlength=len(self.ws)).astype(np.int64)
        self.word_sums: dict[int, np.ndarray] = {}
        self.moving = np.flatnonzero(self.n > 1)
        self.seats = np.ones((SAMPLES, len(self.moving)))
        self.size = np.bincount(self.c, weights=self.n, minlength=len(self.contexts))
        single = self.n == 1
        self.still = np.bincount(self.c, weights=single, minlength=len(self.contexts))
        self.fixed = self.own_fixed = np.bincount(self.p, weights=single, minlength=len(self.pairs))
        self.customers = np.tile(self._tables(self.p, len(self.pairs), 0), (SAMPLES, 1))
        self.first = np.ones(len(self.pairs), bool)
        self.tables = np.minimum(self.fixed + self.customers, 1)

    def _tables(self, at: np.ndarray, size: int, s: int) -> np.ndarray:
        return np.bincount(at[self.moving], weights=self.seats[s], minlength=size)

    def shared(self, begin: bool, fixed: np.ndarray, customers: list[np.ndarray], first: np.ndarray) -> None:
        """What all cells together hold of this cell's pairs."""
        self.fixed, self.first = fixed.astype(float), first.astype(bool)
        self.customers = np.array([x.astype(float) for x in customers])
        if begin:
            self.tables = np.minimum(self.fixed + self.customers, 1)

    def sums(self) -> np.ndarray:
        """Customers and tables of each u, of every sample."""
        return np.array([np.bincount(self.u, weights=x * self.first, minlength=len(self.us)) for x in (*(self.fixed + self.customers), *self.tables)])

    def totals(self, all_u: dict) -> tuple[np.ndarray, np.ndarray]:
        got = np.array([all_u[x] for x in self.us.tolist()]).T.reshape(2 * SAMPLES, len(self.us)) if self.split else self.sums()
        return got[:SAMPLES], got[SAMPLES:]

    def seat_triples(self, root: np.ndarray, all_u: dict, d2: float, d3: float) -> None:
        s_u, r_u = self.totals(all_u)
        p, c = self.p[self.moving], self.c[self.moving]
        u, root, fixed = self.u[p], root[self.w[p]], self.fixed[p]
        k = mix(self.triples[self.moving] + np.uint64(2 * self.turn))
        for s in range(SAMPLES):
            base = ((fixed + self.customers[s][p] - d2 * self.tables[s][p]) + (STRENGTH + d2 * r_u[s][u]) * root) / (STRENGTH + s_u[s][u])
            others = (self.still + self._tables(self.c, len(self.contexts), s))[c] - self.seats[s]
            self.seats[s] = seat(self.n[self.moving], base, np.maximum(others, 0), d3, mix(k + np.uint64(s)))
        self.r_u = r_u

    def seat_pairs(self, root: np.ndarray, d2: float) -> None:
        if not self.split:
            for s in range(SAMPLES):
                self.customers[s] = self._tables(self.p, len(self.pairs), s)
        for s in range(SAMPLES):
            customers = np.rint(self.fixed + self.customers[s]).astype(np.int64)
            at = np.flatnonzero(customers > 1)
            others = np.maximum(self.r_u[s][self.u[at]] - self.tables[s][at], 0)
            k = mix(self.luck[at] + np.uint64(2 * self.turn + 1))
            self.tables[s] = np.minimum(customers, 1)
            self.tables[s][at] = seat(customers[at], root[self.w[at]], others, d2, mix(k + np.uint64(s)))
        self.turn += 1

    def state(self) -> bytes:
        """What the rounds have seated so far."""
        return pack(*(_small(x.astype(np.int64)) for x in self.seats),
                    *(_small(t[c > 1].astype(np.int64)) for t, c in zip(self.tables, self.fixed + self.customers)))

    def resume(self, turn: int, state: bytes) -> None:
        """Go on from the end of round ``turn``."""
        self.turn, kept = turn, unpack(state)
        self.seats = np.array(kept[:SAMPLES], float)
        if not self.split:
            self.customers = np.array([self._tables(self.p, len(self.pairs), s) for s in range(SAMPLES)])
        customers = self.fixed + self.customers
        self.tables = np.minimum(customers, 1)
        for t, c, x in zip(self.tables, customers, kept[SAMPLES:]):
            t[c > 1] = x

    def word_tables(self) -> np.ndarray:
        """Tables of each w in all samples together."""
        return np.bincount(self.w, weights=self.tables.sum(0) * self.first, minlength=len(self.ws)).astype(np.int64)

    def parts(self, all_u: dict, d2: float, d3: float) -> tuple[np.ndarray, ...]:
        """As floats: of each u weight and size; of pairs customers less discounts; of contexts weight and size; of triples as pairs."""
        s_u, r_u = self.totals(all_u)
        short = lambda x: np.asarray(x).astype(np.float32)
        rooms = np.array([self.still + self._tables(self.c, len(self.contexts), s) for s in range(SAMPLES)])
        own = (self.n == 1) * (1.0 - d3)
        least = np.maximum(self.n[self.moving] - d3 * self.seats, 0)
        own[self.moving] = (least[0] + least[1] + least[2] + least[3]) / SAMPLES
        return (short((STRENGTH + d2 * r_u) / (STRENGTH + s_u)), short(STRENGTH + s_u), short(np.maximum(self.fixed + self.customers - d2 * self.tables, 0)),
                short((STRENGTH + d3 * rooms) / (STRENGTH + self.size)), short(STRENGTH + self.size), short(own))

    def logs(self, root: np.ndarray, all_u: dict, d2: float, d3: float) -> np.ndarray:
        """log10 of the average predictive probability of each triple."""
        u_weight, u_size, pair, c_weight, c_size, own = self.parts(all_u, d2, d3)
        total = np.zeros(len(self.triples))
        for s in range(SAMPLES):
            p = pair[s] / u_size[s][self.u] + u_weight[s][self.u] * root.astype(np.float32)[self.w].astype(float)
            total += own / c_size[self.c] + c_weight[s][self.c] * p[self.p]
        return np.log10(total / SAMPLES)


# ---- sums over all cells, by key

def _ask(tag: str, who: int, keys: np.ndarray, values: list[np.ndarray], deal: int, again: bool) -> Iterator[tuple]:
    """A cell's numbers of its keys to where each key is summed; ``again``: the keys are there already."""
    block = (mix(keys) % np.uint64(deal)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    for to, rows in zip(range(deal), np.split(order, np.searchsorted(block[order], np.arange(1, deal)))):
        if len(rows):
            yield to, (tag, "values", who, pack(*(_small(v[rows]) for v in values)))
            if not again:
                yield to, ("keys", "", who, pack(keys[rows]))


def _summed(tag: str, records: Iterator[tuple]) -> tuple[list[tuple[int, int]], np.ndarray, list[np.ndarray], list]:
    """Askers with their number of keys, the position of each asker's keys, the sums, and what else came."""
    keys, values, others = {}, {}, []
    for _, (kind, what, who, data) in records:
        if kind == "keys":
            keys[who] = unpack(data)[0]
        elif kind == tag and what == "values":
            values[who] = unpack(data)
        elif kind == tag:
            others.append((what, who, data))
    if not keys:
        return [], np.zeros(0, np.int64), [], others
    askers = sorted(keys)
    _, at = np.unique(np.concatenate([keys[a] for a in askers]), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([values[a][i] for a in askers])).astype(np.int64) for i in range(len(values[askers[0]]))]
    return [(a, len(keys[a])) for a in askers], at, sums, others


def _answers(tag: str):
    """(asker, sums of its keys, and which of them it is the first to ask)"""
    def run(to: int, records: Iterator[tuple]) -> Iterator[tuple]:
        askers, at, sums, others = _summed(tag, records)
        for what, who, data in others:
            if what == "state":
                yield who // 2, (tag, 2 + who % 2, 0, data)
        first = np.zeros(len(at), np.uint8)
        first[np.unique(at, return_index=True)[1]] = 1
        begin = 0
        for who, n in askers:
            mine = slice(begin, begin + n)
            yield who // 2, (tag, who % 2, to, pack(*(_small(s[at[mine]]) for s in sums), first[mine]))
            begin += n
    return run


def _told(tag: str):
    """What cells told besides, and how many keys have first sums of four and of eight quarters, and their total."""
    def run(to: int, records: Iterator[tuple]) -> Iterator[tuple]:
        _, _, sums, others = _summed(tag, records)
        c = sums[0] if sums else np.zeros(0, np.int64)
        yield [data for what, _, data in others if what == "told"], int((c == SAMPLES).sum()), int((c == 2 * SAMPLES).sum()), int(c.sum())
    return run


def _got(keys: np.ndarray, deal: int, answers: dict[int, bytes]) -> list[np.ndarray]:
    """The sums of ``keys`` in their order."""
    block = (mix(keys) % np.uint64(deal)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    parts = [unpack(answers[to]) for to in sorted(answers)]
    out = []
    for cols in zip(*parts):
        col = np.empty(len(keys), np.int64)
        col[order] = np.concatenate(cols)
        out.append(col)
    return out


# ---- the model

class Shortlist:
    """Numbers of the training words: 0 is the unseen word, the last one the begin of a text."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.begin = len(hashes) + 1

    def code(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, at + 1, 0)

    def hash(self, code: np.ndarray) -> np.ndarray:
        return np.concatenate([[UNSEEN], self.sorted, [BEGIN]])[code]


class Model:
    """Tokens dealt out by cells, and what the rounds have summed over all cells."""

    #: The class of number 0 is the unseen word alone.
    known_discount, known_size, unseen = 0.0, 1.0, 1.0

    def __init__(self, words: DataFrame, sent: RDD, codes: Broadcast, distinct: int):
        self.words, self.tokens, self.codes, self.distinct = words, sent, codes, distinct
        self.deal = sent.getNumPartitions()
        self.discounts = (0.5, 0.5)
        self.roots: list[tuple[float, float, float]] = []
        self.all_u: list[dict] = []
        self.asked: dict[str, RDD] = {}
        self.answers: list[RDD] = []
        split = len(codes.value.often) > 0
        for turn in range(ROUNDS + 1):
            if split:
                self._sum(f"pairs{turn}", "pairs")
            told = self._sum(f"words{turn}", "words")
            mine = [x for others, *_ in told for x in others]
            if not turn:
                ones, twos, first, second = (sum(m[0][i] for m in mine) for i in range(4))
                self.discounts = discount(first, second), discount(ones, twos)
            all_u: dict[int, np.ndarray] = {}
            for _, us, sums in mine:
                for k, u in enumerate(us.tolist()):
                    all_u[u] = all_u.get(u, 0) + sums[:, k]
            self.all_u.append(all_u)
            once, twice, total = (sum(x[i] for x in told) for i in (1, 2, 3))
            d1, size = discount(once, twice), total / SAMPLES + STRENGTH
            self.roots.append((d1, size, (STRENGTH + d1 * distinct) / size))

    def _sum(self, tag: str, kind: str) -> list:
        """Have all cells' numbers summed by key, answered to them, and what they told besides."""
        asked = self._pass(tag).partitionBy(self.deal)
        first = self.asked.setdefault(kind, asked)
        here = asked if first is asked else asked.union(first)
        told = here.mapPartitionsWithIndex(_told(tag)).collect() if kind == "words" else []
        self.answers.append(here.mapPartitionsWithIndex(_answers(tag)).partitionBy(self.deal))
        return told

    def _pass(self, until: str, finish=None) -> RDD:
        """Train all cells as far as the sums go, then send what is to be summed, or ``finish`` them."""
        codes, deal, (d2, d3), all_u = self.codes, self.deal, self.discounts, list(self.all_u)
        roots = list(self.roots)

        def root(turn: int, cell: Cell) -> np.ndarray:
            d1, size, unseen = roots[turn]
            c = cell.word_sums[turn] / SAMPLES
            return np.where(c > 0, (c - d1) / size, unseen)

        def run(who: int, records: Iterator[tuple]) -> Iterator[tuple]:
            pieces: dict[str, list] = {"own": [], "split": [], "docs": []}
            sums: dict[tuple, dict[int, bytes]] = {}
            for _, record in records:
                if isinstance(record, bytes):
                    kind, number, data = pickle.loads(record)
                    pieces[kind].append((number, data))
                else:
                    sums.setdefault(record[:2], {})[record[2]] = record[3]
            cell = None
            for k in ("own", "split"):
                if pieces[k] and (k == "split" or not until.startswith("pairs")):
                    del cell
                    cell = Cell(pieces.pop(k), codes.value, k == "split")
                    last = int(until[-1])
                    start = max((turn for turn in range(1, last + 1) if (f"words{turn}", 2 + cell.split) in sums), default=0)
                    for turn in range(start, last + 1):
                        if turn > start:
                            cell.seat_triples(root(turn - 1, cell), all_u[turn - 1], d2, d3)
                        if cell.split and until == f"pairs{turn}":
                            own = [cell._tables(cell.p, len(cell.pairs), s).astype(np.int64) for s in range(SAMPLES)]
                            yield from _ask(until, 2 * who + 1, cell.pairs, [cell.own_fixed.astype(np.int64), *own], deal, turn > 0)
                            break
                        if cell.split:
                            fixed, *customers, first = _got(cell.pairs, deal, sums[f"pairs{turn}", 1])
                            cell.shared(not turn, fixed, customers, first)
                        if turn > start:
                            cell.seat_pairs(root(turn - 1, cell), d2)
                        elif start:
                            cell.resume(turn, sums[f"words{turn}", 2 + cell.split][0])
                        if until != f"words{turn}":
                            cell.word_sums[turn] = _got(cell.ws, deal, sums[f"words{turn}", int(cell.split)])[0]
                    if finish:
                        cell.known = _got(cell.ws, deal, sums["words0", int(cell.split)])[1]
                        yield from finish(cell, root(ROUNDS, cell))
                    elif until.startswith("words"):
                        columns = [cell.word_tables()] if last else [cell.word_tables(), cell.known]
                        yield from _ask(until, 2 * who + cell.split, cell.ws, columns, deal, last > 0)
                        if last:
                            yield who, (until, "state", 2 * who + cell.split, cell.state())
                        first = (cell.fixed + cell.customers[0]) * cell.first
                        yield 0, (until, "told", who, (tuple(int((a == k).sum()) for a in (cell.n, first) for k in (1, 2)),
                                                       cell.us if cell.split else cell.us[:0], cell.sums() if cell.split else None))
            if finish:
                for number, data in pieces["docs"]:
                    yield _at(number), ("docs", number, data)

        given = self.tokens
        for more in self.answers:
            given = given.union(more)
        return given.mapPartitionsWithIndex(run)

    @cached_property
    def short(self) -> Shortlist:
        """To look at small models; scoring doesn't number words."""
        return Shortlist(self.words.select("k").toArrow().column(0).to_numpy().view(np.uint64))

    def dish(self, code: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Average predictive probability of each dish in its context, for looking at small models."""
        h, u, t = (self.short.hash(x) for x in (code, one, two))
        context, pair = pair_key(t, u), pair_key(u, h)
        triple = triple_key(context, pair)
        asked = [np.unique(x) for x in (h, u, pair, context, triple)]
        (d2, d3), all_u = self.discounts, self.all_u[-1]

        def finish(x: Cell, root: np.ndarray) -> Iterator[tuple]:
            u_weight, u_size, pairs, c_weight, c_size, own = x.parts(all_u, d2, d3)
            for kind, (keys, cols) in enumerate([(x.ws, [root]), (x.us, [*u_weight, *u_size]), (x.pairs, [*pairs]),
                                                 (x.contexts, [*c_weight, c_size]), (x.triples, [own])]):
                for k in np.flatnonzero(np.isin(keys, asked[kind])).tolist():
                    yield (kind, int(keys[k])), [float(c[k]) for c in cols]

        got = dict(x for x in self._pass(f"score{ROUNDS}", finish).collect() if x[1][0] != "docs")
        look = lambda kind, keys, missing: np.array([got.get((kind, k), missing) for k in keys.tolist()], np.float32)
        upper, mid = look(1, u, [1.0] * 2 * SAMPLES), look(3, context, [1.0] * (SAMPLES + 1))
        p = look(2, pair, [0.0] * SAMPLES) / upper[:, SAMPLES:] + upper[:, :SAMPLES] * look(0, h, [self.roots[-1][2]]).astype(float)
        return (look(4, triple, [0.0]) / mid[:, SAMPLES:] + mid[:, :SAMPLES] * p).mean(1)


def _model(rows: DataFrame) -> tuple[DataFrame, int, int, Model | None]:
    """Word counts (k, n) of the training texts, their sum, their number, and the model with all texts (doc_id, text, held_out) dealt out."""
    words = _counted(rows.filter("not held_out").select("text"))
    stats = words.agg(F.sum("n").alias("N"), F.count("*").alias("V")).first()
    total, distinct = stats["N"] or 0, stats["V"]
    if not total:
        return words, 0, 0, None
    spark = rows.sparkSession
    top = words.orderBy(F.desc("n"), "k").limit(NUMBERED).toArrow()
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // CELL_TOKENS + 1)
    codes = spark.sparkContext.broadcast(Codes(top.column("k").to_numpy().view(np.uint64), top.column("n").to_numpy(), deal))
    floor = total + 0.1 * (distinct + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in _batches(batches, 1):
            got = list(_sent(codes.value, floor, part, number))
            for at in range(0, len(got), 64):
                yield pa.record_batch([pa.array([k for k, _ in got[at:at + 64]], pa.int64()),
                                       pa.array([v for _, v in got[at:at + 64]], pa.binary())], names=["k", "v"])
            number += 1

    sent = (rows.select("doc_id", "text", "held_out").mapInArrow(send, "k long, v binary").rdd
            .map(lambda r: (r[0], bytes(r[1]))).partitionBy(deal))
    return words, total, distinct, Model(words, sent, codes, distinct)


def train(texts: DataFrame) -> tuple[DataFrame, int, int, Model | None]:
    """Word counts (k, n), their sum, their number, and the model."""
    return _model(texts.select(F.lit(0).alias("doc_id"), F.coalesce(texts.columns[0], F.lit("")).alias("text"), F.lit(False).alias("held_out")))


def score(docs: DataFrame, folds: int = 10, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       (fold(F.col(id_col), folds) == held).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    words, total, distinct, model = _model(rows)
    if model is None:
        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = tokens(batch.column(2).to_pylist())[1].astype(np.int64) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n)], names=["doc_id", "held_out", "n_tokens"])

        return (rows.select("doc_id", "held_out", "text").mapInArrow(sizes, f"doc_id {kind}, held_out boolean, n_tokens long")
                .select("*", *[F.lit(0).cast("long").alias(c) for c in ("n_known", "train_tokens")],
                        *[F.lit(0.0).alias(c) for c in ("base_score", "score")]))
    (d2, d3), all_u, floor, deal = model.discounts, model.all_u[-1], total + 0.1 * (distinct + 1), model.deal

    def finish(x: Cell, root: np.ndarray) -> Iterator[tuple]:
        logs, known = x.logs(root, all_u, d2, d3), x.known[x.w][x.p]
        begin = 0
        for number, size in x.slices:
            at, docs = x.of_token[begin:begin + size], x.doc[begin:begin + size]
            rare = np.flatnonzero(x.rare[begin:begin + size])
            doc, to = np.unique(docs, return_inverse=True)
            few, to_few = np.unique(docs[rare], return_inverse=True)
            n = known[at[rare]]
            yield _at(number), ("sums", number, pack(
                _small(np.diff(doc, prepend=0)), np.rint(np.bincount(to, weights=logs[at]) * FIXED).astype(np.int64), _small(np.diff(few, prepend=0)),
                np.bincount(to_few, weights=np.log10((n + 0.1) / floor)), _small(np.bincount(to_few, weights=n > 0).astype(np.int64))))
            begin += size

    def whole(records: Iterator[tuple]) -> Iterator[tuple]:
        texts, sums = {}, {}
        for _, (what, number, data) in records:
            if what == "docs":
                texts[number] = data
            else:
                sums.setdefault(number, []).append(data)
        for number, (ids, held_out, sizes, base, some) in texts.items():
            own = np.zeros(len(ids))
            for data in sums.get(number, []):
                doc, logs, few, logs_few, known_few = unpack(data)
                own[np.cumsum(doc, dtype=np.int64)] += logs / FIXED
                few = np.cumsum(few, dtype=np.int64)
                base[few] += logs_few
                some[few] += known_few.astype(np.int64)
            yield from zip(ids, held_out, sizes.tolist(), some.tolist(), [total] * len(ids), base.tolist(), own.tolist())

    scored = model._pass(f"score{ROUNDS}", finish).partitionBy(deal).mapPartitions(whole)
    return docs.sparkSession.createDataFrame(scored, schema, verifySchema=False)

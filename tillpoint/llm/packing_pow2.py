"""Packing by power-of-two decomposition.

Every document's token sequence (its ids, then an end id) is cut into pieces
whose lengths are powers of two: as many full ``max_len`` pieces as fit, then
the binary digits of the rest, longest first. Each piece is a sequence of its
own in the bucket of its length, so no sequence crosses documents and no
position is padded; training draws batches from one bucket at a time.

The work is one pass: text -> ids -> pieces, without a shuffle. Sequence ids
come from the partition number and the row's place in it, so a task that runs
again on the same input gives the same ids.

Defined results: a null text counts as empty and gives one piece holding the
end id; repeated rows are packed once each; an empty table gives no pieces;
other columns of the input are ignored, whatever their names; a null doc_id
stays null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import space_chunks

MAX_LEN = 2048
END_ID = 1
#: Distinct text chunks whose ids a Python worker remembers; beyond it, it starts afresh.
CACHE_CHUNKS = 400_000

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class ChunkEncoder:
    """Ids of texts by a ``tokenizers`` file, as little-endian uint32 bytes.

    Texts are cut at single spaces, where the tokenizer's pre-tokens end
    anyway, so a chunk met before needs no second encoding. A text that holds an
    added token (a special mark written out) is encoded as a whole."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok = Tokenizer.from_file(path)
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        # chunks joined by a space could make a mark that has one
        self.chunks = not any(" " in t for t in added)
        alphabet = set(ByteLevel.alphabet())
        # bytes per id; chunks hold no added tokens
        self.width = np.zeros(self.tok.get_vocab_size(), np.int64)
        for token, i in self.tok.get_vocab().items():
            self.width[i] = len(token) if set(token) <= alphabet else len(token.encode())
        self.cache: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks in runs; the bytes of each id tell where a chunk ends."""
        for at in range(0, len(chunks), 20_000):
            part = chunks[at:at + 20_000]
            runs = [part[i:i + 200] for i in range(0, len(part), 200)]
            encoded = self.tok.encode_batch_fast(["".join(" " + c for c in r) for r in runs],
                                                 add_special_tokens=False)
            for run, e in zip(runs, encoded):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum(self.width[ids])
                want = np.cumsum([len(c.encode()) + 1 for c in run])
                cut = np.searchsorted(ends, want) + 1
                raw, prev = ids.tobytes(), 0
                for chunk, c in zip(run, (cut * 4).tolist()):
                    self.cache[chunk] = raw[prev:c]
                    prev = c

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [space_chunks(t) if self.chunks and not self.added.search(t) else None for t in texts]
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        new = set()
        for chunks in split:
            if chunks:
                new.update(chunks[1:])
        self._learn(sorted(new.difference(self.cache)))
        get = self.cache.__getitem__
        return [self._whole(t) if c is None else self._whole(c[0]) + b"".join(map(get, c[1:]))
                for t, c in zip(texts, split)]


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker, kept between its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32 bytes), doc_tokens."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                doc_ids = batch.column(0).to_pylist()
                rows: list[tuple] = []
                for doc_id, raw in zip(doc_ids, encoder.encode(batch.column(1).to_pylist())):
                    raw += end
                    n, start = len(raw) // 4, 0
                    for length in piece_lengths(n, max_len):
                        rows.append((doc_id, start, length, raw[4 * start:4 * (start + length)], n))
                        start += length
                if rows:
                    cols = list(zip(*rows))
                    yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                           pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()),
                                           pa.array(cols[4], pa.int64())],
                                          names=["doc_id", "start", "length", "ids", "doc_tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences: every piece with its bucket (log2 of the length), sequence_id and offset 0."""
    bucket = F.round(F.log2("length")).cast("int")
    return (pieces(docs, tokenizer_path, max_len, end_id, id_col, text_col)
            .withColumn("bucket", bucket)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per bucket of equal lengths."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def ids_crc32(ids) -> int:
    """crc32 of little-endian uint32 ids."""
    return zlib.crc32(ids)


def digest(packed: DataFrame) -> DataFrame:
    """The contract's row per piece; crc32 of the id bytes on the JVM side."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "bucket")

"""Line dedup by content-defined chunks, in DataFrame functions only.

A document's lines are hashed; a rolling hash over each line and the one before
it ends a chunk where it is 0 modulo DIVISOR. Boundaries depend on nearby lines
alone, so the same passage is cut alike wherever it stands, whatever was put
before it. Chunks of two lines or more that hold the same bytes anywhere in the
corpus are repeats: the first one, by doc_id and place, stays, the others go.

Equal digests only nominate: chunks are grouped by digest and bytes, and a
digest with different bytes under it removes nothing. Partial counts are made
where the rows are, so a chunk that stands in a third of all documents adds one
row per task to the shuffle.

Defined results: null text stays null with no lines; empty text has one empty
line; a chunk with fewer than two lines that hold a word is never removed; rows
that share a doc_id and a text count as one document and are treated alike;
documents with a null doc_id keep their text; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, materialise

DIVISOR = 3
FACTOR = 31


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_ends(lines: Column, divisor: int = DIVISOR) -> Column:
    """1-based numbers of the lines that end a chunk; the last line always does."""
    def ends(h):
        last = F.size(h)
        marked = F.transform(h, lambda x, i: F.when(
            (i + 1 == last) | ((x + FACTOR * F.coalesce(F.get(h, i - 1), F.lit(0))) % divisor == 0), i + 1))
        return F.filter(marked, lambda x: x.isNotNull())
    return let(F.transform(lines, line_hash), ends)


def chunks(lines: Column, divisor: int = DIVISOR, with_bytes: bool = False) -> Column:
    """Array of (first line, last line, digest), 1-based; the digest is the MD5 of the chunk's text, or
    null where the chunk can't be removed. ``with_bytes`` adds the text itself, where there is a digest."""
    def cut(lines, ends):
        def one(e, k):
            first = F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1
            part = F.slice(lines, first, e - first + 1)
            many = F.size(F.filter(part, lambda x: x.rlike(r"[^ \t-\r]"))) >= 2
            body = F.when(many, F.array_join(part, "\n"))
            return F.struct(first.alias("first"), e.alias("last"), F.md5(body).alias("digest"), *([body.alias("bytes")] * with_bytes))
        return F.transform(ends, one)
    return let(lines, lambda ls: let(chunk_ends(ls, divisor), lambda ends: cut(ls, ends)))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """doc_id, text_md5 and the numbers of the chunks that repeat an earlier one (``gone``)."""
    d = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null and _text is not null"))

    def each(with_bytes: bool) -> DataFrame:
        found = chunks(F.split("_text", "\n"), divisor, with_bytes)
        return (d.select("_id", F.md5("_text").alias("_md5"), F.posexplode(found).alias("_place", "_c"))
                .filter("_c.digest is not null"))

    place = F.struct("_id", "_place")
    same = (each(True).select(F.col("_c.digest").alias("_digest"), F.col("_c.bytes").alias("_bytes"), place.alias("_at"))
            .groupBy("_digest", "_bytes").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
            .groupBy("_digest").agg(F.count("*").alias("_kinds"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"))
            .filter("_kinds = 1 and _n > 1").select("_digest", "_first"))
    same = materialise(same, "repeated-chunks")
    return (each(False).select("_id", "_md5", "_place", F.col("_c.digest").alias("_digest"))
            .join(same, "_digest").filter(place != F.col("_first"))
            .groupBy("_id", "_md5").agg(F.collect_set("_place").alias("_gone")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """The documents with repeated chunks taken out of their text, and the counts lines, line_chunks,
    chunks_removed and lines_removed (they replace input columns of the same name)."""
    added = ["lines", "line_chunks", "chunks_removed", "lines_removed"]
    gone = repeats(docs, id_col, text_col, divisor)
    d = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_own"),
                    F.col(text_col).alias("_text"), F.md5(F.col(text_col)).alias("_own_md5"))
    d = d.join(gone, (F.col("_own") == F.col("_id")) & (F.col("_own_md5") == F.col("_md5")), "left")
    d = d.withColumn("_lines", F.split("_text", "\n")).withColumn("_chunks", chunks(F.col("_lines"), divisor))
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.filter(F.col("_chunks"), lambda c, i: ~F.array_contains(removed, i))
    lines = let(F.col("_lines"), lambda ls: F.flatten(F.transform(
        kept, lambda c: F.slice(ls, c["first"], c["last"] - c["first"] + 1))))
    new = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(lines, "\n"))
    removed_lines = F.aggregate(
        F.transform(removed, lambda i: F.get(F.col("_chunks"), i)["last"] - F.get(F.col("_chunks"), i)["first"] + 1),
        F.lit(0), lambda a, b: a + b)
    counts = [F.coalesce(F.greatest(F.size("_lines"), F.lit(0)), F.lit(0)), F.coalesce(F.greatest(F.size("_chunks"), F.lit(0)), F.lit(0)),
              F.size(removed), removed_lines]
    d = d.select("_row", new.alias("_new"), *[n.cast("long").alias(f"_new_{c}") for n, c in zip(counts, added)])
    # the input's columns last, out of reach of the names above
    return d.select(*[F.col("_new").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns if c not in added],
                    *[F.col(f"_new_{c}").alias(c) for c in added])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts and the MD5 of what is left."""
    return dedup(docs.select("doc_id", "text")).select(
        "doc_id", "lines", "line_chunks", "chunks_removed", "lines_removed",
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))

"""Prefix trie of conversations by whole-sequence collapse.

1. ``turns`` numbers each conversation's turns and reduces a turn to two 64-bit
   hashes, taken with its position, and the bytes of its text; ``rebuilt`` gives every
   conversation the opening of the first one of its block of five.
2. ``sequences``: the exclusive or of a sequence's turn hashes names the sequence.
   Identical conversations collapse into one weighted sequence with its end list,
   kept in pieces of END_PIECE ids. A hot group is pre-aggregated before it is
   shuffled and no list of ids is ever held whole.
3. ``trie``: only the smallest conversation of each sequence is unrolled into its
   prefixes, whose names are running exclusive ors. Sequences that are proper
   prefixes of others go by an anti-join; what is left are the leaves. Prefixes
   carry the weights, and one aggregation by prefix gives the nodes.

A node is owned by the sequence of its smallest member. The nodes that a sequence
owns are its deepest ones, from some depth on, so one number per sequence tells
which of its prefixes count once: sums over distinct nodes of a subtree become sums
over the sequences through it, and no pair of ancestor and descendant is made.

Long conversations are split: turns are numbered by ranges and running values are
made in blocks of BLOCK turns. Joins on a key that may be hot (a common parent, a long
conversation) have one row a key on the other side, and AQE splits them.

Sequences, and prefixes of the same depth, are taken as equal when 128 bits of hashes
are; there is no comparison of bytes.

Defined results: rows without conv_id take no part; a null role or text is empty; a
null turn comes first; ties in turn go by role, then text (its first 64 characters,
then an MD5 of both); repeated rows are turns of their own; a conversation that is left
without turns ends at the root; an empty table has no nodes, not even a root; the block
of a conversation is that of SQL's %, which rounds towards zero; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fold, materialise
from .numbering import numbered

SHARE = 5
OPENINGS = 9
BLOCK = 4096
END_PIECE = 1000


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), md5 (binary, of role and text) and bytes of the text, in order of turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)))
    t = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.substring(text, 1, 64).alias("head"), F.unhex(name).alias("md5"), F.octet_length(text).cast("long").alias("bytes"))
    out = numbered(t, ["conv_id"], [F.col("turn"), F.col("role"), F.col("head"), F.col("md5")], "turns")
    return materialise(out.select("conv_id", F.col("_n").alias("pos"), "md5", "bytes"), "numbered-turns")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id) and their rebuilt turns: the first h of the conversation at the start
    of its block of five, then its own after its first h; h is crc32(conv_id) % 9."""
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = materialise(convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % SHARE)
                        .withColumn("h", fold(F.col("conv_id"), OPENINGS)), "conversations")
    counts = convs.select(F.col("conv_id").alias("first_id"), F.col("n").alias("first_n"))
    plan = (convs.join(counts, "first_id", "left")
            .select("conv_id", "first_id", "h", F.least("h", F.coalesce("first_n", F.lit(0))).alias("taken")))
    opening = (own.filter(F.col("pos") < OPENINGS).withColumnRenamed("conv_id", "first_id")
               .join(plan.select("conv_id", "first_id", "h"), "first_id").filter("pos <= h"))
    rest = own.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos > h")
    rows = (opening.select("conv_id", "pos", "md5", "bytes")
            .union(rest.select("conv_id", F.col("pos") - F.col("h") + F.col("taken"), "md5", "bytes")))
    return convs.select("conv_id"), rows


def hashed(rows: DataFrame) -> DataFrame:
    """Rows of conv_id, pos, md5, bytes with two hashes of position and turn in place of the MD5."""
    def named(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("pos"), F.col("md5"))
    return rows.select("conv_id", "pos", named(1).alias("e1"), named(2).alias("e2"), "bytes")


def sequences(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences (length, x1, x2, conv_id: the smallest member, weight, all_bytes, ends_sha256), and their
    end lists in pieces (length, x1, x2, piece, ids joined by commas)."""
    totals = rows.groupBy("conv_id").agg(F.count("*").alias("length"), F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"),
                                         F.sum("bytes").alias("all_bytes"))
    totals = convs.join(totals, "conv_id", "left").na.fill(0, ["length", "x1", "x2", "all_bytes"])
    key = ["length", "x1", "x2"]
    piece = ((F.col("_n") - 1) / END_PIECE).cast("long")
    pieces = (numbered(totals, key, [F.col("conv_id")], "members").groupBy(*key, piece.alias("piece"))
              .agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("all_bytes").alias("all_bytes"),
                   F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")))
    pieces = materialise(pieces, "end-lists")
    seqs = pieces.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("weight"), F.min("all_bytes").alias("all_bytes"),
                                    F.count("*").alias("n_pieces"), F.max(F.sha2("ids", 256)).alias("only"))
    long_lists = (pieces.join(seqs.filter("n_pieces > 1").select(*key), key, "left_semi").select(*key, "piece", "ids")
                  .repartition(*key).sortWithinPartitions(*key, "piece")
                  .mapInPandas(_sha256_of_pieces, "length long, x1 long, x2 long, streamed string"))
    seqs = seqs.join(long_lists, key, "left").select(
        *key, "conv_id", "weight", "all_bytes", F.coalesce("streamed", "only").alias("ends_sha256"))
    return materialise(seqs, "sequences"), pieces.select(*key, "piece", "ids")


def _sha256_of_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a key: the digest of its pieces, in order, joined by commas. Holds one piece at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        for length, x1, x2, ids in zip(batch["length"], batch["x1"], batch["x2"], batch["ids"]):
            if (length, x1, x2) == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (length, x1, x2), hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["length", "x1", "x2", "streamed"])
    if key is not None:
        yield pd.DataFrame([(*key, state.hexdigest())], columns=["length", "x1", "x2", "streamed"])


def prefixes(seqs: DataFrame, rows: DataFrame) -> DataFrame:
    """Every prefix of every distinct sequence, under its smallest conversation: conv_id, depth, its name (x1, x2),
    its parent's (p1, p2), the bytes before its last text, and whether the sequence goes on."""
    r = rows.join(seqs.select("conv_id", "length"), "conv_id").withColumn("block", ((F.col("pos") - 1) / BLOCK).cast("long"))
    run = Window.partitionBy("conv_id", "block").orderBy("pos")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (r.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"), F.sum("bytes").alias("t"))
               .select("conv_id", "block", F.bit_xor("t1").over(earlier).alias("o1"), F.bit_xor("t2").over(earlier).alias("o2"),
                       F.sum("t").over(earlier).alias("o")).filter("block > 0"))
    r = (r.withColumn("x1", F.bit_xor("e1").over(run)).withColumn("x2", F.bit_xor("e2").over(run)).withColumn("sum", F.sum("bytes").over(run))
         .join(offsets, ["conv_id", "block"], "left").na.fill(0, ["o1", "o2", "o"])
         .withColumn("x1", F.col("x1").bitwiseXOR(F.col("o1"))).withColumn("x2", F.col("x2").bitwiseXOR(F.col("o2"))))
    below = r.select("conv_id", F.col("pos").alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"),
                     F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"), (F.col("sum") + F.col("o") - F.col("bytes")).alias("bytes_before"),
                     (F.col("pos") < F.col("length")).alias("goes_on"))
    zero = F.lit(0).cast("long")
    roots = seqs.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"),
                        zero.alias("bytes_before"), (F.col("length") > 0).alias("goes_on"))
    return materialise(below.union(roots), "prefixes")


def trie(seqs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per node: conv_id (its owner), depth, x1, x2 (its name), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    name = ["depth", "x1", "x2"]
    pre = prefixes(seqs, rows)
    # struct order: the smallest member's values
    found = pre.groupBy(*name).agg(F.min(F.struct("conv_id", "bytes_before", "p1", "p2")).alias("own"), F.max("goes_on").alias("inner"))
    found = materialise(found.select(*name, "own.*", "inner"), "nodes")
    inner = found.filter("inner").select(F.col("depth").alias("length"), "x1", "x2")
    leaves = seqs.join(inner, ["length", "x1", "x2"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    tops = (found.groupBy("conv_id").agg(F.min(F.struct("depth", "bytes_before", "p1", "p2")).alias("top"))
            .select("conv_id", F.col("top.depth").alias("top"), F.col("top.bytes_before").alias("top_bytes"), "top.p1", "top.p2"))
    tops = materialise(tops, "owners")
    info = (seqs.select("conv_id", "length", "weight", "all_bytes", "ends_sha256").join(leaves, "conv_id", "left")
            .join(tops.select("conv_id", "top", "top_bytes"), "conv_id", "left"))
    p = pre.select("conv_id", *name, "bytes_before").join(info, "conv_id")
    owned, opens = F.coalesce(F.col("top") <= F.col("depth"), F.lit(False)), F.coalesce(F.col("top") == F.col("depth") + 1, F.lit(False))
    once = F.when(owned, F.col("bytes_before")).otherwise(F.coalesce("top_bytes", "all_bytes"))
    child = opens | (owned & (F.col("length") > F.col("depth")))
    nodes = p.groupBy(*name).agg(
        F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("long")).alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("all_bytes") - F.col("bytes_before")) - (F.col("all_bytes") - once)).alias("saved_tokens"),
        F.max(F.when(F.col("length") == F.col("depth"), F.col("ends_sha256"))).alias("ends_sha256"))
    above = found.select((F.col("depth") + 1).alias("top"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above"))
    parents = tops.filter("top > 0").join(above, ["top", "p1", "p2"]).select("conv_id", "top", "above")
    parents = parents.withColumnRenamed("top", "depth")
    nodes = nodes.join(parents, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    return nodes.select("conv_id", "depth", "x1", "x2", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations."""
    convs, rows = rebuilt(turns(conversations))
    rows = materialise(hashed(rows), "rebuilt-turns")
    seqs, _ = sequences(convs, rows)
    return trie(seqs, rows)


def digest(nodes: DataFrame) -> DataFrame:
    """The contract's columns."""
    return nodes.drop("x1", "x2")

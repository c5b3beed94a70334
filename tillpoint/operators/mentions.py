"""Branch mentions in free text, and names looked up as codes.

``branch_keys`` is an index of how a branch can be named: the words of its name and of its code.
A text's windows of as many words as keys have are joined to it by equality, so the work
is one hash join whatever the number of branches, and no branch is named in code. Of
overlapping matches the one with most words stays ("united states" is not "united"), then the earlier.

Keys that several branches share go to an active branch before an inactive one, then to the smallest
code. Matching ignores case and punctuation: ``FT-PA1`` is found in "at ft pa1?".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import small
from ..functions.text import _c


def plain_words(text) -> Column:
    """Lower-case words: runs of letters and digits."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def branch_keys(branches: DataFrame) -> DataFrame:
    """One row per way to name a branch: key (its words), n_words, branch_code, is_active, shared (how many branches have it)."""
    each = branches.select("branch_code", "is_active", F.explode(F.array_distinct(F.array(
        F.array_join(plain_words("branch_name"), " "), F.array_join(plain_words("branch_code"), " ")))).alias("key")).filter("key <> ''")
    best = F.min(F.struct((-F.col("is_active")).alias("rank"), "branch_code", "is_active"))
    return each.groupBy("key").agg(best.alias("b"), F.count_distinct("branch_code").alias("shared")).select(
        "key", F.size(F.split("key", " ")).alias("n_words"), "b.branch_code", "b.is_active", "shared")


def branch_mentions(msgs: DataFrame, branches: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per mention that stands: ``keys``, text_key, position (word, from 0), n_words, branch_code, is_active, shared."""
    index = branch_keys(branches)
    # the lengths that keys have: one small array, the same for every text
    lengths = index.agg(F.array_sort(F.collect_set("n_words"))).scalar()
    m = msgs.select(*keys, F.xxhash64(text_col).alias("text_key"), plain_words(text_col).alias("_w")).filter(F.size("_w") > 0)
    m = m.withColumn("_lengths", F.coalesce(lengths, F.array().cast("array<int>")))
    windows = F.flatten(F.transform("_lengths", lambda n: F.transform(
        F.filter(F.transform("_w", lambda _, i: i), lambda i: i + n <= F.size("_w")),
        lambda i: F.struct(i.alias("position"), F.array_join(F.slice(F.col("_w"), i + 1, n), " ").alias("key")))))
    hits = m.select(*keys, "text_key", F.explode(windows).alias("_x")).select(*keys, "text_key", "_x.*").join(small(index), "key")
    # longest first: a hit goes when a longer one, or an earlier one of the same length, that stands covers one of its words
    found = hits.groupBy(*keys, "text_key").agg(F.array_sort(F.collect_set(F.struct(
        (-F.col("n_words")).alias("less"), "position", "n_words", "branch_code", "is_active", "shared"))).alias("_all"))
    empty = F.filter("_all", lambda _: F.lit(False))

    def take(got: Column, x: Column) -> Column:
        covered = F.exists(got, lambda g: (g["position"] < x["position"] + x["n_words"]) & (x["position"] < g["position"] + g["n_words"]))
        return F.when(covered, got).otherwise(F.concat(got, F.array(x)))
    return (found.select(*keys, "text_key", F.inline(F.aggregate("_all", empty, take))).drop("less"))


def message_branches(msgs: DataFrame, branches: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The messages with branch_codes (mentioned, in the order of the text), branch_code (the one an answer is
    about: the mention of an active branch with most words, else the first active branch by code) and by_default."""
    default = branches.filter("is_active = 1").agg(F.min("branch_code")).scalar()
    found = branch_mentions(msgs, branches, keys, text_col)
    per = found.groupBy(*keys, "text_key").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "branch_code"))), lambda s: s["branch_code"])).alias("branch_codes"),
        F.min(F.when(F.col("is_active") == 1, F.struct(-F.col("n_words"), "position", "branch_code"))).alias("_first"))
    m = msgs.withColumn("text_key", F.xxhash64(text_col))
    same = [m[k].eqNullSafe(per[k]) for k in keys] + [m["text_key"] == per["text_key"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    j = m.join(per, cond, "left")
    own = F.col("_first.branch_code")
    return j.select(*[m[c] for c in msgs.columns], F.coalesce("branch_codes", F.array().cast("array<string>")).alias("branch_codes"),
                    F.coalesce(own, default).alias("branch_code"), own.isNull().alias("by_default"))


def codes_by_name(branches: DataFrame) -> DataFrame:
    """branch_name → branch_code, one row a name: an active branch first, then the smallest code."""
    w = Window.partitionBy("branch_name").orderBy(F.desc("is_active"), "branch_code")
    return (branches.filter("branch_name is not null").select("branch_name", "branch_code", "is_active")
            .withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("branch_name", "branch_code"))


def with_branch_code(rows: DataFrame, branches: DataFrame, name_col: str, out_col: str = "branch_code") -> DataFrame:
    """``rows`` with the code of the branch named in ``name_col`` (exactly); null where there is none."""
    names = small(codes_by_name(branches).select(F.col("branch_name").alias("_name"), F.col("branch_code").alias("_code")))
    return rows.join(names, F.col(name_col) == F.col("_name"), "left").withColumn(out_col, F.col("_code")).drop("_name", "_code")

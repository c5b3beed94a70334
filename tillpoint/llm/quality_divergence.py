"""Quality rules by distribution divergence, in DataFrame functions only.

A document is compared with references of every sizeable language of the
corpus: one histogram over character classes, one over the language's common
words (all other words are one more bin). The measure is the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1). How far a text without any common word is from a
language depends on how much common words make up of it, so the word distance
is taken as a share of that. A document is kept when some language is near in
both. Texts of fewer words than a guard have
histograms too coarse to judge and pass the word comparison.

References are counted over all documents: a common word needs a letter and 1/100
of its language's words (so there are at most 100 a language). All documents are
compared with the languages of 1/100 of the corpus' words and more (at most 100);
these shares prove the size of what is broadcast, at any corpus size. Documents
of any other language are compared with their own language's reference too, which
they meet by a join. A language without any common word (no word breaks, flat
vocabulary) can't be judged by words: its own documents pass that comparison,
with word distance 0. Without any reference (an empty table, or no language
column filled) the comparison passes.

Defined results: null and empty texts have no words and fail the base rules;
repeated rows get one row each with equal figures; rows of one doc_id with
different texts are judged apart; null doc_ids are kept as null; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import let, materialise, words

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A word comparison needs so many words, a character comparison so many characters.
WORD_GUARD = 50
CHAR_GUARD = 200
MAX_CHAR_DISTANCE = 0.30
#: As a share of the distance of a text without any common word; short texts, whose shares are
#: noisy, are allowed WORD_NOISE / (number of words) more.
MAX_WORD_DISTANCE = 0.60
WORD_NOISE = 20.0
LANGUAGE_SHARE = 100
COMMON_SHARE = 100
#: Character classes, each counted on what the earlier ones left over.
CLASSES = [("lower", "[a-z]+"), ("space", r"[ \t-\r]+"), ("mark", r"[.,;:!?'\"()-]+"), ("upper", "[A-Z]+"),
           ("letter", r"[\p{L}\p{M}]+"), ("digit", r"\p{N}+"), ("rest", r"(?s).+")]


def repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array ``w``."""
    def windows(w):
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                           lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def starts(s):  # s: windows in order of their hash; equal ones are neighbours
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                         | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p):  # each start adds its window as far as the next one leaves it
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                           F.lit(0), lambda a, b: a + b)

    def count(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(let(ordered, starts), covered))

    return let(let(w, windows), count)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: key, base counts and the character-class histogram."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                    F.col(lang_col).cast("string").alias("lang"))
    d = d.withColumn("w", words(F.col("text"))).withColumn("left0", F.col("text"))
    for i, (_, pattern) in enumerate(CLASSES):
        d = d.withColumn(f"left{i + 1}", F.regexp_replace(f"left{i}", pattern, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return d.select(
        "doc_id", "lang", F.xxhash64("text").alias("text_hash"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("left1", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        F.char_length("text").cast("long").alias("n_chars"),
        *[(F.char_length(f"left{i}") - F.char_length(f"left{i + 1}")).cast("long").alias(f"c_{name}")
          for i, (name, _) in enumerate(CLASSES)])


def _bits(p: Column, q: Column) -> Column:
    """One bin's part of the divergence of p and q, in bits."""
    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    return (part(p, q) + part(q, p)) / 2


def _with_own(m: DataFrame, d: DataFrame, smaller: DataFrame, names: list[str]) -> DataFrame:
    """Adds the reference of a document's own language, if it is one of ``smaller``, and what the document has of its common words."""
    tokens = (d.join(smaller.select("lang", F.col("words").alias("lang_words")), "lang")
              .select("lang", "lang_words", "doc_id", F.xxhash64("text").alias("text_hash"), F.explode(words(F.lower("text"))).alias("word")))
    common = materialise(tokens.groupBy("lang", "word").agg(F.count("*").alias("count"), F.first("lang_words").alias("lang_words"))
                         .filter(F.col("word").rlike(r"\p{L}") & (F.col("count") * COMMON_SHARE >= F.col("lang_words")))
                         .select("lang", "word", (F.col("count") / F.col("lang_words")).alias("q")), "quality-own-common")
    text_key = ["lang", "doc_id", "text_hash"]
    hits = (tokens.groupBy(*text_key, "word").count()
            .withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy(*text_key)))
            .join(common, ["lang", "word"]).groupBy(*text_key)
            .agg(F.struct(F.sum(_bits(F.col("p"), F.col("q"))).alias("f"), F.sum("p").alias("p"), F.sum("q").alias("q")).alias("own_hits")))
    refs = smaller.join(common.groupBy("lang").agg(F.sum("q").alias("known")), "lang", "left").select(
        F.col("lang").alias("own_lang"),
        F.struct("lang", F.array(*[F.col(c) / F.col("chars") for c in names]).alias("shares"),
                 F.coalesce("known", F.lit(0.0)).alias("known")).alias("own"))
    hits = hits.select(F.col("lang").alias("o_lang"), F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), "own_hits")
    return (m.join(refs, m["lang"] == refs["own_lang"], "left")
            .join(hits, (F.col("lang") == F.col("o_lang")) & F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")), "left"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Counts, base rules, nearest language with both distances, and the verdict."""
    m = materialise(measures(docs, id_col, text_col, lang_col), "quality-measures")
    names = [f"c_{c}" for c, _ in CLASSES]

    # references of all documents: at most LANGUAGE_SHARE languages, a bounded read
    by_lang = materialise(m.filter("lang is not null").groupBy("lang")
               .agg(F.sum("n_words").alias("words"), F.sum("n_chars").alias("chars"),
                    *[F.sum(c).alias(c) for c in names]), "quality-languages")
    total = m.agg(F.sum("n_words").alias("all_words")).first()["all_words"] or 0
    langs = [r for r in by_lang.filter((F.col("words") * LANGUAGE_SHARE >= total) & (F.col("chars") > 0))
             .orderBy("lang").collect()] if total else []

    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                    F.col(lang_col).cast("string").alias("lang"))
    counts = (d.filter(F.col("lang").isin([r["lang"] for r in langs]))
              .select("lang", F.explode(words(F.lower("text"))).alias("word"))
              .groupBy("lang", "word").count())
    sizes = F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], float(r["words"]))]) if langs else None
    if langs:
        common = materialise(counts.filter(F.col("word").rlike(r"\p{L}")).filter(F.col("count") * COMMON_SHARE >= sizes[F.col("lang")])
                             .select("lang", "word", (F.col("count") / sizes[F.col("lang")]).alias("q")),
                             "quality-common")
        in_common = {r["lang"]: r["q"] for r in common.groupBy("lang").agg(F.sum("q").alias("q")).collect()}
        vocabulary = F.broadcast(common.select(F.col("word").alias("known_word")).distinct())
        text_key = [F.col("doc_id"), F.col("text_hash")]
        # only known words leave the texts; a text's words are counted already, once for every row that repeats it in full
        sizes_of = (m.groupBy("doc_id", "text_hash").agg((F.first("n_words") * F.count("*")).alias("all_words"))
                    .select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "all_words"))
        found = (d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(words(F.lower("text"))).alias("word"))
                 .join(vocabulary, F.col("word") == F.col("known_word")).groupBy(*text_key, "known_word").count())
        hits = (found.join(sizes_of, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")))
                .withColumn("p", F.col("count") / F.col("all_words"))
                .join(F.broadcast(common), F.col("known_word") == F.col("word"))
                .groupBy(*text_key, "lang")
                .agg(F.sum(_bits(F.col("p"), F.col("q"))).alias("f"), F.sum("p").alias("p"), F.sum("q").alias("q"))
                .groupBy(*text_key)
                .agg(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("f", "p", "q")))).alias("hits")))
        h = hits.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), "hits")
        m = m.join(h, m["doc_id"].eqNullSafe(h["h_id"]) & (m["text_hash"] == h["h_hash"]), "left")

    # the other languages, by joins: their number has no bound
    smaller = by_lang.filter(~F.col("lang").isin([r["lang"] for r in langs]) & (F.col("chars") > 0))
    if not smaller.isEmpty():
        m = _with_own(m, d, smaller, names)

    def against(r: Column, got: Column | None) -> Column:
        """Distances to one language's references (name, class shares, share of common words)."""
        parts = F.zip_with(F.array(*[F.col(c) / F.col("n_chars") for c in names]), r["shares"], _bits)
        char = F.aggregate(parts, F.lit(0.0), lambda x, y: x + y)
        got_f, got_p, got_q = (F.coalesce(got[x], F.lit(0.0)) for x in "fpq")
        word = (got_f + (r["known"] - got_q) / 2
                + _bits(F.greatest(1 - got_p, F.lit(0.0)), F.greatest(1 - r["known"], F.lit(0.0))))
        char = F.when(F.col("n_chars") > 0, F.sqrt(F.greatest(char, F.lit(0.0)))).otherwise(F.lit(1.0))
        none = r["known"] / 2 + _bits(F.lit(1.0), F.greatest(1 - r["known"], F.lit(0.0)))
        word = F.when((F.col("n_words") > 0) & (none > 0), F.sqrt(F.greatest(word, F.lit(0.0)) / none))
        word = word.when((F.col("n_words") > 0) & F.col("lang").eqNullSafe(r["lang"]), F.lit(0.0)).otherwise(F.lit(1.0))
        worst = F.greatest(char / max_char, word / (max_word + WORD_NOISE / F.greatest(F.col("n_words"), F.lit(1))))
        return F.struct(F.round(worst, 6).alias("worst"), F.round(char, 6).alias("char"), F.round(word, 6).alias("word"),
                        r["lang"].alias("lang"))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    m = m.withColumn("base_failed", failed)
    if langs:
        refs = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"),
                                  F.array(*[F.lit(r[c] / r["chars"]) for c in names]).alias("shares"),
                                  F.lit(float(in_common.get(r["lang"], 0.0))).alias("known")) for r in langs])
        m = m.withColumn("near", F.array_min(F.transform(refs, lambda r: against(r, F.col("hits")[r["lang"]]))))
    else:
        m = m.withColumn("near", F.lit(None).cast("struct<worst:double,char:double,word:double,lang:string>"))
    if "own_hits" in m.columns:
        m = m.withColumn("near", F.array_min(F.array("near", F.when(F.col("own").isNotNull(), against(F.col("own"), F.col("own_hits"))))))
    near = F.col("near")
    passes = (((F.col("n_chars") < CHAR_GUARD) | (near["char"] <= max_char))
              & ((F.col("n_words") < WORD_GUARD) | (near["word"] <= max_word + WORD_NOISE / F.col("n_words"))))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & F.coalesce(passes, F.lit(True))).alias("kept"),
                    near["lang"].alias("nearest_lang"), near["char"].alias("char_distance"),
                    near["word"].alias("word_distance"))

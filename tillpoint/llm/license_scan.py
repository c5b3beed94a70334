"""License detection by ordered signature rules, in DataFrame functions only.

The rules (``license_rules``) are regular expressions over lower-case words. They are gated twice
before any is run: a rule is looked up by the word it starts with, and its keyword must stand among the
words it can span. Only then is it matched, from that word on.

Detections of a document are swept from left to right. Where two overlap one stays: that of the better
class, then the longer one, so what lies inside a detection of its class or of a worse
one's better rival goes, then the earlier rule. What stays does not overlap. Labels are those of the
detections that stay and of the base phrases; the score is the confidence of the best of them.

Each row is scanned where it is read; nothing is shuffled and no detection leaves its row before
``detections`` is asked for.

Defined results: null and empty texts have no words, no labels and score 0; only A-Z are lower-cased;
rows are independent, so repeated rows and ids give a result each; a rule sees at most SPAN words from
its first one; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import let
from .license_rules import RULES, SPAN

#: Runs of anything but letters, digits and characters beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.7
#: Confidence by class.
SCORES = {1: 1.0, 2: 0.9, 3: 0.75, 4: 0.4}
LOOKUP = "map<string, array<struct<keyword: string, regex: string, cls: int, place: int, label: string>>>"


class Rule(NamedTuple):
    first: tuple[str, ...]
    keyword: str
    regex: str
    cls: int
    place: int
    label: str


def rules(text: str = RULES) -> list[Rule]:
    """The rules of a table. Every word of a pattern gets spaces of its own around it, so that a match
    starts and ends at words without looking around."""
    out = []
    for place, line in enumerate(text.strip().splitlines()):
        head, pattern = line.split(": ", 1)
        cls, keyword, label = head.split()
        choice = re.match(r"\(([a-z0-9|]+)\)(?=[ (]|$)", pattern)
        first = tuple(choice[1].split("|")) if choice else (re.match(r"[a-z0-9]+(?=[ (]|$)", pattern)[0],)
        spaced = pattern.replace(" ?", "( )?").replace(" ", "  ").replace("[^  ]", "[^ ]")
        out.append(Rule(first, keyword, f"^ {spaced} ", int(cls), place, label))
    return out


@lru_cache(maxsize=4)
def by_first(table: str) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in rules(table):
        for word in r.first:
            out.setdefault(word, []).append(r)
    return out


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAKS), "")


def _is_phrase(w: Column, i: Column, phrase: str) -> Column:
    out = F.lit(True)
    for k, word in enumerate(phrase.split()):
        out = out & (F.get(w, i + k) == word)
    return F.coalesce(out, F.lit(False))


def _found(w: Column, i: Column, lookup: Column) -> Column:
    """Detections that start at word ``i``: start, cls, less (minus the length), place, label, stop."""
    snippet = F.concat(F.lit(" "), F.array_join(F.slice(w, i + 1, SPAN), "  "), F.lit(" "))

    def match(s: Column) -> Column:
        gated = F.filter(F.element_at(lookup, F.get(w, i)), lambda r: F.contains(s, r["keyword"]))

        def one(r: Column) -> Column:
            hit = F.call_function("regexp_extract", s, r["regex"], F.lit(0))
            length = ((F.length(hit) - F.length(F.replace(hit, F.lit(" "), F.lit("")))) / 2).cast("int")
            return let(length, lambda n: F.struct(i.alias("start"), r["cls"].alias("cls"), (-n).alias("less"), r["place"].alias("place"),
                                                  r["label"].alias("label"), (i + n).alias("stop")))
        return F.filter(F.transform(gated, one), lambda x: x["less"] < 0)
    return let(snippet, match)


def _sweep(found: Column) -> Column:
    """The detections of a sorted list that stay, as (labels, best class)."""
    none = F.lit(9)
    fields = ["start", "cls", "less", "place", "label", "stop"]
    first = F.struct(F.lit(-1).alias("start"), none.alias("cls"), F.lit(0).alias("less"), F.lit(-1).alias("place"),
                     F.lit(None).cast("string").alias("label"), F.lit(-1).alias("stop"))
    init = F.struct(first.alias("now"), F.array().cast("array<string>").alias("labels"), none.alias("best"))

    def settled(a: Column) -> tuple[Column, Column]:
        now = a["now"]
        labels = F.when(now["label"].isNull(), a["labels"]).otherwise(F.array_union(a["labels"], F.array(now["label"])))
        return labels, F.least(a["best"], now["cls"])

    def step(a: Column, x: Column) -> Column:
        now = a["now"]
        apart = x["start"] >= now["stop"]
        order = [F.struct(v["cls"], v["less"], v["place"]) for v in (x, now)]
        taken = F.when(apart | (order[0] < order[1]), F.struct(*[x[f].alias(f) for f in fields])).otherwise(now)
        labels, best = settled(a)
        return F.struct(taken.alias("now"), F.when(apart, labels).otherwise(a["labels"]).alias("labels"),
                        F.when(apart, best).otherwise(a["best"]).alias("best"))

    def finish(a: Column) -> Column:
        labels, best = settled(a)
        return F.struct(labels.alias("labels"), best.alias("best"))
    return F.aggregate(found, init, step, finish)


def scan(text: Column, table: str = RULES) -> Column:
    """n_words, base (array of start, label), found (sorted detections) of a text."""
    firsts = by_first(table)
    # one literal, folded once; a rule a literal would make a plan of thousands of expressions
    listed = {word: [{"keyword": r.keyword, "regex": r.regex, "cls": r.cls, "place": r.place, "label": r.label} for r in rs]
              for word, rs in firsts.items()}
    lookup = F.from_json(F.lit(json.dumps(listed)), LOOKUP)
    starts = sorted(set(firsts) | {p.split()[0] for p in BASE})

    def read(w: Column) -> Column:
        n = F.size(w)
        anchors = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(w, i).isin(*starts))
                         ).otherwise(F.array().cast("array<int>"))

        def at(anchors: Column) -> Column:
            label = F.lit(None).cast("string")
            def base_label(i):
                out = label
                for phrase, name in BASE.items():
                    out = F.when(_is_phrase(w, i, phrase), name).otherwise(out)
                return out
            base = F.filter(F.transform(anchors, lambda i: F.struct(i.alias("start"), base_label(i).alias("label"))), lambda b: b["label"].isNotNull())
            ruled = F.filter(anchors, lambda i: F.get(w, i).isin(*firsts))
            found = F.array_sort(F.flatten(F.transform(ruled, lambda i: _found(w, i, lookup))))
            return F.struct(n.alias("n_words"), base.alias("base"), found.alias("found"))
        return let(anchors, at)
    return let(words(text), read)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: str = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    # inline keeps the scan from being planned once per column
    d = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(scan(F.col(text_col), table))))
    d = d.select("doc_id", "n_words", "base", F.inline(F.array(_sweep(F.col("found")))))
    places, own = F.transform("base", lambda b: b["start"]), F.array_distinct(F.transform("base", lambda b: b["label"]))
    d = d.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
                 F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
                 own.alias("own"), "labels", "best")
    score = F.lit(0.0)
    for cls, value in SCORES.items():
        score = F.when(F.col("best") == cls, value).otherwise(score)
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("own"), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union("own", "labels")), ",").alias("labels"),
                    F.greatest(score, F.when(F.size("own") > 0, BASE_SCORE).otherwise(0.0)).alias("score"))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: str = RULES) -> DataFrame:
    """One row per detection before the sweep: doc_id, start and stop (words), cls, label, rule (its place in the table)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(scan(F.col(text_col), table))))
    return d.select("doc_id", F.inline("found")).select("doc_id", "start", "stop", "cls", "label", F.col("place").alias("rule"))

"""Deterministic text routing over a message table (conv_id, turn, role, text).

Intent scoring, KPI routes, entity extraction and chart detection are plain
column expressions — one pass, no UDF — so they run over any number of
conversations. Keyword matching is substring containment on the lower-cased
text, as in the reference.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import scrub_chart_payload

# Intent profiles in priority order (name, keywords, style, depth).
INTENT_PROFILES = [
    ("trend_analysis", ["trend", "growth", "decline", "compare", "vs", "month", "year", "last", "202",
                        "performance over", "how has", "ramadhan", "puasa", "raya", "holiday"],
     "analytical_narrative", "deep"),
    ("promo_intelligence", ["promo", "promotion", "discount", "deal", "campaign", "b1f1", "buy one", "voucher",
                            "efficiency", "impact"], "warning_driven", "medium"),
    ("forecast", ["forecast", "predict", "next week", "next month", "expect", "ramalan", "will", "upcoming",
                  "projection"], "forward_looking", "deep"),
    ("inventory", ["ingredient", "stock", "inventory", "milk", "cup", "beans", "ice", "order", "supply", "demand",
                   "restock", "stok"], "operational", "medium"),
    ("staffing", ["staff", "worker", "shift", "schedule", "peak", "busy", "rush hour", "headcount", "manpower"],
     "operational", "medium"),
    ("quick_kpi", ["total revenue", "how much", "transaction", "daily average", "top branch", "peak hour",
                   "busiest"], "direct_answer", "shallow"),
    ("chart_request", ["chart", "graph", "plot", "visual", "visualize", "draw", "show me a chart"],
     "chart_with_insight", "medium"),
]
GENERAL = ("general", "conversational", "medium")

# Closing phrases, temporal words and the ordered KPI route patterns.
CLOSING_PHRASES = ["thank you", "terima kasih", "bye", "goodbye", "that's all", "nothing else"]
TEMPORAL_WORDS = ["last", "this", "month", "compare", "trend", "202"]
KPI_ROUTES = [
    ("total_revenue", r"\b(total revenue|how much did we make|all.?time revenue)\b", True),
    ("transactions", r"\b(total transactions|how many (tickets|orders|receipts)|transaction count)\b", True),
    ("daily_average", r"\b(daily average|average daily revenue|average.?per day)\b", False),
    ("top_branch", r"\b(top branch|best (branch|location)|highest revenue|busiest location)\b", False),
    ("peak_hour", r"\b(peak hour|busiest (hour|time)|rush hour|when.?busiest)\b", False),
]
# Chart words and the actual-vs-forecast chart phrases.
CHART_WORDS = ["chart", "graph", "plot", "visual", "visualize", "draw"]
FVA_PHRASES = ["actual vs", "predicted vs", "forecast vs", "sebenar vs ramalan", "ramalan vs sebenar",
               "graf jualan sebenar", "graf ramalan"]
# Patterns of campaign names, years, months and month counts in messages.
CAMPAIGN_PATTERNS = [r"campaign ([\w\s]+) last", r"discount for ([\w\s]+) last"]
YEAR_PATTERN = r"\b(20\d{2})\b"
MONTH_PATTERN = r"\b(20\d{2}-\d{2})\b"
MONTHS_BACK_PATTERN = r"last (\d+) month"
# Relative-day words (English and Malay).
TOMORROW_WORDS = ["esok", "tomorrow"]
TODAY_WORDS = ["today", "hari ini"]


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda k: F.contains(text, k))


def _hits(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda k: F.contains(text, k)))


def classify_intent(msgs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds primary intent, up to two secondary intents, style and depth.

    Score = number of profile keywords contained in the lower-cased text;
    ties keep profile order; no hit → general."""
    t = F.lower(F.col(text_col))
    scored = F.array(*[F.struct((-_hits(t, kws)).alias("neg"), F.lit(i).alias("ord"), F.lit(name).alias("name"))
                       for i, (name, kws, _, _) in enumerate(INTENT_PROFILES)])
    ranked = F.array_sort(F.filter(scored, lambda s: s["neg"] < 0))
    names = F.transform(ranked, lambda s: s["name"])
    style = F.create_map(*[x for n, _, s, _ in INTENT_PROFILES for x in (F.lit(n), F.lit(s))])
    depth = F.create_map(*[x for n, _, _, d in INTENT_PROFILES for x in (F.lit(n), F.lit(d))])
    primary = F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(GENERAL[0]))
    return (msgs.withColumn("primary_intent", primary)
            .withColumn("secondary_intents", F.slice(names, 2, 2))
            .withColumn("style", F.coalesce(F.try_element_at(style, F.col("primary_intent")), F.lit(GENERAL[1])))
            .withColumn("depth", F.coalesce(F.try_element_at(depth, F.col("primary_intent")), F.lit(GENERAL[2]))))


def is_closing(text: Column) -> Column:
    return _any(F.trim(F.lower(text)), CLOSING_PHRASES)


def kpi_route(msgs: DataFrame, text_col: str = "text") -> DataFrame:
    """Route code of the fast KPI answer: closing, one of the KPI routes in
    order (the first two are blocked by temporal words), else none."""
    t = F.trim(F.lower(F.col(text_col)))
    temporal = _any(t, TEMPORAL_WORDS)
    route = F.when(is_closing(F.col(text_col)), F.lit("closing"))
    for name, pattern, blocked in KPI_ROUTES:
        cond = t.rlike(pattern)
        if blocked:
            cond = cond & ~temporal
        route = route.when(cond, F.lit(name))
    return msgs.withColumn("kpi_route", route.otherwise(F.lit("none")))


def extract_entities(msgs: DataFrame, as_of: dt.date, text_col: str = "text") -> DataFrame:
    """Years, YYYY-MM months, 'last N month', campaign name, relative day."""
    t = F.lower(F.col(text_col))
    raw = F.col(text_col)
    campaign = F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in CAMPAIGN_PATTERNS])
    day = (F.when(_any(t, TOMORROW_WORDS), F.date_add(F.lit(as_of), 1))
           .when(_any(t, TODAY_WORDS), F.lit(as_of)))
    return msgs.select(
        *msgs.columns,
        F.regexp_extract_all(t, F.lit(YEAR_PATTERN), 1).alias("years"),
        F.nullif(F.regexp_extract(raw, MONTH_PATTERN, 1), F.lit("")).alias("target_month"),
        F.coalesce(F.nullif(F.regexp_extract(t, MONTHS_BACK_PATTERN, 1), F.lit("")).cast("int"), F.lit(3))
        .alias("chart_months"),
        campaign.alias("campaign"),
        day.alias("target_date"))


def chart_flags(msgs: DataFrame, text_col: str = "text") -> DataFrame:
    """Chart request and actual-vs-forecast chart detection."""
    t = F.lower(F.col(text_col))
    has = lambda w: F.contains(t, F.lit(w))
    fva = (_any(t, FVA_PHRASES) | (has("sebenar") & has("ramalan"))
           | (has("last") & (has("forecast") | has("predicted")))
           | (has("lepas") & (has("ramalan") | has("jualan"))))
    classified = classify_intent(msgs, text_col)
    wants_chart = (F.col("primary_intent") == "chart_request") | _any(t, CHART_WORDS)
    return classified.select(*msgs.columns, wants_chart.alias("chart_request"), (wants_chart & fva).alias("fva_chart"))


def last_turns(msgs: DataFrame, k: int, max_chars: int | None = None) -> DataFrame:
    """Last k turns per conversation, bot payload scrubbed and optionally
    truncated. One scan: each task keeps its k last rows of a conversation."""
    from ..functions.joins import top_k_per_key
    text = scrub_chart_payload(F.col("text"))
    if max_chars:
        text = F.substring(text, 1, max_chars)
    return top_k_per_key(msgs, ["conv_id"], "turn", k).select("conv_id", "turn", "role", text.alias("text"))

"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only the bag is labelled. Each sentence gets
a logistic score from its words and their stems (leading letters), and the document's score is their noisy-or:
1 minus the product of (1 - sentence score). Weights are trained on document
labels through that noisy-or, so the sentences that explain a label take the
credit, and in scoring the same sentence scores locate the offending ones.

The fit runs in one task over a bounded sample: the TRAIN_DOCS labelled rows of
least id hash (all, while there are no more), words and stems of at least
MIN_DOCS of them, at most VOCABULARY in all. Scoring is one pass over all rows with the
weights (bounded by VOCABULARY) in the task closure.

Defined results: null and empty texts count as one sentence without words;
without a training row, or with one label only, every score is that label's
share (0.0 without rows); several labels of one doc_id count as their maximum;
repeated rows are scored once each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import fold

TRAIN_DOCS = 6_000
MIN_DOCS = 5
VOCABULARY = 40_000
STEPS = 120
#: Step sizes fall from the first to the second.
RATE = (0.3, 0.02)
RIDGE = 1e-5
#: Each step also draws every weight towards 0 by this much, times the step size.
SHRINK = 0.1
FIRST_BIAS = -5.0
#: Sentences of a toxic document at or above this score are reported, and always the worst one.
LOCATE = 0.3

_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_SENTENCE = re.compile(r"[^.!?\n]+")
_ENDS = frozenset(".!?\n")
#: Lengths of stems; a stem is written with a trailing hyphen.
STEMS = (3, 4, 5)
#: Words whose weights a scoring task remembers.
CACHE_WORDS = 300_000
MODEL = "word string, weight double"


def word_features(word: str) -> list[str]:
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


class WordWeights(dict):
    """Weight of a word: the sum over its features, remembered; sentence ends are None."""

    def __init__(self, table: dict[str, float]):
        super().__init__(dict.fromkeys(_ENDS))
        self.table = table

    def __missing__(self, word: str) -> float:
        get = self.table.get
        value = sum(get(f, 0.0) for f in word_features(word))
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


def _sentences(lengths: list[int], end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of several documents, each closed by an end: which tokens are words, the sentence
    of each word, and the document of each sentence. Only sentences with words count, but a document
    without any has one."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    word = ~end
    opens = word & np.concatenate([[True], end[:-1]])
    lone = np.bincount(doc[opens], minlength=len(lengths)) == 0
    last = np.cumsum(lengths) - 1
    opens[last[lone]] = True  # stands for the missing sentence
    return word, (np.cumsum(opens) - 1)[word], doc[opens]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _combine(z: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Noisy-or of sentence logits: -log(1 - p) and p of each document."""
    miss = np.bincount(doc, weights=_softplus(z), minlength=n)
    return miss, -np.expm1(-miss)


def fit(texts: list[str], labels: np.ndarray) -> tuple[dict[str, float], float]:
    """Feature weights and bias by gradient steps (Adam) on the documents' log loss."""
    types: dict[str, int] = {}
    code, lengths = [], []
    df: Counter = Counter()
    for t in texts:
        tokens = _TOKEN.findall(t.lower())
        df.update({f for w in set(tokens) - _ENDS for f in word_features(w)})
        code += [-1 if x in _ENDS else types.setdefault(x, len(types)) for x in tokens]
        code.append(-1)
        lengths.append(len(tokens) + 1)
    least = min(MIN_DOCS, max(1, len(texts) // 10))
    chosen = sorted((f for f, n in df.items() if n >= least), key=lambda f: (-df[f], f))[:VOCABULARY]
    known = {f: i for i, f in enumerate(chosen)}
    # features of each word type, padded with the last, always zero weight
    none = len(chosen)
    feats = np.full((len(types), 1 + len(STEMS)), none)
    for w, i in types.items():
        for k, f in enumerate(word_features(w)):
            feats[i, k] = known.get(f, none)
    code = np.array(code, np.int32)
    word, sentence, doc = _sentences(lengths, code < 0)
    code = code[word]
    y, n = labels.astype(float), len(texts)
    w = np.zeros(none + 1)
    b, m, v = FIRST_BIAS, np.zeros(none + 2), np.zeros(none + 2)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence, weights=w[feats].sum(1)[code], minlength=len(doc))
        miss, p = _combine(z, doc, n)
        # d loss / d miss: 1 for label 0, -(1 - p) / p for label 1
        slope = np.where(y > 0, -np.exp(-miss) / np.maximum(p, 1e-9), 1.0)
        dz = slope[doc] / (1 + np.exp(np.clip(-z, None, 700))) / n
        by_type = np.bincount(code, weights=dz[sentence], minlength=len(types))
        grad = np.bincount(feats.ravel(), weights=np.repeat(by_type, feats.shape[1]), minlength=none + 1) + RIDGE * w
        grad[none] = 0.0
        grad = np.append(grad, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        rate = RATE[1] + (RATE[0] - RATE[1]) * (1 + np.cos(np.pi * step / STEPS)) / 2
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK * rate, 0.0)
    return {f: x for f, x in zip(chosen, w.tolist()) if x}, float(b)


def sentence_scores(texts: list[str], weight: WordWeights, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence scores, the document of each sentence, document scores."""
    values: list = []
    lengths = []
    for t in texts:
        before = len(values)
        values += [weight[x] for x in _TOKEN.findall(t.lower())]
        values.append(None)
        lengths.append(len(values) - before)
    value = np.array(values, float)  # None becomes nan
    word, sentence, doc = _sentences(lengths, np.isnan(value))
    z = bias + np.bincount(sentence, weights=value[word], minlength=len(doc))
    return 1 / (1 + np.exp(np.clip(-z, None, 700))), doc, _combine(z, doc, len(texts))[1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> list[tuple[str, float]]:
    """Weights by word; the word '' holds the bias, or a constant score under '='."""
    marks = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")))
    ids = docs.select(F.col(id_col).alias("_id")).distinct()
    sample = (marks.join(ids, "_id", "left_semi").withColumn("_order", F.xxhash64("_id"))
              .orderBy("_order", "_id").limit(train_docs))
    # at most train_docs rows of three numbers are broadcast; of a sampled id's rows one is kept, that of least text hash
    rows = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
            .join(F.broadcast(sample), "_id").groupBy("_id", "_order", "_label")
            .agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("_t")).select("_order", F.col("_t._text").alias("_text"), "_label"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            got += zip(*(batch.column(i).to_pylist() for i in range(3)))
        got.sort()
        labels = np.array([x[2] for x in got])
        if not got or labels.min() == labels.max():
            words, weights = ["="], [float(labels.mean()) if got else 0.0]
        else:
            table, b = fit([x[1] for x in got], labels)
            words, weights = [*table, ""], [*table.values(), b]
        yield pa.record_batch([pa.array(words), pa.array(weights, pa.float64())], names=["word", "weight"])

    return [(r["word"], r["weight"]) for r in rows.repartition(1).mapInArrow(learn, MODEL).collect()]


def _settings(model: list[tuple[str, float]]) -> tuple[dict[str, float], float, float | None]:
    """Weights by feature, bias, and the constant score of a model without weights."""
    table = dict(model)
    constant = table.pop("=", None if table else 0.0)
    return table, table.pop("", 0.0), constant


def reject(docs: DataFrame, model: list[tuple[str, float]], text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The documents scored below ``at``, with all their columns; the score is taken and used in one pass."""
    table, bias, constant = _settings(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = WordWeights(table)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                p = np.full(len(texts), constant) if constant is not None else sentence_scores(texts, weight, bias)[2]
                yield batch.filter(pa.array(p < at))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text",
          locate: float = LOCATE) -> DataFrame:
    """doc_id, score, predicted, sentences (with words), and the offending sentences of toxic
    documents: offending = array of (start, end, score), places in characters."""
    table, bias, constant = _settings(model)
    def spans(text: str, s: np.ndarray) -> list[dict]:
        """Character spans of a text's sentences that have words, with their scores."""
        out = []
        for m in _SENTENCE.finditer(text.lower() if len(text.lower()) == len(text) else text):
            if any(c not in _ENDS for c in _TOKEN.findall(m.group())):
                out.append((m.start(), m.end()))
        if len(out) != len(s):
            return []
        least = min(locate, float(s.max()))
        return [{"start": a, "end": e, "score": float(x)} for (a, e), x in zip(out, s) if x >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = WordWeights(table)
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = batch.column(1).to_pylist()
                n = len(texts)
                if constant is not None:
                    p, count, found = np.full(n, constant), np.zeros(n, np.int64), [[] for _ in texts]
                else:
                    s, doc, p = sentence_scores(texts, weight, bias)
                    at = np.searchsorted(doc, np.arange(n + 1))
                    count = np.diff(at)
                    found = [spans(texts[i], s[at[i]:at[i + 1]]) if p[i] >= 0.5 else [] for i in range(n)]
                yield pa.record_batch([
                    batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)),
                    pa.array(count, pa.int64()),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                    names=["doc_id", "score", "predicted", "sentences", "offending"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, score double, predicted int, sentences long, "
                                  "offending array<struct<start:int,end:int,score:double>>")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Train on labelled rows outside the held fold of the id's crc32, score all."""
    rows = docs.filter(fold(F.col("doc_id"), folds) != held)
    model = train(rows, labels)
    return (score(docs, model).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
            .select("doc_id", "held_out", "score", "predicted", "sentences", F.size("offending").alias("n_offending"),
                    F.get("offending", F.lit(0))["start"].alias("first_start"),
                    F.get("offending", F.lit(0))["end"].alias("first_end")))

"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One linear classifier per bit, over
hashed byte 2- and 3-grams (square roots of their shares), predicts that bit;
decoding weighs each bit's logistic loss by how well its classifier does for
the language in training, and takes the codeword of least loss. A text whose
best two codewords are close is flagged as ambiguous.

Up to EXHAUSTIVE languages use every distinct split into two sides as a bit;
more use random codewords far apart, from a fixed seed, whose length grows with
the logarithm of their number. Every language of the training rows is learned.
The fit runs in one task on a sample: TRAIN_DOCS rows in equal parts of all
languages, but up to LEAST_DOCS of each however many there are, by least id hash.
Scoring is one pass; the weights are (GRAMS + 1) x bits numbers.

Defined results: null texts and texts without a letter are 'und' with score
0.0; without training rows so is every text; a single learned language is
always predicted; repeated rows are scored once each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fold

GRAMS = 4096
TRAIN_DOCS = 6_000
#: Rows of each language, where TRAIN_DOCS rows in equal parts would be fewer.
LEAST_DOCS = 20
#: So many languages are given codewords the best of 200 draws; more languages fewer draws, for the same work.
MANY = 64
EXHAUSTIVE = 6
STEPS = 80
RATE = 0.5
RIDGE = 1e-5
SCALE = 10.0
#: Best and second loss closer than this share of the second: ambiguous.
CLOSE = 0.25


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1 bits, far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = np.arange(2 ** (n - 1) - 1)  # the first language is +1 in each; all-alike is left out
        return np.array([[1.0] * len(splits)] + [[1.0 if s >> k & 1 else -1.0 for s in splits] for k in range(n - 1)])
    bits, rng, best, far = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7), None, -1.0
    tries = 200 if n <= MANY else max(1, 200 * MANY ** 2 // n ** 2)
    while tries > 0 or far <= 0:
        tries -= 1
        code = rng.choice([-1.0, 1.0], (n, bits))
        least = np.inf
        for at in range(0, n, 256):  # some rows at a time
            apart = (bits - code[at:at + 256] @ code.T) / 2
            apart[np.arange(len(apart)), at + np.arange(len(apart))] = bits
            least = min(least, apart.min())
        if least > far:
            best, far = code, least
    return best


def _table() -> np.ndarray:
    """Bytes as the grams see them: letters and bytes of other scripts stay, the rest is a space."""
    t = np.full(256, 32, np.uint32)
    for b in range(256):
        c = bytes([b])
        if c.isalpha() or b >= 128:
            t[b] = ord(c.lower()) if b < 128 else b
    return t


_BYTES = _table()


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of gram shares."""
    b = _BYTES[np.frombuffer((" " + text + " ").encode(), np.uint8)]
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    grams = np.concatenate([(two * np.uint32(2654435761)) >> np.uint32(20), (three * np.uint32(2246822519)) >> np.uint32(20)])
    return np.sqrt(np.bincount(grams, minlength=GRAMS) / len(grams)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(texts: list[str], langs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, classifier weights (last row: biases) and the weight of each language's bits."""
    names = sorted(set(langs))
    code = codewords(len(names))
    number = {x: k for k, x in enumerate(names)}
    row = np.array([number[x] for x in langs])
    x = np.stack([features(t) for t in texts])
    target = code[row]
    w, bias = np.zeros((GRAMS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m = v = np.zeros((GRAMS + 1, code.shape[1]))
    for step in range(1, STEPS + 1):
        f = SCALE * (x @ w + bias)
        d = (-target / (1 + np.exp(np.clip(target * f, -30, 30)))).astype(np.float32) / len(x)
        grad = np.vstack([x.T @ d * SCALE + RIDGE * w, d.sum(0) * SCALE])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8) / 10
        w, bias = (w - move[:-1]).astype(np.float32), (bias - move[-1]).astype(np.float32)
    right = (target * (x @ w + bias) > 0)
    trust = np.array([right[row == k].mean(0) for k in range(len(names))]) + 1e-6
    return names, np.vstack([w, bias]), trust / trust.sum(1, keepdims=True)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """The model, or None without a row to learn from."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    languages = rows.select(lang_col).distinct().count()
    if not languages:
        return None
    each = max(min(LEAST_DOCS, train_docs), train_docs // languages)
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_order", "_id"))
    sample = (rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col)).alias("_order"))
              .distinct()
              .withColumn("_place", place).filter(F.col("_place") <= each).drop("_place"))
    picked = (rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
              .join(F.broadcast(sample), ["_id", "_lang"])  # train_docs rows, or LEAST_DOCS of each language
              # of a sampled id's rows one is kept, that of least text hash
              .groupBy("_id", "_order", "_lang").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("_t"))
              .select("_order", "_lang", F.col("_t._text").alias("_text")))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            got += [x for x in zip(*(batch.column(i).to_pylist() for i in range(3))) if has_letter(x[2])]
        if not got:
            return
        got.sort()
        names, w, trust = fit([x[2] for x in got], [x[1] for x in got])
        yield pa.record_batch([pa.array(names), pa.array([w.astype("<f4").tobytes()] + [b""] * (len(names) - 1), pa.binary()),
                               pa.array([t.astype("<f8").tobytes() for t in trust], pa.binary())],
                              names=["lang", "weights", "trust"])

    model = picked.repartition(1).mapInArrow(learn, "lang string, weights binary, trust binary").collect()
    if not model:
        return None
    return ([r["lang"] for r in model], np.frombuffer(model[0]["weights"], "<f4").reshape(GRAMS + 1, -1),
            np.stack([np.frombuffer(r["trust"], "<f8") for r in model]))


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    if model is not None:
        names, w, trust = model
        code = codewords(len(names))

    def one(text: str | None) -> tuple[str, float, bool]:
        if model is None or not has_letter(text):
            return "und", 0.0, False
        if len(names) == 1:
            return names[0], 1.0, False
        f = SCALE * (features(text) @ w[:-1] + w[-1])
        loss = (trust * np.logaddexp(0.0, -code * f)).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]) * code.shape[1])
        return names[order[0]], float(1 / share.sum()), bool(loss[order[1]] - loss[order[0]] < CLOSE * loss[order[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(t) for t in batch.column(1).to_pylist()]
            a, b, c = zip(*got) if got else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(a, pa.string()), pa.array(b, pa.float64()),
                                   pa.array(c, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def classify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learn outside the held fold of the id's crc32, predict all."""
    model = train(docs.filter(fold(F.col("doc_id"), folds) != held))
    return (predict(docs, model).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
            .select("doc_id", "held_out", "lang_pred", "score", "ambiguous"))

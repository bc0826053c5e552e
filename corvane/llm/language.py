"""Language identification (operator 9).

Texts become counts of hashed character n-grams (letters only, lower case, words padded by a blank). Document
frequencies over all training documents weigh them (TF-IDF, unit length); a sparse multinomial logistic regression is
trained with follow-the-regularised-leader, proximal form, with an elastic net; one temperature, fitted on part of the
sample that training doesn't see, calibrates the probabilities. The regression is trained on a bounded sample of about
PER_LANGUAGE documents a language, or of about SAMPLE in all where languages are many, and of one document of every
language at least. Everything else, the document frequencies and the predictions, covers every document and whole texts.
Training keeps weights only for dimensions that the sample has, and the model only those that the net leaves.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import bound_batches, free_name, hash60, hold

BITS, GRAMS = 15, (1, 2, 3)
DIMS = 1 << BITS
PER_LANGUAGE, SAMPLE = 700, 140_000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.2, 1e-4
#: Share of the sample that only fits the temperature.
CALIBRATION = 0.25
UND = "und"


@functools.cache
def _letters() -> np.ndarray:
    """1 for the code points that are letters."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Dimensions and their counts; None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # of a run of other characters only the last, as one blank
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    total = np.zeros(DIMS, np.int64)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in GRAMS:
            total += np.bincount(h * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """weights has a row for each dimension in which a language has a weight; row gives its place, -1 for none."""

    languages: list[str]
    idf: np.ndarray
    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        row = self.row[at]
        return x[row >= 0] @ self.weights[row[row >= 0]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.languages:
            return UND, 0.0
        p = softmax(self.logits(found[0], self.vector(*found)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Weights by coordinate, from the sums z and n, only made when asked for."""

    def __init__(self, rows: int, classes: int):
        self.z, self.n = np.zeros((rows, classes)), np.zeros((rows, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def step(self, at: np.ndarray, w: np.ndarray, gradient: np.ndarray) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def calibrate(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least log loss: loss is convex in its inverse, whose root Newton's steps inside a bracket find."""

    def slope(inverse: float) -> float:
        p = softmax(logits * inverse)
        return float(((p * logits).sum(1) - logits[np.arange(len(truth)), truth]).mean())

    lo, hi = 1e-6, 1e6
    if slope(hi) <= 0:  # no mistake: the loss falls for ever, and any temperature that keeps some doubt will do
        hi = 1.0
        while np.min(softmax(logits * hi).max(1)) < 0.999 and hi < 1e6:
            hi *= 1.1
        return 1 / hi
    if slope(lo) >= 0:
        return 1 / lo
    for _ in range(80):
        middle = float(np.sqrt(lo * hi))
        lo, hi = (middle, hi) if slope(middle) < 0 else (lo, middle)
    return float(1 / np.sqrt(lo * hi))


def fit(rows: list[tuple[str, bool, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """rows: language, whether for calibration, dimensions, counts; in an order of their own."""
    languages = sorted({r[0] for r in rows})
    row = np.full(DIMS, -1, np.int32)
    if not languages:
        return Model([], idf, row, np.zeros((0, 0), np.float32), np.zeros(0))
    used = np.unique(np.concatenate([r[2] for r in rows]))
    row[used] = np.arange(len(used))
    model = Model(languages, idf, row, np.zeros((len(used), len(languages))), np.zeros(len(languages)))
    label = {name: i for i, name in enumerate(languages)}
    data = [(label[name], held, at, model.vector(at, counts)) for name, held, at, counts in rows]
    seen = {y for y, held, _, _ in data if not held}
    train = [d for d in data if not d[1] or d[0] not in seen]  # a language with calibration rows only is learned from them
    ftrl, bias_at, rng = Ftrl(len(used) + 1, len(languages)), np.array([len(used)]), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            y, _, at, x = train[i]
            at = np.append(row[at], bias_at)
            x = np.append(x, 1.0)
            w = ftrl.weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            ftrl.step(at, w, x[:, None] * p)
    weights = ftrl.weights()
    left = np.flatnonzero(weights[:-1].any(1))
    model.row = np.full(DIMS, -1, np.int32)
    model.row[used[left]] = np.arange(len(left))
    model.weights, model.bias = weights[left].astype(np.float32), weights[-1]
    held = [d for d in data if d[1]] or data
    model.temperature = calibrate(np.array([model.logits(at, x) for _, _, at, x in held]), np.array([d[0] for d in held]))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is only predicted: crc32 of the id's text leaves 1 when divided by 3; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learnable: Column | None = None) -> Model:
    """A model of the learnable rows (by default those that held_out() leaves) with a language; every language is learned.

    Of a language with more rows than its part of the sample, rows are drawn by a hash of their id; that with the
    smallest hash always is. The sample and the weights are on the driver, as is a count for each language.
    """
    rows = bound_batches(df).where(F.col(lang_col).isNotNull() & (~held_out(id_col) if learnable is None else learnable))
    order = hash60("lang:", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sizes = rows.groupBy(F.col(lang_col).alias("size_lang")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).collect()
    if not sizes:
        return fit([], np.zeros(DIMS))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language", _letters.cache_clear)
        total, docs = np.zeros(DIMS + 1, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (found := features(text.as_py())) is not None:
                    total[found[0]] += 1
                    docs += 1
        total[DIMS] = docs
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["dim", "df"])

    df_rows = rows.select(text_col).mapInArrow(frequencies, "dim int, df long").groupBy("dim").agg(F.sum("df").alias("df")).collect()
    frequency = np.zeros(DIMS + 1)
    for r in df_rows:
        frequency[r.dim] = r.df
    idf = np.log((1 + frequency[DIMS]) / (1 + frequency[:DIMS])) + 1

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, order, found) for lang, order, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (found := features(text)) is not None]
            columns = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())]
            columns += [pa.array([o[2][k].astype(np.int32) for o in out], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "order", "dims", "counts"])

    each = min(float(PER_LANGUAGE), SAMPLE / len(sizes))
    bounds = [(r.size_lang, max(r.first, int(min(1.0, each / r.n) * (1 << 60)))) for r in sizes]
    bounds = F.broadcast(df.sparkSession.createDataFrame(bounds, "bound_lang string, bound long"))  # no more rows than were just collected
    picked = rows.select(F.col(lang_col).cast("string").alias("lang"), order.alias("order"), F.col(text_col).alias("text"))
    picked = picked.join(bounds, (F.col("lang") == F.col("bound_lang")) & (F.col("order") <= F.col("bound"))).select("lang", "order", "text")
    got = picked.mapInArrow(sampled, "lang string, order long, dims array<int>, counts array<int>").toArrow().sort_by([("order", "ascending"), ("lang", "ascending")])
    data = [
        (lang.as_py(), order.as_py() % 1000 < 1000 * CALIBRATION, dims.values.to_numpy(), counts.values.to_numpy())
        for lang, order, dims, counts in zip(*(got.column(c) for c in ("lang", "order", "dims", "counts")), strict=True)
    ]
    return fit(data, idf)


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score (with underscores in front where df has such columns).

    A text that is null or has no letter, or any text if nothing was learned, is "und" with score 0. Rows are judged
    one by one: repeated rows alike, ties between languages to the one first in alphabetical order.
    """
    pred, score = free_name(df, "lang_pred"), free_name(df, "score")
    texts_at, names = df.columns.index(text_col), [*df.columns, pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language", _letters.cache_clear)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(texts_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names)

    schema = T.StructType([*df.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return bound_batches(df).mapInArrow(run, schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row, by a model of the rows that held_out() leaves."""
    model = train(df, id_col, text_col, lang_col)
    return predict(df.select(id_col, text_col), model, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")

"""Operator 2: language identification.

Features: TF-IDF of character n-grams (1 to 3 letters, lower case, everything
that isn't a letter counts as a space, runs of spaces as one), hashed into a
fixed number of buckets. Model: multinomial logistic regression, trained with
follow-the-regularised-leader and elastic-net penalties; the first of them
leaves most weights of the buckets that occur at exactly zero. Its scores are then divided by a temperature that is fitted on
held-back training rows.

Document frequencies are counted over all training rows. The weights are
fitted on a bounded sample of them: about ``sample`` rows, as many of each
language, chosen by a hash of the id.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of, utf8_chunks

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    sample: int = 6000
    #: Languages that are learned: those with the most rows (ties by name).
    languages: int = 512
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.05
    seed: int = 17


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: whether it's a letter (any L category)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of the text's n-grams, ascending, and their counts; None if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a = np.where(letter, points, 32)[keep].astype(np.uint64)
    a = np.concatenate([[np.uint64(32)], a, [np.uint64(32)]])
    mask, p, q, r = np.uint64(buckets - 1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    two = a[:-1] * p + (a[1:] + np.uint64(1)) * q
    three = two[:-1] + (a[2:] + np.uint64(2)) * r
    one = a * r
    h = np.concatenate([one, two, three])
    h ^= h >> np.uint64(29)
    h *= p
    h = (h >> np.uint64(40)) & mask
    counts = np.bincount(h.astype(np.int64), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _frequency_batches(batches, buckets: int):
    """The number of texts with each bucket, summed over the partition."""
    total, rows = np.zeros(buckets, np.int64), 0
    for batch in batches:
        for a, b in utf8_chunks(batch.column(0)):
            for text in batch.column(0)[a:b].to_pylist():
                found = grams(text, buckets)
                if found is not None:
                    total[found[0]] += 1
                    rows += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1]]).astype(np.int32)), pa.array(np.concatenate([total[at], [rows]]))], names=["bucket", "n"])


def _vector(found, idf: np.ndarray) -> np.ndarray:
    at, n = found
    x = (1 + np.log(n)) * idf[at]
    return x / np.sqrt(x @ x)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader, per coordinate, for multinomial logistic loss."""

    def __init__(self, n: int, classes: int, s: Settings):
        self.z, self.n = np.zeros((n, classes)), np.zeros((n, classes))
        self.bias_z, self.bias_n = np.zeros(classes), np.zeros(classes)
        self.s = s

    def weights(self, z, n):
        s = self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def bias(self):
        return -self.bias_z / ((self.s.beta + np.sqrt(self.bias_n)) / self.s.alpha + self.s.l2)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        z, n = self.z[at], self.n[at]
        w = self.weights(z, n)
        bias = self.bias()
        g = _softmax(x @ w + bias)
        g[y] -= 1
        for zs, ns, ws, grad, put in ((z, n, w, np.outer(x, g), at), (self.bias_z, self.bias_n, bias, g, None)):
            new = ns + grad * grad
            step = grad - (np.sqrt(new) - np.sqrt(ns)) / self.s.alpha * ws
            if put is None:
                self.bias_z, self.bias_n = zs + step, new
            else:
                self.z[put], self.n[put] = zs + step, new


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        found = grams(text, len(self.idf))
        if found is None or not self.classes:
            return UNKNOWN, 0.0
        p = _softmax((_vector(found, self.idf) @ self.weights[found[0]] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def _train(at: np.ndarray, n: np.ndarray, start: np.ndarray, y: np.ndarray, classes: list[str], idf: np.ndarray, s: Settings) -> Model:
    """Fit on the sample's rows; a fifth of them is for the temperature.

    Row i has the buckets at[start[i]:start[i + 1]], their counts n and the
    class y[i]. All rows stand in one array, which goes back to the system as
    a whole: many small ones would stay with the driver's process.
    """
    order = np.random.default_rng(s.seed).permutation(len(y))
    held, rest = order[: len(y) // 5], order[len(y) // 5 :]
    x = np.log(n)
    x += 1
    x *= idf[at]
    if len(y):
        x /= np.repeat(np.sqrt(np.add.reduceat(x * x, start[:-1])), np.diff(start))
    row = lambda i: slice(start[i], start[i + 1])
    leader = Ftrl(len(idf), len(classes), s)
    for _ in range(s.epochs):
        for i in rest:
            leader.step(at[row(i)], x[row(i)], y[i])
    w, bias = leader.weights(leader.z, leader.n), leader.bias()
    scores = np.array([x[row(i)] @ w[at[row(i)]] + bias for i in held]).reshape(len(held), len(classes))
    return Model(classes, idf.astype(np.float32), w.astype(np.float32), bias.astype(np.float32), fit_temperature(scores, y[held]))


def is_training(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def train(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the rows with a language, a letter and an id whose crc32 isn't divisible by 5.

    The driver holds one count for each bucket and the sample's n-gram counts,
    both bounded by the settings. Rows of the sample with the same id count once,
    by the least hash of text and language, so a repeated row can't swell it.
    """
    s = settings or Settings()
    known = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.coalesce(is_training("id"), F.lit(False)))
    counts = dict(known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.languages).collect())
    classes = sorted(counts)
    if not classes:
        return Model([], np.zeros(s.buckets, np.float32), np.zeros((s.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0)
    frequency = known.select("text").mapInArrow(lambda it: _frequency_batches(it, s.buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = int(frequency.n[frequency.bucket == -1].sum())
    df_ = np.zeros(s.buckets)
    real = frequency[frequency.bucket >= 0]
    df_[real.bucket.to_numpy()] = real.n.to_numpy()
    idf = np.log((1 + total) / (1 + df_)) + 1
    share = s.sample / len(classes)
    wide = 1 << 40
    chosen = F.lit(False)
    for k, n in counts.items():
        chosen = chosen | ((F.col("lang") == k) & (F.pmod(F.xxhash64("id"), F.lit(wide)) < int(min(1.0, share / n) * wide)))

    def sampled(batches):
        for batch in batches:
            ids, texts, langs = (c.to_pylist() for c in batch.columns)
            found = [(i, g, classes.index(k)) for i, g, k in ((i, grams(t, s.buckets), k) for i, t, k in zip(ids, texts, langs, strict=True)) if g is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in found], batch.column(0).type), pa.array([g[0].astype(np.int32) for _, g, _ in found], pa.list_(pa.int32())), pa.array([g[1].astype(np.int32) for _, g, _ in found], pa.list_(pa.int32())), pa.array([k for *_, k in found], pa.int32())], names=["id", "at", "n", "y"])

    kind = known.schema["id"].dataType.simpleString()
    one = known.filter(chosen).groupBy("id").agg(F.min(F.struct(F.xxhash64("text", "lang").alias("hash"), "text", "lang")).alias("r"))
    rows = one.select("id", "r.text", "r.lang").mapInArrow(sampled, f"id {kind}, at array<int>, n array<int>, y int")
    sample = rows.orderBy(F.xxhash64("id"), "id").select("at", "n", "y").toArrow().combine_chunks()
    flat = [np.concatenate([np.empty(0, np.int32), *(c.flatten().to_numpy() for c in sample.column(k).chunks)]) for k in ("at", "n")]
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(sample.column("at")).to_numpy())]).astype(np.int64)
    y = sample.column("y").to_numpy().astype(np.int64)
    del sample
    pa.default_memory_pool().release_unused()
    return _train(*flat, start, y, classes, idf, s)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id column, lang_pred, score.

    A null text, or one without letters, gives ``und`` and 0; so does a model
    that saw no language. Equal scores go to the first language by name.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def batches(it):
        for batch in it:
            for a, b in utf8_chunks(batch.column(1)):
                found = [model.predict(t) for t in batch.column(1)[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(batches, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the table's training rows and predict every row. Columns: the id column, held_out, lang_pred, score.

    A null id isn't held out and never learned from. Repeated rows give
    repeated results; an empty table gives no rows. Only the named columns are
    read.
    """
    out = predict(df, train(df, settings, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, F.coalesce(~is_training(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, least: float, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is found with a score of ``least`` or more, with all their columns.

    The verdict is per row and rides along with it, so repeated ids are no problem.
    """
    model = train(df, settings, id_col, text_col, lang_col)

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series([0.0 if t is None else model.predict(t)[1] for t in text], dtype="float64")

    return df.filter(score(F.col(text_col).cast("string")) >= least)

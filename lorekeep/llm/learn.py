"""Small linear models on hashed words and text statistics, for the classifiers.

Features are computed in the tasks, many texts at a time; the driver sees feature rows of a bounded
sample of labelled documents, and sums, but no text. Every document is scored in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpointed, pieces
from .words import SPACED, Words, distinct, mix

#: Words are told apart by so many bits of their hash.
BITS = 20
_U = np.uint64
STATS = ("log_words", "upper", "digit", "symbol", "pipe", "other", "exclaim", "stop", "mean_word", "distinct", "log_lines")
_CLASS = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 6 if _b >= 0x80 else 1 if _c.isupper() else 2 if _c.isdigit() else 7 if _c == "!" else 4 if _c == "|" else 8 if _c in ".,;:'\"?-()" else 9 if _c == "\n" else 0 if _c.isspace() else 5 if _c.isalpha() else 3


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word bucket)."""
    return distinct(words.text_of(), (words.hash >> _U(64 - BITS)).astype(np.int64))


def text_stats(raws: list[bytes]) -> np.ndarray:
    """A row of STATS for each text."""
    words = Words(raws, SPACED)
    kind = _CLASS[words.blob]
    ends = words.text_start
    n_bytes = np.maximum(1, np.diff(ends) - 1).astype(float)

    def share(code: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind == code)))
        return np.diff(total[ends]) / n_bytes

    owner, _ = word_features(words)
    n = np.maximum(1, words.count).astype(float)
    length = np.concatenate(([0], np.cumsum(words.end - words.start)))
    mean_word = np.diff(length[words.first]) / n
    seen = np.bincount(owner, minlength=len(raws)) / n
    lines = share(9) * n_bytes
    return np.column_stack([np.log1p(words.count), share(1), share(2), share(3), share(4), share(6), share(7), share(8), mean_word / 10, seen, np.log1p(lines)])


@dataclass
class Linear:
    """A logistic model of standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 300, standardise: bool = True, weight: np.ndarray | None = None) -> Linear:
    """Logistic regression by accelerated gradient steps, rows weighted; one class alone gives a constant model."""
    n, k = x.shape
    root = np.sqrt(np.ones(n) if weight is None else weight)
    mean = x.mean(axis=0) if n and standardise else np.zeros(k)
    scale = x.std(axis=0) if n and standardise else np.ones(k)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rate = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return Linear(mean, scale, np.zeros(k), bias)
    z = np.column_stack([(x - mean) / scale, np.ones(n)])
    penalty = np.append(np.full(k, l2), 0.0)
    v = np.ones(z.shape[1]) / np.sqrt(z.shape[1])
    for _ in range(30):  # the largest curvature, by power steps
        v = z.T @ (root * root * (z @ v))
        v /= np.linalg.norm(v) or 1.0
    step = 1 / (0.25 * float(np.linalg.norm(z.T @ (root * root * (z @ v)))) + l2)
    w = np.append(np.zeros(k), bias)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        grad = z.T @ (root * root * (sigmoid(z @ ahead) - y)) + penalty * ahead
        new = ahead - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return Linear(mean, scale, w[:-1], float(w[-1]))


def folds(ids: np.ndarray, k: int) -> np.ndarray:
    """The fold of each row, by its id alone."""
    return (mix(ids.astype(np.int64).view(np.uint64) + _U(17)) % _U(k)).astype(np.int64)


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, more: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, **how) -> np.ndarray:
    """For each row, the prediction of a model fitted without the row's fold; more: (x, y, weight) rows that every model sees."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        inside = fold == f
        x_in, y_in, w = x[~inside], y[~inside], np.ones(int((~inside).sum()))
        if more is not None and len(more[1]):
            x_in, y_in, w = np.vstack([x_in, more[0]]), np.append(y_in, more[1]), np.append(w, more[2])
        out[inside] = fit(x_in, y_in, weight=w, **how).predict(x[inside])
    return out


_WORDS = pa.schema([("doc_id", pa.int64()), ("label", pa.float64()), ("buckets", pa.list_(pa.int64()))])


def labelled_ids(labels: DataFrame, column: str, most: int) -> DataFrame:
    """(of_id, label) of at most so many labelled ids, the least by hash; several labels of an id count once, the largest."""
    ids = labels.select(F.col("doc_id").cast("long").alias("of_id"), F.col(column).cast("int").alias("label")).dropna().groupBy("of_id").agg(F.max("label").alias("label"))
    return ids.orderBy(F.xxhash64("of_id"), "of_id").limit(most)


def sample_words(docs: DataFrame, ids: DataFrame, kind: np.ndarray) -> DataFrame:
    """(doc_id, label, buckets): the distinct words of the documents of ids (of_id, label), whose number is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raws in pieces(batch):
                owner, bucket = word_features(Words(raws, kind))
                edge = np.searchsorted(owner, np.arange(len(raws) + 1))
                rows = batch.slice(first, len(raws))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(bucket))], schema=_WORDS)

    known = docs.join(F.broadcast(ids), docs["doc_id"] == ids["of_id"]).select("doc_id", "text", F.col("label").cast("double").alias("label"))
    return checkpointed(known.mapInArrow(run, "doc_id long, label double, buckets array<long>"), F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col("label") > 0).cast("int")), F.lit(0.0)).alias("rate"))


def choose(words: DataFrame, most: int, least_texts: int = 3, least_score: float = 4.0) -> np.ndarray:
    """The buckets of sample_words() whose rate differs most between the classes, by least_score standard deviations at least; sorted."""
    rate = float(words.seen["rate"])
    held, hits = F.count(F.lit(1)), F.sum((F.col("label") > 0).cast("int"))
    counts = words.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(held.alias("held"), hits.alias("hits")).filter(F.col("held") >= least_texts)
    score = F.abs(F.col("hits") - F.col("held") * rate) / F.sqrt(F.greatest(F.col("held") * rate * (1 - rate), F.lit(1e-9)))
    best = counts.select("bucket", score.alias("score")).filter(F.col("score") >= least_score).orderBy(F.desc("score"), "bucket").limit(most)
    return np.sort(np.array([r["bucket"] for r in best.collect()], dtype=np.int64))


def sample_presence(words: DataFrame, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, label 0/1, presence of the chosen words) of a sample, in the order of ids."""
    rows = words.select("doc_id", "label", F.array_intersect("buckets", F.array(*[F.lit(int(c)) for c in columns]).cast("array<long>")).alias("b")).orderBy("doc_id", "label").collect()
    owner = np.repeat(np.arange(len(rows)), [len(r["b"]) for r in rows]).astype(np.int64)
    bucket = np.array([b for r in rows for b in r["b"]], dtype=np.int64)
    return np.array([r["doc_id"] for r in rows], dtype=np.int64), np.array([float(r["label"] > 0) for r in rows]), presence(owner, bucket, len(rows), columns)


def presence(owner: np.ndarray, bucket: np.ndarray, n_texts: int, columns: np.ndarray) -> np.ndarray:
    """A 0/1 row for each text over the chosen buckets."""
    out = np.zeros((n_texts, len(columns)))
    if len(columns) and len(bucket):
        at = np.minimum(np.searchsorted(columns, bucket), len(columns) - 1)
        good = columns[at] == bucket
        out[owner[good], at[good]] = 1.0
    return out

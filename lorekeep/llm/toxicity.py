"""Toxicity by a classifier chain.

Method. The categories are predicted in order (three kinds of toxic text, then toxic at all); each
linear model sees the presence of chosen words and the earlier categories' probabilities. A later
model is trained on out-of-fold probabilities of the earlier ones, so it meets them as they are for
new documents. Only `toxic` is labelled by hand. The kinds are learnt: the words that mark toxic
rows of the sample are clustered by the rows they stand in, and a toxic row with a word of a cluster
is of its kind.

The models are fitted on SAMPLE labelled rows at most (the least by a hash of doc_id), of which the
driver sees chosen words alone; every document is scored on its whole text. Defined results: null or
wordless text has probability 0 and isn't toxic; with no labels or one class alone every probability
is the base rate and nothing is called toxic; a doc_id with several labels counts once, with the
largest; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import learn
from .base import pieces, texts
from .words import ALNUM, Words

SAMPLE = 4000
WORDS = 256
FOLDS = 5
KINDS = 3
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")


@dataclass
class Chain:
    columns: np.ndarray
    models: list[learn.Linear]
    threshold: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        found: list[np.ndarray] = []
        for model in self.models:
            found.append(model.predict(np.column_stack([x, *found])))
        return np.column_stack(found)


def kinds(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The cluster of each column of x that marks toxic rows, or -1: by k-means of the columns' directions over the toxic rows."""
    out = np.full(x.shape[1], -1)
    bad = x[toxic > 0]
    if not len(bad) or not len(toxic) - len(bad):
        return out
    marks = np.flatnonzero(bad.mean(axis=0) > x[toxic == 0].mean(axis=0))
    rows = bad[:, marks].T / np.maximum(1e-9, np.linalg.norm(bad[:, marks], axis=0))[:, None]
    if not len(marks):
        return out
    centre = [int(rows.sum(axis=1).argmax())]
    for _ in range(min(KINDS, len(marks)) - 1):  # each further centre is the column least like those before
        centre.append(int((rows @ rows[centre].T).max(axis=1).argmin()))
    centres = rows[centre]
    for _ in range(20):
        own = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        centres /= np.maximum(1e-9, np.linalg.norm(centres, axis=1))[:, None]
    out[marks] = own
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of best F-score with precision at double weight, as clean text should rather be left alone; in the middle of the gap it lies in."""
    cuts = np.unique(np.round(p, 6))
    if len(cuts) < 2 or y.min() == y.max():
        return 0.5
    middle = (cuts[1:] + cuts[:-1]) / 2
    if len(middle) > 400:
        middle = middle[np.linspace(0, len(middle) - 1, 400).astype(int)]
    score = [1.25 * (y * (p >= c)).sum() / max(1.0, 0.25 * y.sum() + (p >= c).sum()) for c in middle]
    top = np.flatnonzero(np.isclose(score, max(score)))
    return float(np.clip(middle[top[len(top) // 2]], 0.05, 0.95))


def train(columns: np.ndarray, ids: np.ndarray, x: np.ndarray, toxic: np.ndarray) -> Chain:
    """The chain of a sample's chosen words (presence x) and labels."""
    of = kinds(x, toxic)
    y = np.column_stack([*(toxic * (x[:, of == k].sum(axis=1) > 0) for k in range(KINDS)), toxic]).astype(float)
    fold = learn.folds(ids, FOLDS)
    models, earlier = [], []
    for k in range(len(CATEGORIES)):
        seen = np.column_stack([x, *earlier])
        models.append(learn.fit(seen, y[:, k], standardise=False))
        earlier.append(learn.out_of_fold(seen, y[:, k], fold, standardise=False))
    return Chain(columns, models, best_threshold(earlier[-1], toxic) if 0 < toxic.sum() < len(toxic) else 2.0)


_OUT = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in CATEGORIES), ("toxic", pa.bool_())])


def score(documents: DataFrame, chain: Chain) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, raws in pieces(batch):
                words = Words(raws, ALNUM)
                p = model.predict(learn.presence(*learn.word_features(words), len(raws), model.columns))
                p[words.count == 0] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(raws)], *map(pa.array, np.ascontiguousarray(p.T)), pa.array(p[:, -1] >= model.threshold)], schema=_OUT)

    return texts(documents).mapInArrow(run, ", ".join(["doc_id long", *(f"p_{c} double" for c in CATEGORIES), "toxic boolean"]))


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_kind_1.., p_toxic, toxic) of every document."""
    words = learn.sample_words(texts(documents), learn.labelled_ids(labels, "toxic", sample), ALNUM)
    columns = learn.choose(words, WORDS)
    ids, toxic, x = learn.sample_presence(words, columns)
    return score(documents, train(columns, ids, x, toxic))

"""Quality classifier by co-training of a text view and a metadata view.

Method. One linear model sees the text (statistics and the presence of chosen words), the other
the page's metadata (language, source, length). Both start from the labelled rows. Over ROUNDS
rounds each scores every unlabelled document, and the documents that it is confident of join the
other's training set, with the weight of the labelled rows at most: each of at most STEPS steps of a
round adds up loss, gradient and curvature over all of them in the tasks. A model for each fold of the
labelled rows is co-trained beside, from the rows outside it alone; on their predictions for the
fold left out the views' log-odds are calibrated singly, and then combined into one score.

Texts are read once for the features, which all rounds share. The labelled rows are a sample of
SAMPLE at most (the least by a hash of doc_id). A document is rejected below a cut that is set so
that REJECT_AT_MOST of the good labelled rows fall below it out of fold, and never above one half: a
filter should rather let junk pass than lose clean text. Defined results: null or wordless text
scores 0 and is rejected; without labels, or with one class alone, the score is the base rate and
nothing that has words is rejected; several labels of a doc_id count once, the largest; rows without
a doc_id are scored, and teach nothing; repeated rows give repeated rows; keep_good judges each row
by what it holds, so rows of one doc_id, or of none, stay or go by themselves; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import learn
from .base import checkpointed, discard, pieces
from .words import SPACED, Words

SAMPLE = 4000
WORDS = 128
META_BITS = 8
ROUNDS = 3
STEPS = 6
#: A student rests for the round once its loss moves by no more than this share of it.
SETTLED = 1e-6
LEAST_CURVE = 0.02
SALTS = 16
CONFIDENT = 0.97
FOLDS = 5
REJECT_AT_MOST = 0.005


_KINDS = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _own(documents: DataFrame) -> dict[str, Column]:
    """The columns that a verdict follows from; missing ones are null."""
    own = {c: (documents[c] if c in documents.columns else F.lit(None)).cast(t) for c, t in _KINDS.items()}
    return own | {"text": F.coalesce(own["text"], F.lit(""))}


def meta_columns(documents: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars, whatever else the table holds, and held: a hash of what a verdict follows from."""
    own = _own(documents)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in own.items()], F.xxhash64(*own.values()).alias("held"))


_FEATURES = pa.schema([("doc_id", pa.int64()), ("worded", pa.bool_()), ("x", pa.binary()), ("lang", pa.int32()), ("source", pa.int32()), ("size", pa.float64()), ("held", pa.int64())])
_FEATURES_SQL = "doc_id long, worded boolean, x binary, lang int, source int, size double, held long"


def _buckets(values: list, tag: str) -> np.ndarray:
    """A bucket of META_BITS for each value, nulls in one of their own."""
    seen: dict = {}
    for v in values:
        if v not in seen:
            seen[v] = int.from_bytes(hashlib.blake2b(f"{tag}{v!r}".encode("utf-8", "surrogatepass"), digest_size=2).digest(), "little") >> (16 - META_BITS)
    return np.array([seen[v] for v in values], dtype=np.int32)


def features(documents: DataFrame, columns: np.ndarray) -> DataFrame:
    """Both views' features of every document, as a table: the only pass over the texts of all."""
    sent = documents.sparkSession.sparkContext.broadcast(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raws in pieces(batch):
                rows = batch.slice(first, len(raws))
                x = np.column_stack([learn.text_stats(raws), learn.presence(*learn.word_features(Words(raws, SPACED)), len(raws), sent.value)]).astype(np.float32)
                size = np.log1p(np.array([max(0, v or 0) for v in rows.column(4).to_pylist()], dtype=float)) / 10
                lang, source = (_buckets(rows.column(i).to_pylist(), t) for i, t in ((2, "l"), (3, "s")))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([bool(r.strip()) for r in raws]), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(lang), pa.array(source), pa.array(size), rows.column(5)], schema=_FEATURES)

    return checkpointed(meta_columns(documents).mapInArrow(run, _FEATURES_SQL))


def views(batch: pa.RecordBatch, width: int = 0) -> dict[str, np.ndarray]:
    """The text and meta matrices of feature rows; width: that of the text's, which no rows can't tell."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(n, -1).astype(np.float64) if n else np.zeros((0, width))
    meta = np.zeros((n, (2 << META_BITS) + 1))
    meta[np.arange(n), np.asarray(batch.column(3))] = 1.0
    meta[np.arange(n), np.asarray(batch.column(4)) + (1 << META_BITS)] = 1.0
    meta[:, -1] = np.asarray(batch.column(5))
    return {"text": x, "meta": meta}


@dataclass
class CoModel:
    view: dict[str, learn.Linear]
    single: dict[str, learn.Linear]
    both: learn.Linear
    threshold: float

    def calibrated(self, logits: dict[str, np.ndarray]) -> np.ndarray:
        return np.column_stack([self.single[v].logit(np.clip(logits[v], -13.8, 13.8)[:, None]) for v in ("text", "meta")])


class Student:
    """A view's model of one version, in the standardised columns of its own labelled rows, while it is taught.

    It minimises the logistic loss of its labelled rows, that of the documents which the other view's model is sure
    of, weighted to count no more than the labelled rows, and half the square of its weights.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray):
        self.x, self.rows, self.y = x, rows, y[rows]  # the matrix is one for all versions
        self.model = learn.fit(x[rows], self.y)
        self.learns = bool(len(self.y)) and self.y.min() < self.y.max()
        self.w = np.append(self.model.weight, self.model.bias)
        self.best: tuple[float, np.ndarray, np.ndarray] | None = None  # loss, weights, step
        self.stride, self.done = 1.0, False

    def raw(self, w: np.ndarray) -> np.ndarray:
        """Weights and intercept for columns as they are."""
        own = w[:-1] / self.model.scale
        return np.append(own, w[-1] - own @ self.model.mean)

    def restart(self) -> None:
        self.best, self.stride, self.done = None, 1.0, not self.learns

    def told(self, sums: np.ndarray) -> None:
        """Take the sums over the sure documents at the weights w (`Sums`), and set w to the next weights to try."""
        k = len(self.w) - 1
        n, loss, residual, curve = sums[:4]
        xr, xd, xxd = sums[4 : 4 + k], sums[4 + k : 4 + 2 * k], sums[4 + 2 * k :]
        mean, scale = self.model.mean, self.model.scale
        weight = min(1.0, len(self.y) / n) if n else 0.0
        gradient = np.append((xr - mean * residual) / scale, residual) * weight
        diagonal = np.append((xxd - 2 * mean * xd + mean * mean * curve) / scale**2, curve) * weight
        z = np.column_stack([(self.x[self.rows] - mean) / scale, np.ones(len(self.y))])
        logit = z @ self.w
        p = learn.sigmoid(logit)
        ridge = np.append(self.w[:-1], 0.0)
        total = weight * loss + float(np.logaddexp(0, logit).sum() - self.y @ logit) + 0.5 * float(ridge @ ridge)
        before = None if self.best is None else self.best[0]
        self.done = before is not None and abs(total - before) <= SETTLED * max(1.0, abs(before))
        if before is not None and total > before + 1e-9 * abs(before):
            self.stride /= 2  # too far: nearer to where it came from
        else:
            gradient += z.T @ (p - self.y) + ridge
            # The curvature of the labelled rows stands for the others' too, with their own on the diagonal.
            curvature = (z.T * np.maximum(p * (1 - p), LEAST_CURVE)) @ z + np.diag(np.maximum(diagonal, 0) + np.append(np.ones(k), 1e-6))
            self.best, self.stride = (total, self.w, np.linalg.solve(curvature, gradient)), min(1.0, 2 * self.stride)
        self.w = self.best[1] - self.stride * self.best[2]

    def settle(self) -> None:
        """Keep the best weights tried."""
        if self.best is not None:
            self.w = self.best[1]
            self.model = learn.Linear(self.model.mean, self.model.scale, self.w[:-1], float(self.w[-1]))


Students = dict[str, list[Student]]
#: Of a student: how many documents the other view is sure of; their loss, residuals and curvatures; and by column the
#: sums of x * residual, x * curvature and x * x * curvature.
_SUMS = pa.schema([("view", pa.string()), ("version", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())])
_SUMS_SQL = "view string, version int, salt int, sums binary"


def sums_of(x: dict[str, np.ndarray], sure: dict[str, np.ndarray], tried: dict[str, np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
    """The sums of a batch for each view and version: x by view, sure and tried (raw weights, a column a version) of teachers and students."""
    out = {}
    for v, other in (("text", "meta"), ("meta", "text")):
        p = learn.sigmoid(x[other] @ sure[other][:-1] + sure[other][-1])
        yes = p >= CONFIDENT
        used = yes | (p <= 1 - CONFIDENT)
        logit = x[v] @ tried[v][:-1] + tried[v][-1]
        q = learn.sigmoid(logit)
        r, d = np.where(used, q - yes, 0.0), np.where(used, q * (1 - q), 0.0)
        loss = np.where(used, np.logaddexp(0, logit) - yes * logit, 0.0).sum(axis=0)
        head = np.stack([used.sum(axis=0), loss, r.sum(axis=0), d.sum(axis=0)])
        for i, column in enumerate(np.concatenate([head, x[v].T @ r, x[v].T @ d, (x[v] ** 2).T @ d]).T):
            out[v, i] = column
    return out


def pass_over(unlabelled: DataFrame, sure: dict[str, np.ndarray], tried: dict[str, np.ndarray]) -> dict[tuple[str, int], np.ndarray]:
    """sums_of() all unlabelled documents: a few hundred numbers for each student from a task, added up in two levels."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, sums in sums_of(views(batch), sure, tried).items():
                    total[key] = total[key] + sums if key in total else sums
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in total], pa.string()), pa.array([i for _, i in total], pa.int32()), pa.array([salt] * len(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], schema=_SUMS)

    def whole(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(t) for t in rows.column("sums").to_pylist()], axis=0)
        first = rows.slice(0, 1)
        return pa.table([first["view"], first["version"], first["salt"], pa.array([total.tobytes()], pa.binary())], schema=_SUMS)

    parts = unlabelled.mapInArrow(add, _SUMS_SQL).groupBy("view", "version", "salt").applyInArrow(whole, _SUMS_SQL)
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in sorted(parts.collect(), key=lambda r: r["salt"]):
        sums, key = np.frombuffer(bytes(r["sums"])), (r["view"], r["version"])
        out[key] = out[key] + sums if key in out else sums
    return out


def co_trained(x: dict[str, np.ndarray], y: np.ndarray, fold: np.ndarray, look: Callable[..., dict[tuple[str, int], np.ndarray]]) -> Students:
    """Both views' models after ROUNDS rounds: version 0 of all labelled rows, version f + 1 of those outside fold f.

    The versions learn side by side and never from each other, so what teaches version f + 1 has seen nothing of
    fold f. look(sure, tried): the sums over all unlabelled documents for the teachers' and the tried weights.
    """
    versions = [np.ones(len(y), bool), *(fold != f for f in range(FOLDS))]
    students = {v: [Student(x[v], y, m) for m in versions] for v in x}
    weights = lambda: {v: np.column_stack([s.raw(s.w) for s in own]) for v, own in students.items()}
    for _ in range(ROUNDS if students["text"][0].learns else 0):
        sure = weights()
        for s in (*students["text"], *students["meta"]):
            s.restart()
        for _ in range(STEPS):
            still = {(v, i): s for v, own in students.items() for i, s in enumerate(own) if not s.done}
            if not still:
                break
            sums = look(sure, weights())
            for key, s in still.items():
                if key in sums:
                    s.told(sums[key])
        for own in students.values():
            for s in own:
                s.settle()
    return students


def train(sample: DataFrame, unlabelled: DataFrame, width: int) -> CoModel:
    """The model of feature rows: sample has a label each, and its number is bounded."""
    rows = sample.orderBy("doc_id", "x").toArrow().combine_chunks()
    batch = rows.to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema)
    x, y = views(batch, width), np.asarray(rows.column("label")).astype(float) > 0
    y = y.astype(float)
    fold = learn.folds(np.asarray(rows.column("doc_id")).astype(np.int64), FOLDS)
    students = co_trained(x, y, fold, lambda sure, tried: pass_over(unlabelled, sure, tried))
    logits = {v: np.array([own[int(f) + 1].model.logit(row) for f, row in zip(fold, x[v], strict=True)]) for v, own in students.items()}
    model = CoModel({v: own[0].model for v, own in students.items()}, {v: learn.fit(np.clip(logits[v], -13.8, 13.8)[:, None], y) for v in x}, None, 0.0)
    stacked = model.calibrated(logits) if len(y) else np.zeros((0, 2))
    model.both = learn.fit(stacked, y)
    if len(y) and y.min() < y.max():
        good = np.sort(learn.out_of_fold(stacked, y, fold)[y > 0])
        model.threshold = float(min(0.5, good[int(REJECT_AT_MOST * len(good))]))
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("p_text", pa.float64()), ("p_meta", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_()), ("held", pa.int64())])


def score(feature_rows: DataFrame, model: CoModel) -> DataFrame:
    sent = feature_rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, worded = views(batch), np.asarray(batch.column(1))
            single = m.calibrated({v: m.view[v].logit(x[v]) for v in x})
            p = np.where(worded, m.both.predict(single), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(learn.sigmoid(single[:, i]))) for i in (0, 1)), pa.array(p), pa.array((p >= m.threshold) & worded), batch.column(6)], schema=_OUT)

    return feature_rows.mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, keep boolean, held long")


def classify(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every document."""
    return judged(documents, labels, sample).drop("held")


def judged(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """classify() with held, the hash by which a row of a doc_id is known again."""
    docs = meta_columns(documents)
    ids = learn.labelled_ids(labels, "quality", sample)
    columns = learn.choose(learn.sample_words(docs, ids, SPACED), WORDS)
    rows = features(documents, columns)
    known = rows.join(F.broadcast(ids), rows["doc_id"] == ids["of_id"]).select(*rows.columns, "label")
    every = labels.select(F.col("doc_id").cast("long").alias("known_id")).filter(F.col("quality").isNotNull() & F.col("known_id").isNotNull()).distinct()
    free = checkpointed(rows.filter("doc_id IS NOT NULL AND worded").join(every, F.col("doc_id") == F.col("known_id"), "left_anti"))
    model = train(known, free, len(learn.STATS) + len(columns))
    discard(free)
    return score(rows, model)


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject, each row judged by what it holds."""
    gone = judged(documents, labels).filter("NOT keep").select(F.col("doc_id").alias("gone_id"), F.col("held").alias("gone_held")).distinct()
    # A row's columns travel as one, so that no name of theirs can clash.
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), documents["doc_id"].cast("long").alias("of_id"), F.xxhash64(*_own(documents).values()).alias("of_held"))
    return rows.join(gone, F.col("of_id").eqNullSafe(F.col("gone_id")) & (F.col("of_held") == F.col("gone_held")), "left_anti").select("row.*")

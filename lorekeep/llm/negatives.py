"""Hard negatives: for an anchor and a positive, the best rows of other labels that score near below it.

Method. Scores are integer inner products, found by Kronecker-packed products: the components of
several candidates are biased to be no less than zero and laid in separated fields of one wide
number, which is multiplied once per anchor component; as a field is wide enough for the whole
biased sum, the exact scores are read from the fields of the total. Numbers of up to 53 bits are
multiplied as doubles, in which they are exact, by a matrix product; wider fields go into Python's
integers of any length.

Anchors are taken in blocks of at most some BLOCK rows, each sent to all tasks; a task holds its
rows against the block in tiles and sends on an anchor's best rows only, so that no pair is
shuffled. A first pass finds the positives among the rows of the anchor's label, a second one the
negatives among the others: together they form each product once.

Defined results: rows with a null id, a null label, a null vector or a null or non-finite component
take no part; of rows with one vec_id the least by label and vector counts; a shorter vector counts
as if zeros followed; scores beyond the range of long count as its end; a positive score below zero
has no negatives; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import BROADCAST_IDS, checkpointed, discard, shared_folder

#: Anchors of a block, and rows and anchors of a tile of scores.
BLOCK, TILE_ROWS, TILE_ANCHORS = 16384, 4096, 512
EXACT_BITS = 53
#: Candidates of one Python integer.
WIDE_FIELDS = 64
_LONG = np.iinfo(np.int64)


# -- exact scores --------------------------------------------------------------


def _magnitude(m: np.ndarray) -> int:
    return max((abs(int(x)) for x in (m.max(), m.min())), default=0) if m.size else 0


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all rows, matrices of whole numbers of equal width."""
    a_bias, r_bias, d = _magnitude(anchors), _magnitude(rows), anchors.shape[1]
    width = max(1, (4 * d * a_bias * r_bias).bit_length())
    if width > EXACT_BITS or max(a_bias, r_bias) >= 1 << 52:
        return _wide_products(anchors, rows, a_bias, r_bias, width)
    a, r = anchors.astype(np.float64) + a_bias, rows.astype(np.float64) + r_bias
    fields = EXACT_BITS // width
    full = -(-len(r) // fields)
    packed = np.zeros((full, d))
    for j in range(fields):
        part = r[j * full : (j + 1) * full]
        packed[: len(part)] += part * float(1 << (width * j))
    total = (a @ packed.T).astype(np.int64)
    mask = np.int64((1 << width) - 1)
    out = np.concatenate([(total >> np.int64(width * j)) & mask for j in range(fields)], axis=1)[:, : len(r)]
    return out - (r_bias * a.sum(axis=1)).astype(np.int64)[:, None] - (a_bias * r.sum(axis=1)).astype(np.int64)[None, :] + np.int64(d * a_bias * r_bias)


def _wide_products(anchors: np.ndarray, rows: np.ndarray, a_bias: int, r_bias: int, width: int) -> np.ndarray:
    a, r = [[int(x) + a_bias for x in v] for v in anchors], [[int(x) + r_bias for x in v] for v in rows]
    d, mask, out = anchors.shape[1], (1 << width) - 1, np.zeros((len(a), len(r)), np.int64)
    for first in range(0, len(r), WIDE_FIELDS):
        part = r[first : first + WIDE_FIELDS]
        packed = [sum(v[k] << (width * j) for j, v in enumerate(part)) for k in range(d)]
        for i, v in enumerate(a):
            total, own = sum(x * y for x, y in zip(v, packed, strict=True)), sum(v)
            for j, w in enumerate(part):
                score = ((total >> (width * j)) & mask) - r_bias * own - a_bias * sum(w) + d * a_bias * r_bias
                out[i, first + j] = min(max(score, int(_LONG.min)), int(_LONG.max))
    return out


# -- rows as whole numbers -----------------------------------------------------

_ROWS = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("v", pa.binary())])


def whole(values: list[float]) -> list[int]:
    return [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in values]


def as_numbers(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(id, label, bytes a component or 0, components) of usable rows; 0: decimal digits, for numbers beyond 32 bits."""
    for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        v = v.values.to_numpy(zero_copy_only=False) if v.is_valid else None
        if v is None or not np.isfinite(v).all():
            continue
        with np.errstate(over="ignore"):
            z = np.floor(256 * v)
        top = np.abs(z).max(initial=0)
        size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 0
        yield i, label, size, z.astype(f"<i{size}").tobytes() if size else ",".join(map(str, whole(v.tolist()))).encode()


def numbers(sizes: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """The matrix of vectors as as_numbers() gives them; of Python's integers if one needs them."""
    read = [np.frombuffer(b, f"<i{s}") if s else [int(x) for x in b.decode().split(",")] for s, b in zip(sizes.tolist(), raws, strict=True)]
    out = np.zeros((len(read), max(map(len, read), default=0)), np.int64 if sizes.all() else object)
    for i, v in enumerate(read):
        out[i, : len(v)] = v
    return out


def usable(embeddings: DataFrame, moved: int, labels: int) -> DataFrame:
    """(id, label, size, v) of the rows that take part, each vec_id once; every moved-th one with the next label."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")).dropna(subset=["id", "label", "v"])
    rows = rows.withColumn("label", F.when(F.col("id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = list(as_numbers(batch))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True) if kept else [[]] * 4, _ROWS, strict=True)], schema=_ROWS)

    good = checkpointed(rows.mapInArrow(run, "id long, label long, size int, v binary"))
    ids = checkpointed(good.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("again")), F.count(F.lit(1)).alias("n"))
    if not ids.seen["n"]:
        return good
    again = F.broadcast(ids) if ids.seen["n"] <= BROADCAST_IDS else ids
    least = good.join(again, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min(F.struct("label", "size", "v")).alias("row")).select("id", "row.*")
    return checkpointed(good.join(again, F.col("id") == F.col("again"), "left_anti").unionByName(least))


# -- passes over the rows ------------------------------------------------------


def best(scores: np.ndarray, fit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k highest scores among those that fit; of equal ones the first columns."""
    n = scores.shape[1]
    if _magnitude(scores) >= (1 << 62) // n:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape).astype(np.int64)
    key = np.where(fit, scores * n + np.arange(n - 1, -1, -1), _LONG.min)
    at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
    i = np.repeat(np.arange(len(key)), at.shape[1])
    good = fit[i, at.ravel()]
    return i[good], at.ravel()[good]


class Best:
    """The k best (score, id) of each key so far: by score downwards, then by id."""

    def __init__(self, k: int):
        self.k, self.held, self.size, self.limit = k, [], 0, 1 << 18

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((key, score, ids))
        self.size += len(key)
        if self.size > self.limit:
            key, *_ = self.cut()
            self.limit = max(1 << 18, 2 * len(key))

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, score, ids = (np.concatenate([np.zeros(0, np.int64), *p]) for p in (zip(*self.held, strict=True) if self.held else [[]] * 3))
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        good = place < self.k
        self.held, self.size = [(key[good], score[good], ids[good])], int(good.sum())
        return self.held[0]


def _widened(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] == d else np.concatenate([m, np.zeros((len(m), d - m.shape[1]), m.dtype)], axis=1)


def tiles(batches: Iterator[pa.RecordBatch], sent: Broadcast, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of anchors in the block, ids of rows in order, scores) for anchors and rows of the same label, or of others."""
    anchors = numbers(sent.value["size"], sent.value["v"])
    for batch in batches:
        for first in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(first, TILE_ROWS)
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            rows = numbers(part.column(2).to_numpy(), part.column(3).to_pylist())
            d = max(anchors.shape[1], rows.shape[1], 1)
            rows, wide = _widened(rows, d), _widened(anchors, d)
            order = np.argsort(ids, kind="stable")
            for label in np.unique(sent.value["label"]):
                own = np.flatnonzero(sent.value["label"] == label)
                use = order[(labels[order] == label) == same]
                for at in range(0, len(own) if len(use) else 0, TILE_ANCHORS):
                    places = own[at : at + TILE_ANCHORS]
                    yield places, ids[use], packed_products(wide[places], rows[use])


_BEST = pa.schema([("key", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def positives(rows: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(key, score, id): the k best rows of the same label for each anchor of the block, key being its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Best(k)
        for places, ids, scores in tiles(batches, sent, same=True):
            i, j = best(scores, sent.value["id"][places][:, None] != ids[None, :], k)
            found.add(places[i], scores[i, j], ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.cut()], schema=_BEST)

    return ranked(rows.mapInArrow(run, "key long, score long, id long"), k)


def negatives(rows: DataFrame, sent: Broadcast, k: int, n_positives: int, low: int, high: int) -> DataFrame:
    """(key, score, id, rank): for each anchor and positive, whose place is key, the k best rows of other labels in its window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, score = Best(k), sent.value["positive_score"]
        least = np.array([[-(-low * s // 100) for s in own] for own in score.tolist()], np.int64).reshape(score.shape)
        most = np.array([[high * s // 100 for s in own] for own in score.tolist()], np.int64).reshape(score.shape)
        for places, ids, scores in tiles(batches, sent, same=False):
            for p in range(n_positives):
                has = np.flatnonzero(sent.value["n_positives"][places] > p)
                s, own = scores[has], places[has]
                i, j = best(s, (s >= least[own, p][:, None]) & (s <= most[own, p][:, None]), k)
                found.add(own[i] * n_positives + p, s[i, j], ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.cut()], schema=_BEST)

    return ranked(rows.mapInArrow(run, "key long, score long, id long"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 50, moved: int = 7, labels: int = 10, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is a multiple of every. A negative scores between low and high
    hundredths of the positive.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, moved, labels)
    anchors = checkpointed(rows.filter(F.col("id") % every == 0), F.count(F.lit(1)).alias("n"))
    blocks, at = -(-anchors.seen["n"] // block), f"{shared_folder(spark)}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(at)
    for b in range(blocks):
        held = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        n = held.num_rows
        told = {"id": held["id"].to_numpy(), "label": held["label"].to_numpy(), "size": held["size"].to_numpy(), "v": held["v"].to_pylist()}
        sent = spark.sparkContext.broadcast(told)
        near = checkpointed(positives(rows, sent, n_positives))
        best_of = near.orderBy("key", "rank").toArrow()
        sent.destroy()
        key, place = best_of["key"].to_numpy(), best_of["rank"].to_numpy() - 1
        score, ids = np.zeros((n, n_positives), np.int64), np.zeros((n, n_positives), np.int64)
        score[key, place], ids[key, place] = best_of["score"].to_numpy(), best_of["id"].to_numpy()
        sent = spark.sparkContext.broadcast(told | {"positive_score": score, "n_positives": np.bincount(key, minlength=n)})
        far = checkpointed(negatives(rows, sent, n_negatives, n_positives, low, high))
        sent.destroy()
        # What a key stands for is looked up in a table as small as the block.
        keys = np.arange(n * n_positives)
        names = spark.createDataFrame(pa.table({"pair": keys, "anchor_id": told["id"][keys // n_positives], "positive_id": ids.ravel(), "positive_score": score.ravel()}))
        out = far.join(F.broadcast(names), F.col("key") == F.col("pair"))
        out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(at)
        discard(near, far)
    return spark.read.schema(schema).parquet(at)

"""Which keys of a document shard occur in other shards too, without moving a row for each key.

Documents are dealt to shards of bounded size by a hash of their id. A shard sends each of its
distinct 64-bit keys once, as 4 bytes in a sorted block for the bucket that the key's upper bits
name; a bucket compares its blocks and answers each with a bit for each key. Buckets are as many
as the keys need, so that chance agreement of the 4 bytes stays as rare at any size; it only ever
adds a candidate that an exact comparison then drops. A key that every document holds costs each
shard one entry of 4 bytes; a bucket grows with the shards by no more than that for each such key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import parts_for, text_bytes

SHARD_BYTES = 4 << 20
#: Shards to a bucket of keys: a shard's row for a bucket holds keys enough to be worth its overhead.
PER_BUCKET = 8
_U = np.uint64


class Layout:
    """Shards and buckets for a corpus of so many bytes; every node computes the same."""

    def __init__(self, n_bytes: int):
        self.shards = parts_for(n_bytes, SHARD_BYTES, least=12)
        self.buckets = max(12, self.shards // PER_BUCKET)

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> _U(32)) % _U(self.buckets)).astype(np.int64)

    def blocks(self, keys: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, places in keys, 4-byte remainders) of distinct sorted keys, remainders sorted."""
        bucket, rest = self.bucket_of(keys), keys.astype(np.uint32)
        order = np.lexsort((rest, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        return [(int(bucket[p[0]]), p, rest[p]) for p in np.split(order, cuts) if len(p)]


def dealt(docs: DataFrame) -> tuple[DataFrame, Layout]:
    """docs (doc_id, text) with a shard each, partitioned by it."""
    layout = Layout(text_bytes(docs))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(layout.shards)).cast("int")
    return docs.withColumn("shard", shard).repartition(layout.shards, "shard"), layout


def sorted_docs(rows: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """A shard's ids and texts in the order of id, then text: the same each time it is read."""
    raws = [x.as_buffer().to_pybytes() for chunk in rows.column("text").chunks for x in chunk]
    ids = rows.column("doc_id").to_numpy()
    order = sorted(range(len(raws)), key=lambda i: (ids[i], raws[i]))
    return ids[order].astype(np.int64), [raws[i] for i in order]


_BLOCK = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("block", pa.binary())])
_MARK = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def marks(shards: DataFrame, layout: Layout, keys_of: Callable[[np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """(shard, bucket, bits): for each key that keys_of gives for a shard (distinct, sorted), if another shard has it."""

    def send(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        blocks = layout.blocks(keys_of(*sorted_docs(rows)))
        return pa.table([pa.array([b for b, _, _ in blocks], pa.int32()), pa.array([shard] * len(blocks), pa.int32()), pa.array([r.tobytes() for _, _, r in blocks], pa.binary())], schema=_BLOCK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}
        for batch in batches:
            for b, s, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.setdefault(b, []).append((s, np.frombuffer(block.as_buffer().to_pybytes(), np.uint32)))
        for b, blocks in held.items():
            ordered = np.sort(np.concatenate([x for _, x in blocks]))
            out = []
            for _, x in blocks:
                found = np.searchsorted(ordered, x, "right") - np.searchsorted(ordered, x, "left")
                own = np.searchsorted(x, x, "right") - np.searchsorted(x, x, "left")
                out.append(np.packbits(found > own).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in blocks], pa.int32()), pa.array([b] * len(blocks), pa.int32()), pa.array(out, pa.binary())], schema=_MARK)

    sent = shards.groupBy("shard").applyInArrow(send, "bucket int, shard int, block binary")
    return sent.repartition(layout.buckets, "bucket").mapInArrow(answer, "shard int, bucket int, bits binary")


def marked(layout: Layout, keys: np.ndarray, rows: pa.Table) -> np.ndarray:
    """The answer for each of a shard's keys, of its rows of marks."""
    out = np.zeros(len(keys), dtype=bool)
    bits = {b: x.as_buffer().to_pybytes() for b, x in zip(rows.column("bucket").to_pylist(), (x for c in rows.column("bits").chunks for x in c), strict=True)}
    for b, places, rest in layout.blocks(keys):
        if b in bits:
            out[places] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=len(rest)).astype(bool)
    return out

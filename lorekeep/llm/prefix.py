"""Similar sets by their rarest numbers: an exact join for what the bands of a MinHash leave open.

Two sets whose similarity reaches the threshold share one of the first few numbers of either, in any
order that all sets keep to; in the order of rarity the sets that meet there are few. Rarity is
told by a table of counts of fixed size, in which numbers may fall together: that changes who meets, but
never whether two similar sets do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

#: Counters of the rarity table, by so many bits of a number's hash.
COUNTER_BITS = 18
_U = np.uint64
_COUNTS = pa.schema([("counter", pa.int32()), ("n", pa.int64())])
_ROWS = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("key", pa.int64())])


def _counters(values: np.ndarray) -> np.ndarray:
    return (mix(values.astype(np.uint64) + _U(1)) >> _U(64 - COUNTER_BITS)).astype(np.int64)


def rarity(sets: DataFrame, kind: type) -> np.ndarray:
    """How many sets (id, grams) hold a number of each counter: one table of 2 ** COUNTER_BITS."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_counters(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], schema=_COUNTS)

    out = np.zeros(1 << COUNTER_BITS, np.int64)
    found = sets.select("grams").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def first_numbers(sets: DataFrame, percent: int, kind: type) -> DataFrame:
    """(id, n, key): of each set (id, grams) of n numbers, the rarest that a similar set must share one of."""
    counts = rarity(sets, kind).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raws = batch.column(1).to_pylist()
            value = np.frombuffer(b"".join(raws), kind).astype(np.uint64)
            size = np.array([len(r) for r in raws], np.int64) // np.dtype(kind).itemsize
            owner = np.repeat(np.arange(len(raws)), size)
            order = np.lexsort((value, counts[_counters(value)], owner))
            place = np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)
            use = place < (size + percent * size * -1 // 100 + 1)[owner]
            ids, key = np.asarray(batch.column(0))[owner[use]], value[order][use].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(size[owner[use]].astype(np.int32)), pa.array(key)], schema=_ROWS)

    return sets.select("id", "grams").mapInArrow(run, "id long, n int, key long")

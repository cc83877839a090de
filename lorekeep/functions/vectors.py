"""Vectors as arrays of doubles: normalising, cosine, and a hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The hashing embedder's own CJK ranges (five, without the supplementary plane).
_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def normalised(x: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(x, lambda v: let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda e: e / n))))


def letters(text: Column) -> Column:
    """A text's letters, digits and CJK characters in lower case, joined."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^\p{{L}}\p{{N}}{_CJK}]", "")


_RUNS = re.compile(r"[{0}]+|[^{0}]+".format(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), _CJK)))
#: Features whose bucket a task remembers.
_REMEMBERED = 1 << 18


def features(joined: str) -> Counter:
    """How often each feature stands in letters(): words and their letter pairs, CJK characters and their pairs, each with a prefix of its kind."""
    found: Counter = Counter()
    for run in _RUNS.findall(joined):
        cjk = _RUNS.match(run[0] + "a").end() == 1
        if cjk:
            found.update("c:" + c for c in run)
        else:
            found["w:" + run] += 1
        for pair, n in Counter(map("".join, zip(run, run[1:], strict=False))).items():
            found[("b:" if cjk else "g:") + pair] += n
    return found


def bucket_and_sign(feature: str, dim: int, salt: str = "") -> tuple[int, float]:
    value = int(hashlib.sha1((salt + feature).encode()).hexdigest()[:12], 16)
    return value % dim, 1.0 if value >> 40 & 1 else -1.0


def hash_embeddings(rows: DataFrame, dim: int = 64, salt: str = "") -> DataFrame:
    """(id, vector) of rows (id, text): signed feature counts in `dim` buckets at unit length, zero without features.

    A text's features are counted first and hashed once each, in one Arrow pass without a shuffle.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dim))
            for own, joined in zip(out, batch.column(1).to_pylist(), strict=True):
                for feature, n in features(joined).items():
                    if feature not in known:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        known[feature] = bucket_and_sign(feature, dim, salt)
                    bucket, sign = known[feature]
                    own[bucket] += sign * n
            length = np.sqrt((out * out).sum(axis=1, keepdims=True))
            out /= np.where(length > 0, length, 1.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "vector"])

    return rows.select("id", letters(F.col("text")).alias("joined")).mapInArrow(run, f"id {kind}, vector array<double>")

"""Benchmark decontamination: a prefix-filtered join of item windows with document windows.

Method. An item's shingles are its windows of consecutive words (an item of fewer words is one
window). The words of the windows are counted in the whole corpus and ordered by rarity; as a
window must be contained whole, the prefix that has to be joined is its rarest word alone. A
document word that is some window's prefix fixes where that window would start (position
bound), whether it would fit (length bound), and the words there are then compared one by one.
The items are taken in blocks of bounded size, each sent to all tasks, so that a benchmark of
any size needs no join that deals documents by a word.

Defined results: null or wordless texts have no words, no windows and no hits; a null item_id
is left out; repeated items count once; repeated documents give repeated rows, and texts that
share a doc_id, or have none, a row each, in one block or several; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import texts
from .words import ALNUM_SPACES

WINDOW = 10
#: Items of so many bytes of text form a block, whose windows each task holds.
BLOCK_BYTES = 4 << 20

_FOUND = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<long>, copy string, rows long"
_FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.int64())), ("copy", pa.string()), ("rows", pa.int64())])


def words(raw: bytes) -> list[bytes]:
    return raw.translate(ALNUM_SPACES).split()


def raw_text(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def windows(item: list[bytes], n: int) -> list[tuple[bytes, ...]]:
    return [tuple(item[i : i + n]) for i in range(max(1, len(item) - n + 1))] if item else []


def corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How many documents of the corpus hold each word of the (bounded) vocabulary."""
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(wanted.value.intersection(words(raw_text(text))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def prefix_index(items: list[tuple[int, list[bytes]]], counts: dict[bytes, int], n: int) -> dict[bytes, list]:
    """Rarest word of a window -> (its offset, the window, the items that have it)."""
    holders: dict[tuple, set[int]] = defaultdict(set)
    for item_id, item in items:
        for w in windows(item, n):
            holders[w].add(item_id)
    index: dict[bytes, list] = defaultdict(list)
    for w, ids in holders.items():
        offset = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
        if counts.get(w[offset], 0):  # a word that no document has: the window occurs nowhere
            index[w[offset]].append((offset, list(w), sorted(ids)))
    return dict(index)


def occurrences(own: list[bytes], index: dict[bytes, list], keys: frozenset[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """(first word, end, items) of each window of the index that stands in a document's words."""
    if keys.isdisjoint(own):
        return
    for at in [i for i, w in enumerate(own) if w in keys]:
        for offset, window, holders in index[own[at]]:
            start = at - offset
            if start >= 0 and own[start : start + len(window)] == window:
                yield start, start + len(window), holders


def find_windows(docs: DataFrame, items: list[tuple[int, list[bytes]]], n: int, only_hits: bool) -> DataFrame:
    """Places of one block's windows in each document (doc_id, text, copy, rows): word spans and the items found."""
    counts = corpus_counts(docs, {w for _, item in items for w in item})
    sent = docs.sparkSession.sparkContext.broadcast(prefix_index(items, counts, n))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        keys = frozenset(index)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, copy, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = words(raw_text(text))
                spans, items = set(), set()
                for start, end, holders in occurrences(own, index, keys):
                    spans.add((start, end))
                    items.update(holders)
                if spans or not only_hits:
                    ordered = sorted(spans)
                    out.append((doc_id, len(own), [s for s, _ in ordered], [e for _, e in ordered], sorted(items), copy, rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(_FOUND_ARROW)], schema=_FOUND_ARROW)

    return docs.select("doc_id", "text", "copy", "rows").mapInArrow(find, _FOUND)


def _summary(starts: list[int], ends: list[int], items: list[int]) -> tuple[int, int, str]:
    hit, done = 0, 0
    for s, e in sorted(zip(starts, ends, strict=True)):
        hit += max(0, e - max(s, done))
        done = max(done, e)
    names = sorted({str(i) for i in items})
    return hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_REPORT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def report(found: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, s, e, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit, k, sha = _summary(s or [], e or [], items or [])
                out.append((doc_id, n, hit, k, sha, hit > 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(_REPORT_ARROW)], schema=_REPORT_ARROW)

    return found.mapInArrow(digest, _REPORT)


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], list[tuple[int, list[bytes]]]]]:
    """How many blocks of bounded size the items make, and what gives the items of one: (item_id, words)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("item_id IS NOT NULL")
    n_bytes = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    return blocks, lambda b: [(r["item_id"], words(r["text"].encode())) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator()]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = texts(documents)
    blocks, block = _blocks(benchmark, block_bytes)
    if blocks == 1:
        single = docs.withColumns({"copy": F.lit(None).cast("string"), "rows": F.lit(1).cast("long")})
        return report(find_windows(single, block(0), window, only_hits=False).drop("copy", "rows"))
    # Equal rows are searched once; a text's findings meet again by its id and digest, and each row is told.
    every = docs.withColumn("copy", F.sha2("text", 256)).groupBy("doc_id", "copy").agg(F.count("*").alias("rows"), F.first("text").alias("text"))
    found = None
    for b in range(blocks):
        part = find_windows(every, block(b), window, only_hits=b > 0)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id", "copy").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.flatten(F.collect_list("items")).alias("items"), F.max("rows").alias("rows")
    )
    again = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("again")
    merged = merged.select("doc_id", "n_words", "starts", "ends", "items", again).drop("again")
    return report(merged)


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item: each row is judged by its own text, whatever its doc_id."""
    docs = texts(documents)
    blocks, block = _blocks(benchmark, block_bytes)
    kept, schema, column = documents, documents.schema, documents.columns.index("text")
    for b in range(blocks):
        items = block(b)
        counts = corpus_counts(docs, {w for _, item in items for w in item})
        sent = docs.sparkSession.sparkContext.broadcast(prefix_index(items, counts, window))

        def free(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            keys = frozenset(index)
            for batch in batches:
                clear = [next(occurrences(words(raw_text(text)), index, keys), None) is None for text in batch.column(column)]
                yield batch.filter(pa.array(clear, pa.bool_()))

        kept = kept.mapInArrow(free, schema)
    return kept

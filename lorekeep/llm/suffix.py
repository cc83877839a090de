"""Exact substring dedup by suffix arrays.

Method. Documents are dealt to shards. A shard's suffixes are sorted to the length that counts
by Larsson-Sadakane refinement: ranks by the first 8 bytes, then doubled, only groups that are
still tied being sorted again. Kasai's common prefixes of neighbours, cut at that length, tell
where one repeated string ends and the next begins; a string's least doc_id in the shard follows.
Strings are then merged across shards by binary search: a shard sends those that may occur
elsewhere to the bucket of the string's minimizer, each once; the bucket sorts each shard's strings
by a hash, finds them by binary search among the sorted ones of all shards, compares the bytes, and
answers with the least doc_id's verdict. (The order of the merge is that of the hashes, as 50 bytes
are dear to compare; the order of the bytes decides inside a shard.)

Before sorting, only the stretches whose minimizers (the least of the LENGTH - GRAM + 1 hashed
grams of a string) occur in another document are kept, as equal strings have equal minimizers.
Nothing that can match is lost by that, and text that no other document shares isn't sorted.

Defined results: null text is empty; texts shorter than LENGTH lose nothing; a doc_id that
repeats is treated as one document for matching (its rows never remove each other) and gives a
row each; rows with a null doc_id are left out; NUL and any other bytes are ordinary; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import texts
from .shards import Layout, dealt, marked, marks, sorted_docs
from .words import mix, powers, unique

LENGTH = 50
GRAM = 26
#: Texts are hashed so many bytes at a time.
PIECE = 1 << 18
_U = np.uint64
_VALUE = mix(np.arange(256, dtype=np.uint64) + _U(12345)) | _U(1)


def join_texts(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, 0xFF (no byte of UTF-8) after each text, and where the texts start."""
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    return np.frombuffer(b"\xff".join(raws) + b"\xff", np.uint8), np.concatenate(([0], np.cumsum(sizes + 1)))


def gram_hashes(blob: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n bytes from each place on, worked out PIECE places at a time."""
    out = np.zeros(max(0, len(blob) - n + 1), dtype=np.uint64)
    for at in range(0, len(out), PIECE):
        part = blob[at : at + PIECE + n - 1]
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
        out[at : at + PIECE] = mix((total[n:] - total[:-n]) * down[: len(part) - n + 1])
    return out


def minimizers(blob: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each string of `length` bytes, by its start: the least hash of its grams. 0 where it spans texts."""
    h = gram_hashes(blob, gram)
    w = length - gram + 1
    if len(h) < w:
        return np.zeros(0, dtype=np.uint64)
    low, k = h, 1
    while 2 * k <= w:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    n = len(h) - w + 1
    low = np.minimum(low[:n], low[w - k : w - k + n])
    low = np.where(low == 0, _U(1), low)
    n = len(low)
    gaps = np.concatenate(([0], np.cumsum(blob == 0xFF)))
    low[gaps[length : length + n] != gaps[:n]] = 0
    return low


def first_eight(blob: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number, NULs past the end."""
    whole = -(-len(blob) // 8) * 8
    padded = np.concatenate((blob, np.zeros(whole + 8 - len(blob), np.uint8)))
    out = np.empty(whole, dtype=np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + whole].view(">u8")
    return out[: len(blob)]


def suffix_order(blob: np.ndarray, words: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the suffixes at starts (sorted) by their first `length` bytes; equal ones share a rank.

    words: first_eight(blob).

    Larsson-Sadakane: refinement by the rank `depth` bytes further on needs that place's rank,
    so every place up to length - 8 past a start is ranked along.
    """
    first, n = runs_of(starts)
    stop = np.minimum(starts[first] + n - 1 + length - 7, len(blob))
    open_ = np.zeros(len(blob) + 1, dtype=np.int32)
    open_[starts[first]] = 1
    open_ -= np.bincount(stop, minlength=len(blob) + 1).astype(np.int32)
    place = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
    head = words[place]
    order = np.argsort(head)
    rank = np.empty(len(place), dtype=np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = head[order][1:] != head[order][:-1]
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(place))))
    index = np.full(len(blob) + length, -1, dtype=np.int64)
    index[place] = np.arange(len(place))
    depth = 8
    while depth < length:
        ahead = min(depth, length - depth)
        tied = np.repeat(np.diff(np.append(first, len(place))) > 1, np.diff(np.append(first, len(place))))
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = index[place[order[slots]] + ahead]
        further = np.where(at >= 0, rank[at], -1)
        group = rank[order[slots]]
        sub = np.argsort(group * (len(place) + 2) + further)
        order[slots] = order[slots][sub]
        group, further = group[sub], further[sub]
        new[slots[0]] = True
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = (group[1:] != group[:-1]) | (further[1:] != further[:-1])
        new[slots] = fresh
        first = np.flatnonzero(new)
        rank = np.empty_like(rank)
        rank[order] = np.repeat(first, np.diff(np.append(first, len(place))))
        depth += ahead
    own = np.zeros(len(place), dtype=bool)
    own[index[starts]] = True
    order = order[own[order]]
    return place[order], rank[order]


def common_prefixes(words: np.ndarray, order: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before, at most cap (0 for the first).

    Kasai's recurrence, in the order of the text: the suffix one byte on shares one byte fewer at
    least, unless the count was cut at cap or its start isn't in the order; then it starts at 0.
    Runs of consecutive starts advance together, a place each per step.
    """
    n = len(order)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    size = len(words)
    words = np.concatenate((words, np.zeros(cap + 8, np.uint64)))
    present = np.zeros(size + 1, dtype=bool)
    present[order] = True
    by_text = np.argsort(order, kind="stable")  # places in `order`, by start
    before = np.empty(n, dtype=np.int64)
    before[1:] = order[:-1]
    before[0] = -1
    left, right = before[by_text], order[by_text]
    lanes = max(1, n // 64)
    edge = np.linspace(0, n, lanes + 1).astype(np.int64)
    shared = np.zeros(n, dtype=np.int64)
    at, stop = edge[:-1].copy(), edge[1:]
    carry = np.zeros(lanes, dtype=np.int64)
    live = np.flatnonzero(at < stop)
    while len(live):
        i = at[live]
        a, b = left[i], right[i]
        h = carry[live].copy()
        go = np.flatnonzero(a >= 0)
        h[a < 0] = 0
        while len(go):
            x = words[a[go] + h[go]] ^ words[b[go] + h[go]]
            same = x == 0
            h[go] += sum((x < _U(1 << 8 * k)).astype(np.int64) for k in range(8))  # leading NULs: bytes in common
            go = go[same & (h[go] < cap)]
        h = np.minimum(h, cap)
        shared[i] = h
        nxt = np.minimum(i + 1, n - 1)
        follows = (right[nxt] == b + 1) & (h < cap) & (a >= 0) & present[np.maximum(a + 1, 0)]
        carry[live] = np.where(follows, np.maximum(h - 1, 0), 0)
        at[live] += 1
        live = live[at[live] < stop[live]]
    out[by_text] = shared
    return out


def minimizer_runs(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, minimizer) of the runs of strings of one text with one minimizer, over join_texts(raws)."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, first, size = 0, 0, 0
    for i, raw in enumerate(raws):
        size += len(raw) + 1
        if size >= PIECE or i == len(raws) - 1:
            low = minimizers(join_texts(raws[first : i + 1])[0])
            if len(low):
                start = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
                n = np.diff(np.append(start, len(low)))
                real = low[start] > 0
                found.append((at + start[real], n[real], low[start][real]))
            at, first, size = at + size, i + 1, 0
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shard_keys(ids: np.ndarray, raws: list[bytes]) -> np.ndarray:
    return unique(minimizer_runs(raws)[2])


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the runs."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else start, n) + np.arange(int(n.sum()))


def runs_of(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of the runs of consecutive places on which the other arrays stay equal."""
    if not len(places):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.diff(places) != 1
    for x in same:
        cut |= x[1:] != x[:-1]
    first = np.concatenate(([0], np.flatnonzero(cut) + 1))
    return first, np.diff(np.append(first, len(places)))


_RUN = np.dtype([("doc", "<i4"), ("n", "<i4"), ("start", "<i8"), ("id", "<i8")])
_SPAN = np.dtype([("doc", "<i4"), ("start", "<i8"), ("end", "<i8")])
_SENT = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("runs", pa.binary()), ("strings", pa.binary())])
_SPANS = pa.schema([("shard", pa.int32()), ("spans", pa.binary())])


def string_bucket(layout: Layout, keys: np.ndarray) -> np.ndarray:
    """Strings are longer than keys, so they are dealt to as many buckets as there are shards."""
    return ((mix(keys) >> _U(20)) % _U(layout.shards)).astype(np.int64)


def shard_strings(shard: int, ids: np.ndarray, raws: list[bytes], layout: Layout, mark_rows: pa.Table) -> pa.Table:
    """What a shard's suffix array decides by itself (bucket -1) and what its buckets must decide."""
    blob, begin = join_texts(raws)
    start, n, low = minimizer_runs(raws)
    keys, key = np.unique(low, return_inverse=True)
    elsewhere = marked(layout, keys, mark_rows)
    text = np.searchsorted(begin, start, "right") - 1
    pairs = unique(key * len(raws) + text)
    here = np.bincount(pairs // max(1, len(raws)), minlength=len(keys)) > 1
    chosen = (elsewhere | here)[key] if len(keys) else np.zeros(0, bool)
    start, n, key, text = start[chosen], n[chosen], key[chosen], text[chosen]
    valid, key, text = spread(start, n), np.repeat(key, n), np.repeat(text, n)

    words = first_eight(blob)
    order, _ = suffix_order(blob, words, valid)
    new = common_prefixes(words, order) < LENGTH
    group = np.cumsum(new) - 1
    owner = ids[np.searchsorted(begin, order, "right") - 1]
    least = np.minimum.reduceat(owner, np.flatnonzero(new)) if len(order) else owner
    gone = np.zeros(len(blob), dtype=bool)
    gone[order[owner > least[group]]] = True
    gone = gone[valid]

    first, n = runs_of(valid[gone], text[gone])
    spans = np.zeros(len(first), _SPAN)
    spans["doc"] = text[gone][first]
    spans["start"] = valid[gone][first] - begin[spans["doc"]]
    spans["end"] = spans["start"] + n + LENGTH - 1
    out = [(-1, spans.tobytes(), b"")]

    send = ~gone & elsewhere[key] if len(keys) else ~gone
    place, key, text = valid[send], key[send], text[send]
    first, n = runs_of(place, key, text)
    runs = np.zeros(len(first), _RUN)
    runs["doc"], runs["n"], runs["id"] = text[first], n, ids[text[first]]
    runs["start"] = place[first] - begin[text[first]]
    bucket = string_bucket(layout, keys[key[first]]) if len(first) else np.zeros(0, np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    for own in np.split(by_bucket, np.flatnonzero(np.diff(bucket[by_bucket])) + 1):
        if len(own):
            out.append((int(bucket[own[0]]), runs[own].tobytes(), b"".join([blob[p : p + k + LENGTH - 1].tobytes() for p, k in zip(place[first[own]].tolist(), n[own].tolist(), strict=True)])))
    return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([shard] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], schema=_SENT)


def merge_bucket(blocks: list[tuple[int, np.ndarray, bytes]]) -> list[tuple[int, bytes]]:
    """Verdicts on one bucket's strings: spans, by shard, of those that a smaller doc_id of any shard has."""
    runs = np.concatenate([r for _, r, _ in blocks])
    blob = np.frombuffer(b"".join(s for _, _, s in blocks), np.uint8)
    n = runs["n"].astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(n + LENGTH - 1)))[:-1]
    run = np.repeat(np.arange(len(runs)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    place = begin[run] + step
    name = gram_hashes(blob, LENGTH)[place]
    owner = runs["id"][run]
    # A string's number in its shard's block rides in the low bits of its hash, so that sorting carries it.
    sizes = [int(r["n"].sum()) for _, r, _ in blocks]
    low = _U((1 << max(sizes, default=1).bit_length()) - 1)
    edge = np.concatenate(([0], np.cumsum(sizes)))
    sorted_names = [np.sort((name[a:b] & ~low) | np.arange(b - a, dtype=np.uint64)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    ordered = unique(np.concatenate(sorted_names) & ~low)
    group = np.empty(len(name), dtype=np.int64)
    for a, mine in zip(edge[:-1], sorted_names, strict=True):  # binary search of each shard's strings among those of all
        group[a + (mine & low).astype(np.int64)] = np.searchsorted(ordered, mine & ~low)
    # Only strings that are not alone can have a smaller owner; their bytes are compared with one of their group.
    several = np.flatnonzero(np.bincount(group, minlength=len(ordered))[group] > 1)
    group, place, owner, run, step = group[several], place[several], owner[several], run[several], step[several]
    some = np.zeros(len(ordered), dtype=np.int64)
    some[group] = place
    words = first_eight(np.concatenate((blob, np.zeros(8, np.uint8))))
    model = some[group]
    equal = np.ones(len(place), dtype=bool)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        equal &= words[place + k] == words[model + k]
    if not equal.all():  # two strings with one hash: the group is told apart by the bytes themselves
        odd = np.flatnonzero(np.isin(group, unique(group[~equal])))
        names: dict[tuple[int, bytes], int] = {}
        for i in odd.tolist():
            group[i] = names.setdefault((int(group[i]), blob[place[i] : place[i] + LENGTH].tobytes()), len(ordered) + len(names))
    least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner)
    gone = least[group] < owner
    index = np.flatnonzero(gone)
    first, k = runs_of(place[index], run[index])
    spans = np.zeros(len(first), _SPAN)
    of = run[index[first]]
    spans["doc"] = runs["doc"][of]
    spans["start"] = runs["start"][of] + step[index[first]]
    spans["end"] = spans["start"] + k + LENGTH - 1
    shard = np.repeat([s for s, _, _ in blocks], [len(r) for _, r, _ in blocks])[of]
    return [(int(s), spans[shard == s].tobytes()) for s in np.unique(shard)]


def removed_spans(shards: DataFrame, layout: Layout) -> DataFrame:
    """(shard, spans): byte ranges to remove, by a document's place in its shard."""

    def decide(docs: pa.Table, mark_rows: pa.Table) -> pa.Table:
        return shard_strings(docs.column("shard")[0].as_py(), *sorted_docs(docs), layout, mark_rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray, bytes]]] = {}
        for batch in batches:
            shard = batch.column(1).to_pylist()
            for i, b in enumerate(batch.column(0).to_pylist()):
                runs = batch.column(2)[i].as_buffer().to_pybytes()
                if b < 0:
                    if runs:
                        yield pa.RecordBatch.from_arrays([pa.array([shard[i]], pa.int32()), pa.array([runs], pa.binary())], schema=_SPANS)
                else:
                    held.setdefault(b, []).append((shard[i], np.frombuffer(runs, _RUN), batch.column(3)[i].as_buffer().to_pybytes()))
        while held:
            out = merge_bucket(held.popitem()[1])
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=_SPANS)

    found = shards.groupBy("shard").cogroup(marks(shards, layout, shard_keys).groupBy("shard")).applyInArrow(decide, "bucket int, shard int, runs binary, strings binary")
    to = F.when(F.col("bucket") < 0, F.col("shard")).otherwise(F.col("bucket"))
    return found.repartition(layout.shards, to).mapInArrow(merge, "shard int, spans binary")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept): the maximal removed byte ranges and the bytes left of each document."""
    docs = texts(documents).filter("doc_id IS NOT NULL")
    shards, layout = dealt(docs)

    def cut(rows: pa.Table, span_rows: pa.Table) -> pa.Table:
        ids, raws = sorted_docs(rows)
        blocks = [x.as_buffer().to_pybytes() for c in span_rows.column("spans").chunks for x in c]
        spans = np.frombuffer(b"".join(blocks), _SPAN)
        spans = spans[np.argsort(spans["doc"], kind="stable")]
        edge = np.searchsorted(spans["doc"], np.arange(len(raws) + 1))
        starts, ends, kept = [], [], []
        for i, raw in enumerate(raws):
            own = spans[edge[i] : edge[i + 1]]
            if not len(own):
                starts.append([])
                ends.append([])
                kept.append(raw)
                continue
            depth = np.zeros(len(raw) + 1, dtype=np.int64)
            np.add.at(depth, own["start"], 1)
            np.add.at(depth, own["end"], -1)
            gone = np.cumsum(depth[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
            starts.append(turns[::2].tolist())
            ends.append(turns[1::2].tolist())
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        return pa.table([pa.array(ids), pa.array(list(map(len, raws)), pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary())], schema=_KEPT)

    spans = removed_spans(shards, layout)
    return shards.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(cut, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

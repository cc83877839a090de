"""Substring dedup by paragraph MinHash banding.

Method. A document's units are its paragraphs (lines of WINDOW words or more, and the whole text if
it is shorter), and, as a repeated passage may begin and end inside a line, windows of WINDOW words:
one at each anchor word, which has the least hash among ANCHOR neighbours on either side, and one at
either end of the text. A unit's set is its five-word shingles, told apart by 32 bits of their hash;
BANDS bands of ROWS minima find a similarity of 0.8 with probability 0.998. Shards of documents
first tell each other, 4 bytes a key, which units collide anywhere; only those become rows. Equal
units are folded; different ones that share a band are joined star-wise to the band's centre and,
in buckets that then still hold several components, met again by their rarest shingles (prefix.py),
star-wise and then block by block; exact Jaccard of the shingle sets decides. Components cluster the
removals: a component's first unit, by doc_id and place, stays, and the words under the others go.
Where a run of removed units ends, the removal goes on word by word, over one changed word too, as
long as the words are those beside the unit that stays (CONTEXT words at most on a side).

Defined results: null text is empty; texts of fewer than five words lose nothing; a passage that
repeats inside one document goes there too, unless it overlaps the unit that stays; rows of one
doc_id are one document's copies and are ordered by text; rows with a null doc_id are left out;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_IDS, checkpointed, discard, texts
from .blocks import similar_in_groups
from .graph import components, looked_up
from .minhash import mixed
from .prefix import first_numbers
from .shards import Layout, dealt, marked, marks, sorted_docs
from .words import SPACED, Words, mix, powers, runs, unique

WINDOW = 16
ANCHOR = 5
SHINGLE = 5
CONTEXT = 16
BANDS, ROWS = 6, 2
PERCENT = 80
PIECE = 1 << 18
_U = np.uint64
_LAST = _U(0xFFFFFFFFFFFFFFFF)
_HASHES = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U(0x9E37)) | _U(1)


def places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of the units of a run of texts."""
    owner, n = words.text_of(), len(words.hash)
    line = np.cumsum(words.blob == 10)[words.start] if n else np.zeros(0, np.int64)
    cut = np.flatnonzero((np.diff(owner) != 0) | (np.diff(line) != 0)) + 1
    first = np.concatenate(([0], cut))[: max(n, 0)] if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n)) if n else first
    long = size >= WINDOW
    texts_ = np.flatnonzero((words.count >= SHINGLE) & (words.count < WINDOW))
    found = [(first[long], size[long]), (words.first[texts_], words.count[texts_])]
    if n >= WINDOW:
        edge = np.full(ANCHOR, _LAST)
        padded = np.concatenate((edge, mix(words.hash), edge))
        low = np.min(np.lib.stride_tricks.sliding_window_view(padded, 2 * ANCHOR + 1), axis=1)
        left = np.min(np.lib.stride_tricks.sliding_window_view(padded[: n + ANCHOR - 1], ANCHOR), axis=1)
        own = padded[ANCHOR : ANCHOR + n]
        at = np.flatnonzero((own == low) & (own < left))
        at = at[at + WINDOW <= n]
        at = at[owner[at] == owner[at + WINDOW - 1]]
        whole = np.flatnonzero(words.count >= WINDOW)
        ends = unique(np.concatenate((words.first[whole], words.first[whole] + words.count[whole] - WINDOW)))
        # Two windows a few words apart are nearly the same set; the anchor's then stands for both.
        near = np.searchsorted(at, ends + SHINGLE) > np.searchsorted(at, ends - SHINGLE, "right")
        at = np.sort(np.concatenate((at, ends[~near])))
        found.append((at, np.full(len(at), WINDOW)))
    start, size = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    keys = unique((start.astype(np.uint64) << _U(32)) | size.astype(np.uint64))
    return (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)


class Units:
    """The units of a run of texts: text, first word in it, number of words, name, band keys."""

    def __init__(self, raws: list[bytes]):
        words = self.words = Words(raws, SPACED)
        self.place, self.n = places(words)
        self.text = words.text_of()[self.place]
        self.word = self.place - words.first[self.text]
        up, down = powers(len(words.hash) + 1)
        total = np.zeros(len(words.hash) + 1, dtype=np.uint64)
        np.cumsum(mix(words.hash) * up[: len(words.hash)], out=total[1:])
        self.name = mix((total[self.place + self.n] - total[self.place]) * down[self.place] + self.n.astype(np.uint64))
        self.grams = runs(words.hash, SHINGLE) >> _U(32)
        self.keys = np.zeros((len(self.place), BANDS), dtype=np.uint64)
        if not len(self.place):
            return
        k = self.n - SHINGLE + 1
        begin = np.cumsum(k) - k
        value = self.grams[np.repeat(self.place - begin, k) + np.arange(int(k.sum()))]
        for b in range(BANDS):
            key = np.full(len(self.place), b + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(value * _HASHES[b * ROWS + r], begin))
            self.keys[:, b] = key

    def set_of(self, i: int) -> bytes:
        return unique(self.grams[self.place[i] : self.place[i] + self.n[i] - SHINGLE + 1]).astype(np.uint32).tobytes()

    def beside(self, i: int, before: bool) -> bytes:
        """Hashes of up to CONTEXT words of the text beside a unit, the nearest first."""
        t, h = self.text[i], self.words.hash
        if before:
            part = h[max(self.words.first[t], self.place[i] - CONTEXT) : self.place[i]][::-1]
        else:
            part = h[self.place[i] + self.n[i] : min(self.words.first[t + 1], self.place[i] + self.n[i] + CONTEXT)]
        return (part >> _U(32)).astype(np.uint32).tobytes()


def portions(raws: list[bytes]) -> Iterator[tuple[int, Units]]:
    first, size = 0, 0
    for i, raw in enumerate(raws):
        size += len(raw) + 1
        if size >= PIECE or i == len(raws) - 1:
            yield first, Units(raws[first : i + 1])
            first, size = i + 1, 0


def colliding_keys(ids: np.ndarray, raws: list[bytes]) -> np.ndarray:
    found = [unique(u.keys) for _, u in portions(raws)]
    return unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def apart(key: np.ndarray, text: np.ndarray, word: np.ndarray, n: np.ndarray, n_keys: int) -> np.ndarray:
    """For each key: whether units of two texts, or two that don't overlap, have it."""
    bands = key.shape[1]
    flat, text, word, n = key.ravel(), np.repeat(text, bands), np.repeat(word, bands), np.repeat(n, bands)
    order = np.lexsort((word, text, flat))
    flat, text, word, n = flat[order], text[order], word[order], n[order]
    same = flat[1:] == flat[:-1]
    out = np.zeros(n_keys, dtype=bool)
    if not len(flat):
        return out
    out[flat[1:][same & (text[1:] != text[:-1])]] = True
    first = np.flatnonzero(np.concatenate(([True], ~same | (text[1:] != text[:-1]))))
    last = np.append(first[1:], len(flat)) - 1
    out[flat[first][word[last] >= np.minimum.reduceat(word + n, first)]] = True
    return out


_ROWS = pa.schema([("shard", pa.int32()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("word", pa.int32()), ("n", pa.int32()), ("name", pa.int64()), ("mask", pa.int32()), ("grams", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])
_ROWS_SQL = "shard int, doc int, doc_id long, word int, n int, name long, mask int, grams binary, before binary, after binary"
UNIT = ("shard", "doc", "word", "n")


def candidates(shards: DataFrame, layout: Layout) -> DataFrame:
    """The units with a band key that another unit of the corpus has.

    mask: the bands that collide. Of equal units a shard gives the set once. before, after: the
    words beside a run of units that collide in every band, with its first and its last.
    """

    def pick(rows: pa.Table, mark_rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        ids, raws = sorted_docs(rows)
        parts = list(portions(raws))
        text = np.concatenate([u.text + first for first, u in parts])
        word, n, name = (np.concatenate([getattr(u, f) for _, u in parts]) for f in ("word", "n", "name"))
        all_keys = np.concatenate([u.keys for _, u in parts])
        keys, at = np.unique(all_keys, return_inverse=True)
        at = at.reshape(all_keys.shape)
        here = (marked(layout, keys, mark_rows) | apart(at, text, word, n, len(keys)))[at] if len(keys) else np.zeros(at.shape, bool)
        use = np.flatnonzero(here.any(axis=1))
        mask = here[use] @ (1 << np.arange(BANDS))
        once = np.zeros(len(use), dtype=bool)
        once[np.unique(name[use], return_index=True)[1]] = True
        # Runs of units that collide in every band, as equal ones do; in order of text and word.
        full = np.flatnonzero(here[use].all(axis=1))
        line = text[use][full] * (1 << 32)
        begin, end = line + word[use][full], line + word[use][full] + n[use][full]
        reach = np.maximum.accumulate(end) if len(full) else end
        fresh = np.ones(len(full), dtype=bool)
        fresh[1:] = begin[1:] > reach[:-1]
        run = np.cumsum(fresh) - 1
        far = reach[np.flatnonzero(np.append(fresh[1:], True))] if len(full) else reach
        opens, closes = np.zeros((2, len(use)), dtype=bool)
        opens[full[fresh]] = True
        closes[full[end == far[run]]] = True
        edge = np.cumsum([0] + [len(u.place) for _, u in parts])
        owner = np.searchsorted(edge, use, "right") - 1
        grams, before, after = [], [], []
        for i, o, first, a, b in zip(use.tolist(), owner.tolist(), once.tolist(), opens.tolist(), closes.tolist(), strict=True):
            unit, k = parts[o][1], i - int(edge[o])
            grams.append(unit.set_of(k) if first else None)
            before.append(unit.beside(k, True) if a else None)
            after.append(unit.beside(k, False) if b else None)
        columns = [np.full(len(use), shard), text[use], ids[text[use]], word[use], n[use], name[use].view(np.int64), mask, grams, before, after]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)

    return shards.groupBy("shard").cogroup(marks(shards, layout, colliding_keys).groupBy("shard")).applyInArrow(pick, _ROWS_SQL)


_BAND_ROWS = pa.schema([("name", pa.int64()), ("key", pa.int64())])


def band_rows(sets: DataFrame) -> DataFrame:
    """(name, key) of the colliding bands of sets (name, mask, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name, mask, raws = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2).to_pylist()
            size = np.array([len(r) // 4 for r in raws])
            value, begin = np.frombuffer(b"".join(raws), np.uint32).astype(np.uint64), np.cumsum(size) - size
            for b in range(BANDS):
                key = np.full(len(name), b + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(value * _HASHES[b * ROWS + r], begin))
                some = (mask >> b) & 1 > 0
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(key[some].view(np.int64))], schema=_BAND_ROWS)

    return sets.select("name", "mask", "grams").mapInArrow(run, "name long, key long")


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of texts whose shingle sets are similar enough."""
    joined = pairs.join(sets.select(F.col("name").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for c in batch.columns[2:]:
                raws = c.to_pylist()
                sizes = np.array([len(r) // 4 for r in raws])
                sides.append((sizes, np.repeat(np.arange(len(raws)), sizes), np.frombuffer(b"".join(raws), np.uint32)))
            order = np.lexsort((value := np.concatenate([s[2] for s in sides]), row := np.concatenate([s[1] for s in sides])))
            value, row = value[order], row[order]
            twice = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
            both = np.bincount(row[1:][twice], minlength=batch.num_rows)
            good = 100 * both >= percent * (sides[0][0] + sides[1][0] - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], schema=_PAIRS)

    return joined.mapInArrow(test, "a long, b long")


def text_components(found: DataFrame, percent: int) -> DataFrame:
    """(name, component) of the unit texts that are similar to another one."""
    sets = checkpointed(found.filter("grams IS NOT NULL").groupBy("name").agg(F.first("grams").alias("grams"), F.bit_or("mask").alias("mask"), F.first("n").alias("n")))
    bands = band_rows(sets)
    centres = bands.groupBy("key").agg(F.min("name").alias("centre"), F.count("*").alias("members")).filter("members > 1")
    shared = checkpointed(bands.join(centres, "key"))
    size = lambda side: F.octet_length(side)
    star = checkpointed(shared.filter("name <> centre").select(F.least("name", "centre").alias("a"), F.greatest("name", "centre").alias("b")).distinct())
    sized = sets.select("name", size("grams").alias("bytes"))
    # Sets whose sizes alone rule the similarity out needn't meet.
    fit = star.join(sized.select(F.col("name").alias("a"), F.col("bytes").alias("i")), "a").join(sized.select(F.col("name").alias("b"), F.col("bytes").alias("j")), "b")
    star = fit.filter(100 * F.least("i", "j") >= percent * F.greatest("i", "j")).select("a", "b")
    edges = checkpointed(similar(star, sets, percent))
    labels = components(edges)
    open_ = checkpointed(mixed(shared.withColumnRenamed("name", "id"), labels).select(F.col("id").alias("name")).distinct(), F.count(F.lit(1)).alias("n"))
    discard(shared)
    if open_.seen["n"]:
        edges = checkpointed(edges.union(rare_links(sets.join(open_, "name", "left_semi"), labels, percent)))
        labels = components(edges)
    discard(sets)
    return checkpointed(labels.withColumnRenamed("id", "name"), F.count(F.lit(1)).alias("n"))


def rare_links(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join whatever sets (name, grams) are similar and not in one component of labels (id, component) yet.

    The sets that share one of their rarest shingles meet as those of a band did: star-wise, and block by block
    where a shingle's sets then still lie in several components.
    """
    sets = checkpointed(sets.select("name", "grams"))
    first = checkpointed(first_numbers(sets.select(F.col("name").alias("id"), "grams"), percent, np.uint32).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")))
    centres = first.groupBy("key").agg(F.min(F.struct("id", "n", "component")).alias("c"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = checkpointed(first.join(centres.select("key", F.col("c.id").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.component").alias("centre_component"), "members"), "key"))
    fits = (F.col("component") != F.col("centre_component")) & (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n"))
    star = shared.filter(fits).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    edges = checkpointed(similar(star, sets, percent))
    # Components that the new edges join, by what they were called before.
    of = first.select("id", "component").distinct()
    tied = edges.join(of.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(of.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    merged = components(tied.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("now"))
    found = of.join(merged, "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    open_ = checkpointed(mixed(shared.select("key", "id", "centre", "members"), found), F.count(F.lit(1)).alias("n"))
    if not open_.seen["n"]:
        return edges
    members = open_.select("key", F.col("id").alias("name")).join(sets, "name").select(F.col("name").alias("id"), F.col("key").alias("grp"), "grams")
    return edges.union(checkpointed(similar_in_groups(members, percent, np.uint32)).distinct())


_GROWN = pa.schema([("shard", pa.int32()), ("doc", pa.int32()), ("word", pa.int32()), ("n", pa.int32()), ("component", pa.int64())])
_GROWN_SQL = "shard int, doc int, word int, n int, component long"


def agreeing(x: bytes | None, y: bytes | None) -> int:
    """Words in common beside two units, over one changed word if three agree behind it."""
    if not x or not y:
        return 0
    size = min(len(x), len(y)) // 4
    differ = np.flatnonzero(np.frombuffer(x, np.uint32)[:size] != np.frombuffer(y, np.uint32)[:size])
    first, second = (int(differ[i]) if len(differ) > i else size for i in (0, 1))
    return second if second - first > 3 else first


def grown(gone: DataFrame) -> DataFrame:
    """Units (shard, doc, word, n, component, before, after, kept_before, kept_after) made longer by the words in common beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, doc, word, n, component, *sides = (c.to_pylist() for c in batch.columns)
            left = [agreeing(x, y) for x, y in zip(sides[0], sides[2], strict=True)]
            right = [agreeing(x, y) for x, y in zip(sides[1], sides[3], strict=True)]
            columns = [shard, doc, [w - a for w, a in zip(word, left, strict=True)], [k + a + b for k, a, b in zip(n, left, right, strict=True)], component]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GROWN, strict=True)], schema=_GROWN)

    return gone.select(*UNIT, "component", "before", "after", "kept_before", "kept_after").mapInArrow(run, _GROWN_SQL)


def removals(shards: DataFrame, layout: Layout, percent: int) -> DataFrame:
    """(shard, doc, word, n, component): the runs of words that go, with their class."""
    found = checkpointed(candidates(shards, layout))
    labels = text_components(found, percent)
    near = F.broadcast(labels) if labels.seen["n"] <= BROADCAST_IDS else labels
    edge = F.col("before").isNotNull() | F.col("after").isNotNull()
    placed = found.select("doc_id", *UNIT, "name", edge.alias("edge")).join(near, "name", "left").withColumn("component", F.coalesce("component", "name")).drop("name")
    placed = checkpointed(placed, F.count(F.lit(1)).alias("n"))
    kept = placed.groupBy(F.col("component").alias("id")).agg(F.min(F.struct("doc_id", *UNIT)).alias("least"), F.count("*").alias("k")).filter("k > 1")
    kept = checkpointed(kept.select("id", "least", F.col("k").alias("n")))
    joined = looked_up(placed.withColumnRenamed("n", "size"), "component", kept, placed.seen["n"]).filter("least IS NOT NULL")
    same = (F.col("shard") == F.col("least.shard")) & (F.col("doc") == F.col("least.doc"))
    over = same & (F.col("word") < F.col("least.word") + F.col("least.n")) & (F.col("least.word") < F.col("word") + F.col("size"))
    gone = joined.filter(~over).select("shard", "doc", "word", F.col("size").alias("n"), "component", "edge", *[F.col(f"least.{c}").alias(f"kept_{c}") for c in UNIT])
    gone = checkpointed(gone)
    sides = found.filter(edge).select(*UNIT, "before", "after")
    other = sides.select(*[F.col(c).alias(f"kept_{c}") for c in UNIT], F.col("before").alias("kept_before"), F.col("after").alias("kept_after"))
    ends = gone.filter("edge").join(sides, list(UNIT)).join(other, [f"kept_{c}" for c in UNIT], "left")
    return gone.filter("NOT edge").select(*UNIT, "component").unionByName(grown(ends))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64())), ("kept", pa.string())])


def without_repeats(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_removed bytes, n_spans, starts, ends, classes, kept text) of each document."""
    shards, layout = dealt(texts(documents).filter("doc_id IS NOT NULL"))
    gone = removals(shards, layout, percent)

    def cut(rows: pa.Table, spans: pa.Table) -> pa.Table:
        ids, raws = sorted_docs(rows)
        by: dict[int, list[tuple[int, int, int]]] = {}
        for doc, w, n, c in zip(*(spans.column(k).to_pylist() for k in ("doc", "word", "n", "component")), strict=True):
            by.setdefault(doc, []).append((w, n, c))
        out = []
        for i, raw in enumerate(raws):
            starts, ends, kept, at = [], [], [], 0
            own = sorted(by.get(i, []))
            words = Words([raw], SPACED) if own else None
            for w, n, _ in own:
                s, e = int(words.start[w]), int(words.end[w + n - 1])
                if ends and s <= ends[-1]:
                    ends[-1] = max(ends[-1], e)
                else:
                    starts.append(s)
                    ends.append(e)
            for s, e in zip(starts, ends, strict=True):
                kept.append(raw[at:s])
                at = e
            kept.append(raw[at:])
            out.append((int(ids[i]), sum(ends) - sum(starts), len(starts), starts, ends, sorted({c for _, _, c in own}), b"".join(kept).decode("utf-8", "replace")))
        return pa.table([pa.array([r[k] for r in out], t.type) for k, t in enumerate(_KEPT)], schema=_KEPT)

    return shards.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(cut, "doc_id long, n_removed long, n_spans long, starts array<long>, ends array<long>, classes array<long>, kept string")


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_removed", "n_spans", "classes", F.sha2("kept", 256).alias("kept_sha256"))

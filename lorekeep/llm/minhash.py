"""MinHash near-dedup of whole documents.

Method. A document's set is its distinct word shingles as 64-bit hashes. One permutation is
hashed into BINS bins, each keeping its least value; an empty bin borrows from a
non-empty one by optimal densification (a hash of bin and attempt picks the lender). ROWS bins
make a band; documents that agree on a band share a bucket. Equal sets are first folded into
one representative, whatever their number. Each bucket then offers star-shaped edges, centre to
member, with its smallest id as centre, so that a group's buckets mostly offer the same edges;
the edges are confirmed on the full sets.
After components of the confirmed edges, the buckets whose members still lie in several
components are gathered into groups, and all pairs of a group are compared block by block: so
every colliding pair is either tested or already joined, while a bucket that its star joins
costs no more than that.

A band takes as many ROWS as keep the chance that a pair at the threshold shares no bucket below
MISSED: 36 bands of 8 at a similarity of 0.85 (1e-5), 48 of 6 at 0.80 (5e-7); exact copies always
share one. Defined results: null or wordless text has an empty set, is linked with nothing and
kept; a text of fewer words than a shingle has its whole sequence as one; rows of one doc_id are
one document, linked by any of its texts, and each gives a row; rows with a null doc_id are left
out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_IDS, checkpointed, discard, only, pieces, texts
from .blocks import similar_inside
from .graph import components
from .words import SPACED, Words, distinct, mix, shingles

BINS = 288
MISSED = 2e-5
#: Lenders tried by hash before an empty bin takes from the next non-empty bin to its right.
ATTEMPTS = 192
SALTS = 32
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_LENDER = (mix(np.arange(ATTEMPTS * BINS, dtype=np.uint64) + _U(99)) % _U(BINS)).astype(np.int64).reshape(ATTEMPTS, BINS)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row; rows without any value stay empty."""
    full = bins != _EMPTY
    row, col = np.nonzero(~full & full.any(axis=1, keepdims=True))
    for lender in _LENDER:
        if not len(row):
            return bins
        source = lender[col]
        ready = full[row, source]
        bins[row[ready], col[ready]] = bins[row[ready], source[ready]]
        row, col = row[~ready], col[~ready]
    for k in range(1, bins.shape[1]):
        if not len(row):
            break
        source = (col + k) % bins.shape[1]
        ready = full[row, source]
        bins[row[ready], col[ready]] = mix(bins[row[ready], source[ready]] + _U(k))
        row, col = row[~ready], col[~ready]
    return bins


def band_rows(percent: int) -> int:
    """Bins to a band: the most for which a pair at the threshold is missed at most MISSED times."""
    fits = [r for r in range(1, 33) if BINS % r == 0 and (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED]
    if not fits:
        raise ValueError(f"{BINS} bins find no pairs at a similarity of {percent} percent")
    return max(fits)


def band_keys(bins: np.ndarray, rows: int) -> np.ndarray:
    """A key for each text and band of so many bins."""
    bands = BINS // rows
    grouped = bins.reshape(len(bins), bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(bins), 1))
    for r in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return key


def profile_texts(raws: list[bytes], n: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text: size of its set, two sums that name the set, band keys."""
    text, value = shingles(Words(raws, SPACED), n)
    hashed = mix(value)
    slot = text * BINS + ((hashed >> _U(40)) % _U(BINS)).astype(np.int64)
    order = np.lexsort((hashed, slot))
    slot, hashed = slot[order], hashed[order]
    new = np.ones(len(slot), dtype=bool)
    new[1:] = (slot[1:] != slot[:-1]) | (hashed[1:] != hashed[:-1])
    slot, hashed = slot[new], hashed[new]
    owner = slot // BINS
    size = np.bincount(owner, minlength=len(raws))
    least = np.ones(len(slot), dtype=bool)
    least[1:] = slot[1:] != slot[:-1]
    bins = np.full(len(raws) * BINS, _EMPTY)
    bins[slot[least]] = hashed[least]
    sums = np.zeros((2, len(raws)), dtype=np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        at = np.searchsorted(owner, some)
        sums[0, some] = np.add.reduceat(mix(hashed + _U(1)), at)
        sums[1, some] = np.add.reduceat(mix(hashed ^ _U(0xA5A5A5A5A5A5A5A5)), at)
    return size, sums[0], sums[1], band_keys(densify(bins.reshape(len(raws), BINS)), rows)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def profiles(docs: DataFrame, n: int, rows: int) -> DataFrame:
    bands = BINS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, raws in pieces(batch):
                size, s1, s2, keys = profile_texts(raws, n, rows)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(raws) * bands + 1, bands), pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([ids[first : first + len(raws)], pa.array(size.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), listed], schema=_PROFILE)

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


_SETS = pa.schema([("id", pa.int64()), ("grams", pa.binary())])


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, grams): the sorted distinct shingle hashes of each document, one row for each of its different sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raws in pieces(batch):
                text, value = distinct(*shingles(Words(raws, SPACED), n))
                parts = np.split(value, np.searchsorted(text, np.arange(1, len(raws))))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(raws)], pa.array([p.tobytes() for p in parts], pa.binary())], schema=_SETS)

    return docs.mapInArrow(run, "id long, grams binary").dropDuplicates(["id", "grams"])


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    ids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), F.count(F.lit(1)).alias("n"))
    sets = checkpointed(shingle_sets(only(docs, ids, ids.seen["n"]), n))
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], schema=_PAIRS)

    return joined.mapInArrow(test, "a long, b long")


def mixed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, centre) of the buckets (key, id, centre, members) whose members lie in several components."""
    grouped = shared.filter("members > 2").join(found, "id", "left").select("key", "id", "centre", F.coalesce("component", "id").alias("component"))
    several = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    return grouped.join(several, "key").select("key", "id", "centre")


def unresolved(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (a, b) from the centre to each member of the mixed buckets."""
    return mixed(shared, found).filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()


def near_groups(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document: linked from percent similarity on."""
    docs = texts(documents).filter("doc_id IS NOT NULL")
    named = ["n", "s1", "s2"]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    profiled = checkpointed(profiles(docs, n, band_rows(percent)).withColumn("salt", salt))
    some = profiled.filter("n > 0")
    dealt = some.groupBy(*named, "salt").agg(F.min("doc_id").alias("least"))
    rep = dealt.groupBy(*named).agg(F.min("least").alias("rep"))
    dealt = dealt.join(rep, named).select(*named, "salt", "rep")
    folded = some.join(dealt, [*named, "salt"])
    folded = checkpointed(folded.select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("keys")).alias("keys")))
    # The texts of one doc_id hang together: each is tied to the representative of its set.
    several = some.groupBy("doc_id").agg(F.min(F.struct(*named)).alias("x"), F.max(F.struct(*named)).alias("y")).filter("x <> y").select("doc_id")
    own = folded.select("doc_id", "rep").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()

    bands = folded.filter("keys IS NOT NULL").select(F.col("rep").alias("id"), "n", F.explode("keys").alias("key"))
    centres = bands.groupBy("key").agg(F.min("id").alias("centre"), F.min_by("n", "id").alias("centre_n"), F.count("*").alias("members")).filter("members > 1")
    shared = checkpointed(bands.join(centres, "key"))
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    star = shared.filter((F.col("id") != F.col("centre")) & fits(F.col("n"), F.col("centre_n")))
    star = checkpointed(star.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
    edges = checkpointed(confirmed(star, docs, n, percent).union(own))
    found = components(edges)

    open_ = checkpointed(unresolved(shared, found), F.count(F.lit(1)).alias("n"))
    discard(shared, star)
    if open_.seen["n"]:
        groups = components(open_).withColumnRenamed("component", "grp")
        ids = checkpointed(groups, F.count(F.lit(1)).alias("n"))
        sets = shingle_sets(only(docs, ids, ids.seen["n"]), n)
        more = checkpointed(similar_inside(ids.join(sets, "id"), percent))
        found = components(edges.union(more))

    # Both sides are plain tables dealt by representative, so that a hot one is split at run time.
    linked = folded.join(found.withColumnRenamed("id", "rep"), "rep", "left")
    linked = linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    alone = profiled.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def without_near_copies(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """The documents, with all their columns, less all but one of each group that near_groups() finds.

    Here a document is a doc_id with a text: other texts of a doc_id, and texts without one, are judged
    by themselves, and of rows with equal doc_id and text one stays. Of a group the least doc_id stays; those
    that several texts share, or that are null, come after all others.
    """
    ids = documents.groupBy(F.col("doc_id").cast("long").alias("odd_id")).agg(F.count(F.lit(1)).alias("n"))
    odd = checkpointed(ids.filter("n > 1 OR odd_id IS NULL").select("odd_id"), F.count(F.lit(1)).alias("n"))
    if not odd.seen["n"]:
        gone = near_groups(documents, n, percent).filter("NOT kept").select(F.col("doc_id").alias("gone_id"))
        return documents.join(gone, documents["doc_id"] == gone["gone_id"], "left_anti")
    side = F.broadcast(odd) if odd.seen["n"] <= BROADCAST_IDS else odd
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("odd_id"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    own = rows.join(side, same, "left_anti").withColumn("own_id", F.col("row.doc_id").cast("long"))
    # An id of their own in the upper half of the positive numbers, by what they hold; equal rows meet by it.
    name = F.xxhash64("row.doc_id", "row.text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    shared = rows.join(side, same, "left_semi").withColumn("own_id", name)
    first = shared.groupBy("own_id", F.col("row.text").alias("of_text"), F.col("row.doc_id").alias("of_id")).agg(F.min("row").alias("row"))
    every = own.unionByName(checkpointed(first.select("row", "own_id")))
    gone = near_groups(every.select(F.col("own_id").alias("doc_id"), F.col("row.text").alias("text")), n, percent).filter("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return every.join(gone, F.col("own_id") == F.col("gone_id"), "left_anti").select("row.*")

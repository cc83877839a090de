"""Embedding near-dedup by NN-descent.

Method. Equal vectors of a label are folded into one. The neighbour graph starts from sorted
codes: in each of some tables, vectors are sorted by label and by the signs of their random
projections, and neighbours in that order whose cosine reaches FLOOR enter each other's lists.
Then lists are refined through neighbours of neighbours: two vectors that stand in one vector's
list are compared if they weren't yet. A list holds LIST neighbours and is doubled in the next
round where it is saturated, that is, full of neighbours above the threshold. Each label is
audited by brute force: a sample that grows until SEEN of its vectors have a link is held against
the label, and recall is the share of these that lost no link. Labels below WANTED get further
tables, rounds and longer lists; those that still fail after TRIES, and those whose links are too
rare for a sample, are compared pair by pair, block by block, so no shortfall is passed on.
The edges at or above the threshold give components. As every link lies inside a component,
links are then counted block by block of members, so that no pairs are emitted and the links
inside a component are complete whatever the lists held.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or
whose label is null, link with nothing; vectors of different length never link; a repeated
vec_id counts once (the least row); null ids are left out; other columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import BROADCAST_IDS, checkpointed
from .blocks import forest, in_blocks
from .graph import components

FLOOR = 0.9
WINDOW = 8
LIST = 8
ROUNDS = 2
AUDIT = 200
#: An audit counts once so many of the asked vectors have a link; until then it asks GROW times as many.
SEEN, GROW = 100, 4
WANTED = 0.97
TRIES = 3
#: Vectors of a block where a label is held against samples.
SIDE = 2048
SALTS = 16
_U = np.uint64
log = logging.getLogger(__name__)


_UNITS = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.float64()))])


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of rows: usable vectors at unit length; the label tells the length of the vector too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            use = np.flatnonzero((size > 0) & np.asarray(pc.is_valid(batch.column(1))))
            lists, size = lists.take(pa.array(use)), size[use]
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                m = np.asarray(pc.fill_null(lists.take(pa.array(own)).flatten(), float("nan")), dtype=np.float64).reshape(-1, d)
                largest = np.abs(m).max(axis=1)
                good = np.isfinite(largest) & (largest > 0)
                m = m[good] / largest[good, None]
                m /= np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
                take = pa.array(use[own[good]])
                labels = pa.array([f"{d}:{x}" for x in batch.column(1).take(take).to_pylist()], pa.string())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, d), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), labels, vectors], schema=_UNITS)

    return rows.mapInArrow(run, "vec_id long, label string, v array<double>")


def usable(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every vec_id once, the usable vectors: vec_id, label, v at unit length). Of a repeated id the least row counts."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL")
    ids = checkpointed(rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")), F.count_if(F.col("n") > 1).alias("repeated"))
    # Ids alone are counted; only the rows of repeated ones are compared as wholes.
    again = ids.filter("n > 1").select(F.col("vec_id").alias("again_id"))
    again = F.broadcast(again) if ids.seen["repeated"] <= BROADCAST_IDS else again
    once = rows.join(again, F.col("vec_id") == F.col("again_id"), "left_anti")
    least = rows.join(again, F.col("vec_id") == F.col("again_id"), "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")
    return ids.select("vec_id"), unit_vectors(once.unionByName(least))


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten()).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def by_dimension(batch: pa.RecordBatch, vectors: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length in the batch."""
    size = np.asarray(batch.column(vectors).value_lengths())
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, matrix(batch.column(vectors).take(pa.array(rows)))


_CODES = pa.schema([("place", pa.int32()), ("label", pa.string()), ("code", pa.int64()), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cos", pa.float64())])
_ASKED = pa.schema([("label", pa.string()), ("id", pa.int64()), ("lost", pa.bool_())])


def sorted_candidates(vectors: DataFrame, tables: range) -> DataFrame:
    """(a, b, cos) of neighbours in sorted code order whose cosine is FLOOR at least."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, m in by_dimension(batch, 2):
                take = pa.array(rows)
                for t in tables:
                    planes = np.random.default_rng([t, m.shape[1]]).standard_normal((m.shape[1], 62))
                    bits = (m @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(61, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), batch.column(1).take(take), pa.array(bits), batch.column(0).take(take), batch.column(2).take(take)], schema=_CODES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            whole = pa.Table.from_batches([batch.slice(0, batch.num_rows)] if tail is None else [tail, batch]).combine_chunks().to_batches()
            if not whole:
                continue
            whole = whole[0]
            fresh = whole.num_rows - batch.num_rows
            place, label, ids = np.asarray(whole.column(0)), np.asarray(whole.column(1).dictionary_encode().indices), np.asarray(whole.column(3))
            size = np.asarray(whole.column(4).value_lengths())
            out: list[tuple] = []
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                m = matrix(whole.column(4).take(pa.array(rows)))
                for lag in range(1, WINDOW + 1):
                    if len(rows) > lag:
                        cos = np.einsum("ij,ij->i", m[lag:], m[:-lag])
                        x, y = rows[lag:], rows[:-lag]
                        good = (cos >= FLOOR) & (place[x] == place[y]) & (label[x] == label[y]) & (x >= fresh) & (ids[x] != ids[y])
                        out.append((ids[x[good]], ids[y[good]], cos[good]))
            tail = whole.slice(max(0, whole.num_rows - WINDOW))
            if out:
                x, y, c = (np.concatenate(p) for p in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(c)], schema=_EDGES)

    coded = vectors.select("id", "label", "v").mapInArrow(code, "place int, label string, code long, id long, v array<double>")
    ordered = coded.repartitionByRange("place", "label", "code", "id").sortWithinPartitions("place", "label", "code", "id")
    return ordered.mapInArrow(compare, "a long, b long, cos double").groupBy("a", "b").agg(F.max("cos").alias("cos"))


def cosines(pairs: DataFrame) -> DataFrame:
    """(a, b, cos) of pairs (a, b, x, y) of unit vectors whose cosine is FLOOR at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in by_dimension(batch, 2):
                take = pa.array(rows)
                cos = np.einsum("ij,ij->i", x, matrix(batch.column(3).take(take)))
                good = pa.array(cos >= FLOOR)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take).filter(good), batch.column(1).take(take).filter(good), pa.array(cos[cos >= FLOOR])], schema=_EDGES)

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, cos double")


def refined(edges: DataFrame, vectors: DataFrame, threshold: float, size: int) -> DataFrame:
    """edges and those that neighbours of neighbours add; a saturated list counts twice as many."""
    both = edges.select(F.col("a").alias("w"), F.col("b").alias("u"), "cos").union(edges.select(F.col("b").alias("w"), F.col("a").alias("u"), "cos"))
    own = Window.partitionBy("w")
    both = both.withColumn("strong", F.count_if(F.col("cos") >= threshold).over(own)).withColumn("r", F.row_number().over(own.orderBy(F.desc("cos"), "u")))
    lists = both.filter(F.col("r") <= F.when(F.col("strong") >= size, 2 * size).otherwise(size)).select("w", "u")
    pairs = lists.join(lists.select("w", F.col("u").alias("b")), "w").filter("u < b").select(F.col("u").alias("a"), "b").distinct()
    pairs = pairs.join(edges, ["a", "b"], "left_anti")
    left = vectors.select(F.col("id").alias("a"), F.col("v").alias("x"))
    right = vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    return edges.unionByName(cosines(pairs.join(left, "a").join(right, "b")))


def audited(vectors: DataFrame, component: DataFrame, threshold: float) -> DataFrame:
    """(label, verdict) of each label of vectors: holds, fails, or rare where a sample shows too few links.

    A label's sample starts at AUDIT vectors and grows until SEEN of them have a link, each being
    compared with the whole label. A label that is asked whole must miss nothing; one of which half
    or more would have to be asked is rare.
    """
    placed = vectors.join(component, "id", "left").select("id", "label", "v", F.coalesce("component", "id").alias("component"))
    sizes = checkpointed(vectors.groupBy("label").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / SIDE).cast("int")))
    placed = checkpointed(placed.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 40)) / float(1 << 40)

    def search(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], f.type) for f in _ASKED], schema=_ASKED)
        asked, held = asked.combine_chunks(), held.combine_chunks()
        x, y = (t.column("id").to_numpy() for t in (asked, held))
        hit = (matrix(asked.column("v").chunk(0)) @ matrix(held.column("v").chunk(0)).T >= threshold) & (x[:, None] != y[None, :])
        lost = hit & (asked.column("component").to_numpy()[:, None] != held.column("component").to_numpy()[None, :])
        some = hit.any(axis=1)
        return pa.table([pa.array([key[0].as_py()] * int(some.sum()), pa.string()), pa.array(x[some]), pa.array(lost.any(axis=1)[some])], schema=_ASKED)

    open_, done, k = sizes, None, AUDIT
    while True:
        asked = placed.join(open_.select("label"), "label", "left_semi").filter(share < k / F.col("n"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = placed.join(open_.select("label"), "label", "left_semi")
        asked, held = (t.select(*[F.col(c).alias(c) for c in ("label", "block", "id", "v", "component")]) for t in (asked, held))
        linked = asked.groupBy("label", "block").cogroup(held.groupBy("label", "block")).applyInArrow(search, "label string, id long, lost boolean")
        linked = linked.groupBy("label", "id").agg(F.max("lost").alias("lost")).groupBy("label").agg(F.count("*").alias("seen"), F.count_if("lost").alias("lost"))
        told = open_.join(linked, "label", "left").fillna(0, ["seen", "lost"])
        few = (F.col("seen") < SEEN) & (F.col("n") > k)
        good = F.when(F.col("n") <= k, F.col("lost") == 0).otherwise(F.col("lost") <= (1 - WANTED) * F.col("seen"))
        verdict = F.when(few & (F.col("n") <= 2 * GROW * k), "rare").when(few, "open").when(good, "holds").otherwise("fails")
        told = checkpointed(told.withColumn("verdict", verdict).select("label", "n", "blocks", "verdict"))
        part = told.filter("verdict <> 'open'").select("label", "verdict")
        done = part if done is None else done.unionByName(part)
        open_ = told.filter("verdict = 'open'").drop("verdict")
        if not open_.limit(1).count():
            return checkpointed(done)
        k *= GROW


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def compared(vectors: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that span the linked vectors of each label: every pair is compared, block by block."""
    sent = in_blocks(vectors, "label", 8 * F.size("v")).select("label", "p", "q", "block", "id", "v")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        block, ids = rows.column("block").to_numpy(), rows.column("id").to_numpy()
        m = matrix(rows.column("v").chunk(0))
        x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
        hit = m[x] @ m[y].T >= threshold
        i, j = np.nonzero(np.triu(hit, 1) if p == q else hit)
        i, j = x[i], y[j]
        kept = forest(len(ids), i, j)
        a, b = ids[i[kept]], ids[j[kept]]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_PAIRS)

    return sent.groupBy("label", "p", "q").applyInArrow(compare, "a long, b long")


_COUNTS = pa.schema([("id", pa.int64()), ("links", pa.int64())])


def links_inside(members: DataFrame, threshold: float) -> DataFrame:
    """(id, links): for members (id, component, size, v), the vectors of other representatives linked directly.

    A component is cut into blocks; each pair of blocks is compared in one matrix product.
    """
    sent = in_blocks(members, "component", 8 * F.size("v")).select("component", "p", "q", "block", "id", "size", "v")

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        block, ids, size = (rows.column(c).to_numpy() for c in ("block", "id", "size"))
        m = matrix(rows.column("v").chunk(0))
        x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
        hit = m[x] @ m[y].T >= threshold
        if p == q:
            np.fill_diagonal(hit, False)
            out = [(ids[x], hit @ size[y])]
        else:
            out = [(ids[x], hit @ size[y]), (ids[y], hit.T @ size[x])]
        return pa.table([pa.array(np.concatenate([i for i, _ in out])), pa.array(np.concatenate([c for _, c in out]).astype(np.int64))], schema=_COUNTS)

    return sent.groupBy("component", "p", "q").applyInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector."""
    every, good = usable(embeddings)
    name = ["label", "h1", "h2"]
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")
    good = checkpointed(good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64("v", F.lit(9)), "salt": salt}))
    dealt = good.groupBy(*name, "salt").agg(F.min("vec_id").alias("least"), F.count("*").alias("k"))
    rep = dealt.groupBy(*name).agg(F.min("least").alias("rep"), F.sum("k").alias("size"))
    dealt = dealt.join(rep, name).select(*name, "salt", "rep", "size")
    folded = checkpointed(good.join(dealt, [*name, "salt"]).select("vec_id", "rep", "size", "label", F.when(F.col("vec_id") == F.col("rep"), F.col("v")).alias("v")))
    vectors = checkpointed(folded.filter("vec_id = rep").select(F.col("rep").alias("id"), "label", "size", "v"))

    edges, exact, open_, found = None, None, vectors, None
    for attempt in range(TRIES):
        largest = open_.groupBy("label").count().agg(F.max("count").alias("n")).first()["n"] or 1
        bits = max(4.0, math.log2(largest / WINDOW)) if largest > WINDOW else 4.0
        agree = (1 - math.acos(threshold) / math.pi) ** bits
        tables = max(6, math.ceil(math.log(0.005) / math.log(1 - agree)))
        more = sorted_candidates(open_, range(attempt << 16, (attempt << 16) + tables))
        edges = checkpointed(more if edges is None else edges.unionByName(more).groupBy("a", "b").agg(F.max("cos").alias("cos")))
        size = LIST << attempt
        for _ in range(ROUNDS + attempt):
            before = edges.count()
            edges = checkpointed(refined(edges, vectors, threshold, size))
            size *= 2
            if edges.count() <= 1.001 * before:
                break
        found = components(edges.filter(F.col("cos") >= threshold).select("a", "b"))
        verdicts = audited(open_, found, threshold)
        told = {r["verdict"]: r["count"] for r in verdicts.groupBy("verdict").count().collect()}
        log.info("neighbour graph: labels by audit after try %d: %s", attempt + 1, told)
        # Links too rare to be audited by a sample, and recall that stays low, leave it to every pair.
        whole = verdicts.filter("verdict = 'rare'" if attempt + 1 < TRIES else "verdict <> 'holds'").select("label")
        if told.get("rare") or (attempt + 1 == TRIES and told.get("fails")):
            part = checkpointed(compared(open_.join(whole, "label", "left_semi"), threshold))
            exact = part if exact is None else exact.unionByName(part)
        if not told.get("fails"):
            break
        open_ = checkpointed(open_.join(verdicts.filter("verdict = 'fails'"), "label", "left_semi"))
    if exact is not None:
        found = components(edges.filter(F.col("cos") >= threshold).select("a", "b").unionByName(exact))

    links = links_inside(found.join(vectors, "id").select("id", "component", "size", "v"), threshold)
    classes = found.join(links, "id", "left").select(F.col("id").alias("rep"), "component", "links")
    out = folded.join(classes, "rep", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = every.join(folded.select("vec_id"), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))

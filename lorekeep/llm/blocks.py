"""All similar pairs inside groups, compared block by block and told as spanning forests.

A group's members are dealt to blocks of bounded size; each pair of blocks is one task's work,
whose intersections are matrix products over the shingles that two members at least share. Only
the edges that join what isn't joined yet within the pair of blocks come out, fewer than its
members, so the output grows with the members however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import unique

#: Members of a block, and bytes of their sets; a pair of blocks is one task's work, and a member is sent once for each block of its group.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
_COLUMNS = 2048
#: A number that one in so many pairs of sets share is worth a column of a matrix; pairs listed at once.
_DENSE, _LISTED = 150, 1 << 22
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of two lists of sets of numbers.

    Numbers that many sets hold are counted by matrix products; those of few sets, most of them, by
    listing the pairs of sets that share one.
    """
    shape = (len(left), len(right))
    out = np.zeros(shape)
    value = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (left, right)]
    owner = [np.repeat(np.arange(len(s)), list(map(len, s))) for s in (left, right)]
    common = np.intersect1d(unique(value[0]), unique(value[1]), assume_unique=True)
    if not len(common):
        return out
    at, held = [], []
    for i in (0, 1):
        place = np.minimum(np.searchsorted(common, value[i]), len(common) - 1)
        good = common[place] == value[i]
        place, own = place[good], owner[i][good]
        order = np.argsort(place, kind="stable")
        at.append(place[order])
        held.append(own[order])
    count = [np.bincount(p, minlength=len(common)) for p in at]
    often = _DENSE * count[0] * count[1] >= shape[0] * shape[1]

    column = np.cumsum(often) - 1
    dense = [(column[p[often[p]]], h[often[p]]) for p, h in zip(at, held, strict=True)]
    for first in range(0, int(often.sum()), _COLUMNS):
        m = []
        for (c, h), n in zip(dense, shape, strict=True):
            x, y = np.searchsorted(c, [first, first + _COLUMNS])
            m.append(np.zeros((n, min(_COLUMNS, int(often.sum()) - first)), dtype=np.float32))
            m[-1][h[x:y], c[x:y] - first] = 1
        out += m[0] @ m[1].T

    # Each entry on the left meets the entries on the right that have its number.
    few = ~often[at[0]]
    number, row = at[0][few], held[0][few]
    begin, size = (np.cumsum(count[1]) - count[1])[number], count[1][number]
    upto = np.cumsum(size)
    total, first = np.zeros(shape[0] * shape[1]), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + _LISTED, "right")))
        k = size[first:last]
        inside = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        pair = np.repeat(row[first:last], k) * shape[1] + held[1][np.repeat(begin[first:last], k) + inside]
        total += np.bincount(pair, minlength=len(total))
        first = last
    return out + total.reshape(shape)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Which of the edges (x, y) over n nodes join two parts, taken in order."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        i, j = root(i), root(j)
        if i != j:
            parent[j] = i
            kept.append(k)
    return kept


def in_blocks(members: DataFrame, group: str, size: Column) -> DataFrame:
    """members with a block each and a row for every pair of blocks (p, q) of their group that theirs is in; size: the bytes of one.

    Only groups of several blocks are looked up, one in BLOCK members or in BLOCK_BYTES, from a
    broadcast table; so members never meet by their group alone, however many one group holds.
    """
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(size) / BLOCK_BYTES)).cast("int")
    large = members.groupBy(F.col(group).alias("of_group")).agg(blocks.alias("blocks")).filter("blocks > 1")
    placed = members.join(F.broadcast(large), F.col(group) == F.col("of_group"), "left").drop("of_group").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("blocks", "other")


def similar_inside(members: DataFrame, percent: int, kind: type = np.uint64) -> DataFrame:
    """Edges (a, b) that span the similar members (id, grp, grams: a set of numbers of a kind) of each group."""
    sent = in_blocks(members, "grp", F.octet_length("grams")).select("grp", "p", "q", "block", "id", "grams")

    def compare(rows: pa.Table) -> pa.Table:
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        block, ids = rows.column("block").to_numpy(), rows.column("id").to_numpy()
        sets = [np.frombuffer(g.as_buffer(), kind) for c in rows.column("grams").chunks for g in c]
        x, y = np.flatnonzero(block == p), np.flatnonzero(block == q)
        both = intersections([sets[i] for i in x], [sets[j] for j in y])
        size = np.array([len(s) for s in sets], dtype=float)
        hit = (100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)) & (both > 0)
        i, j = np.nonzero(hit)
        i, j = x[i], y[j]
        kept = forest(len(sets), i, j)
        a, b = ids[i[kept]], ids[j[kept]]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_EDGES)

    return sent.groupBy("grp", "p", "q").applyInArrow(compare, "a long, b long")


#: Members up to which groups are compared many at once.
SMALL = 64


def similar_rows(group: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: the rows of one group each whose sets are similar; rows are in the order of their groups."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    value, owner = np.concatenate(sets) if n else np.zeros(0, np.uint64), np.repeat(np.arange(n), size)
    order = np.lexsort((owner, value, group[owner]))
    value, owner = value[order], owner[order]
    # Each entry meets the later ones of its group and number.
    last = np.concatenate(((value[1:] != value[:-1]) | (group[owner[1:]] != group[owner[:-1]]), [True])) if len(value) else np.zeros(0, bool)
    ends = np.flatnonzero(last)
    after = ends[np.searchsorted(ends, np.arange(len(value)))] - np.arange(len(value))
    inside = np.arange(int(after.sum())) - np.repeat(np.cumsum(after) - after, after)
    first = np.repeat(np.arange(len(value)), after)
    code, both = np.unique(owner[first] * np.int64(n) + owner[first + 1 + inside], return_counts=True)
    i, j = code // max(1, n), code % max(1, n)
    good = 100 * both >= percent * (size[i] + size[j] - both)
    return i[good], j[good]


def similar_in_groups(members: DataFrame, percent: int, kind: type = np.uint64) -> DataFrame:
    """similar_inside() for many groups of few members: a task takes them as they come, many at once."""
    sent = in_blocks(members, "grp", F.octet_length("grams")).select("grp", "p", "q", "block", "id", "grams")
    sent = sent.repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "id")

    def edges(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        name = np.stack([rows.column(c).to_numpy() for c in ("grp", "p", "q")])
        block, ids = rows.column("block").to_numpy(), rows.column("id").to_numpy()
        sets = [np.frombuffer(g.as_buffer(), kind) for c in rows.column("grams").chunks for g in c]
        cut = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1
        begin = np.concatenate(([0], cut)).astype(np.int64)
        count = np.diff(np.append(begin, len(ids)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        few = np.flatnonzero((count > 1) & (count <= SMALL) & (name[1][begin] == name[2][begin]))
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(count[few] ** 2) // (1 << 14))) + 1):
            at = np.repeat(begin[part] - (np.cumsum(count[part]) - count[part]), count[part]) + np.arange(int(count[part].sum()))
            i, j = similar_rows(np.repeat(np.arange(len(part)), count[part]), [sets[x] for x in at.tolist()], percent)
            found.append((at[i], at[j]))
        for b, n in zip(begin.tolist(), count.tolist(), strict=True):
            p, q = name[1][b], name[2][b]
            if n > 1 and (n > SMALL or p != q):
                x, y = (np.flatnonzero(block[b : b + n] == k) + b for k in (p, q))
                both = intersections([sets[k] for k in x], [sets[k] for k in y])
                size = np.array([len(s) for s in sets[b : b + n]], dtype=float)
                i, j = np.nonzero((100 * both >= percent * (size[x - b][:, None] + size[y - b][None, :] - both)) & (both > 0))
                found.append((x[i], y[j]))
        i, j = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (zip(*found, strict=True) if found else ([], [])))
        kept = forest(len(ids), i, j)
        a, b = ids[i[kept]], ids[j[kept]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_EDGES)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            name = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            end = np.flatnonzero((name != name[:, -1:]).any(axis=0))
            if len(end):  # the last group may go on in the next batch
                yield edges(pa.Table.from_batches([*held[:-1], batch.slice(0, end[-1] + 1)]))
                held = [batch.slice(end[-1] + 1)]
        if held:
            yield edges(pa.Table.from_batches(held))

    return sent.mapInArrow(compare, "a long, b long")

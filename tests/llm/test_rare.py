"""Links by rarest numbers and block comparisons against brute force."""

import itertools
import random

import numpy as np
import pytest

pytest.importorskip("lorekeep.llm")

from lorekeep.llm import blocks, passages, prefix  # noqa: E402
from lorekeep.llm.graph import components  # noqa: E402


def classes(edges, ids):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [2048, 3])
def test_rare_links_find_every_similar_pair(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    r = random.Random(5)
    base = [set(r.sample(range(4000), 20)) | {1, 2, 3} for _ in range(25)]
    sets = {}
    for i in range(150):
        s = set(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            s.discard(r.choice(sorted(s)))
            s.add(r.randrange(4000))
        sets[i] = frozenset(s)
    sets = {k: v for k, v in zip(range(-20, 1000), dict.fromkeys(sets.values()), strict=False)}
    sets[2000], sets[2001] = frozenset({7}), frozenset({8})
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 50
    rows = [(k, np.array(sorted(v), np.uint32).tobytes()) for k, v in sets.items()]
    table = spark.createDataFrame(rows, "name long, grams binary").repartition(4)
    none = spark.createDataFrame([], "id long, component long")
    edges = [(x["a"], x["b"]) for x in passages.rare_links(table, none, 80).collect()]
    assert set(map(tuple, map(sorted, edges))) <= set(map(tuple, map(sorted, linked)))
    assert classes(edges, sets) == classes(linked, sets)
    # What is joined already isn't told again, but what is not still is.
    some = components(spark.createDataFrame(linked[::2], "a long, b long"))
    more = [(x["a"], x["b"]) for x in passages.rare_links(table, some, 80).collect()]
    assert classes([*linked[::2], *more], sets) == classes(linked, sets)
    assert passages.rare_links(table.limit(0), none, 80).count() == 0


def test_rarest_numbers_are_a_prefix_that_similar_sets_share(spark):
    r = random.Random(1)
    sets = {i: np.array(sorted(r.sample(range(60), r.randrange(1, 30))), np.uint32) for i in range(80)}
    rows = prefix.first_numbers(spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, grams binary"), 80, np.uint32).collect()
    held = {}
    for x in rows:
        held.setdefault(x["id"], set()).add(x["key"])
        assert x["n"] == len(sets[x["id"]])
    for a, b in itertools.combinations(sets, 2):
        x, y = set(sets[a].tolist()), set(sets[b].tolist())
        if 100 * len(x & y) >= 80 * len(x | y):
            assert held[a] & held[b]


@pytest.mark.parametrize("dense", [0, 150, 10**9])
def test_intersections(monkeypatch, dense):
    monkeypatch.setattr(blocks, "_DENSE", dense)
    monkeypatch.setattr(blocks, "_LISTED", 7)
    r = np.random.default_rng(0)
    for n, m, k, pool in ((5, 7, 4, 10), (60, 50, 30, 100), (0, 3, 5, 10), (40, 1, 20, 40)):
        left, right = ([np.unique(r.integers(0, p, k)).astype(np.uint64) for _ in range(c)] for c, p in ((n, pool), (m, 2 * pool)))
        want = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left]).reshape(n, m)
        assert (blocks.intersections(left, right) == want).all()

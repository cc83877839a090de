"""Context of formation, builds by batches, vector search in tasks, quantiles, hashed embeddings."""

import hashlib
import math
import random
import re
from functools import reduce

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import vectors as vx
from lorekeep.functions.visibility import resolve
from lorekeep.operators import candidates, index, postings, quantiles, retrieval, scratch, store

MEMORY = "id long, content string, scope string, subject string, tags array<string>, kind string, status string, salience double, created_at long"


def memories(spark, *rows):
    return spark.createDataFrame([(i, c, s, "", [], "semantic", st, 0.5, 0) for i, c, s, st in rows], MEMORY)


def test_context_never_crosses_personas(spark, tmp_path):
    rows = memories(
        spark, (1, "tea in the garden", "persona:aria", "active"), (2, "tea in the garden", "persona:bruno", "active"), (3, "tea for all", "global", "active"), (4, "tea at work", "project:p", "active"), (5, "tea long ago", "persona:aria", "deleted"), (6, "coffee", "persona:aria", "active"), (7, "tea", None, "active")
    )
    said = spark.createDataFrame([(10, "tea?", "persona:aria"), (11, "tea?", "persona:bruno"), (12, "tea?", "project:p"), (13, "tea?", "session:1"), (14, "  ", "global"), (15, None, "global"), (16, "tea?", "global"), (17, "tea?", None)], "id long, text string, scope string")
    made = postings.Index(str(tmp_path / "i"))
    made.extend(spark, "all", retrieval.indexed_memories(rows), retrieval.MEMORY_FIELDS)
    want = {10: {"1", "3"}, 11: {"2", "3"}, 12: {"4"}, 16: {"3"}}
    for used in (None, made):
        got = {}
        for r in retrieval.formation_context(rows, said, 5, used).collect():
            got.setdefault(r["id"], set()).add(r["memory_id"])
        assert got == want
    shown = retrieval.context_ids(retrieval.formation_context(rows, said, 5, made)).filter("id = 10").withColumns({"scope": F.lit("persona:aria"), "raw": F.lit('{"memories": [{"operation": "supersede", "content": "tea no more", "supersedes_id": "1"}, {"operation": "supersede", "content": "x", "supersedes_id": "2"}]}')})
    assert candidates.parse(shown).first()["error"] == "memories[1]: supersedes_id was not among the memories shown"
    assert {r["position"] for r in retrieval.formation_context(rows, said, 1, made).collect()} == {1} and retrieval.formation_context(rows, said, 0, made).count() == 0

    vectors = vx.hash_embeddings(rows.select("id", F.col("content").alias("text")), 16).select(F.col("id").alias("memory_id"), "vector")
    own = vx.hash_embeddings(said.select("id", "text"), 16).select("id", F.col("vector").alias("query_vector"))
    for r in retrieval.formation_context(rows, said, 5, made, vectors, own).collect():
        assert r["memory_id"] in want.get(r["id"], set()) | ({"6"} if r["id"] == 10 else set())
    with pytest.raises(ValueError):
        retrieval.memory_keyword(rows, said.select(F.col("id").alias("qid"), F.col("text").alias("query")), 3, None)


def test_a_failing_batch_is_told_and_taken_up_again(spark):
    rows = memories(spark, *[(i, "bad" if i == 5 else f"text {i}", "global", "active") for i in range(10)], (50, "gone", "global", "deleted"))
    none = spark.createDataFrame([], "memory_id long, model_id string, vector array<double>")

    def strict(texts):
        if "bad" in texts:
            raise RuntimeError("no such text")
        return [[len(t), 1.0] for t in texts]

    made, failed = index.build_by(rows, none, "m", strict, F.floor(F.col("id") / 4), 4, limit=9)
    assert sorted(r["memory_id"] for r in made.collect()) == [0, 1, 2, 3, 8] and {r["memory_id"]: r["error"] for r in failed.collect()} == {i: "RuntimeError: no such text" for i in (4, 5, 6, 7)}
    again, still = index.build_by(rows, made, "m", lambda texts: [[0.0, 0.0] for _ in texts], batch_size=2)
    assert sorted(r["memory_id"] for r in again.collect()) == [4, 5, 6, 7, 9] and still.count() == 0
    short, wrong = index.build_by(rows, none, "m", lambda texts: [[1.0]], F.lit(0), 2)
    assert short.count() == 0 and "1 vectors for 2 texts" in wrong.first()["error"] and wrong.count() == 10
    assert [x.count() for x in index.build_by(rows.limit(0), none, "m", strict)] == [0, 0]


def test_vector_top_against_brute_force(spark):
    r = random.Random(7)
    vectors = [(f"m{i:03}", [r.choice([0.0, 0.25, -0.5, 1.0]) for _ in range(4)]) for i in range(300)] + [("n", None), ("o", [1.0]), ("p", [None, 1.0, 1.0, 1.0]), ("q", [])]
    queries = [(i, [r.choice([0.0, 0.3, -0.7]) for _ in range(4)]) for i in range(20)] + [(90, [2.0]), (91, None), (92, [1.0] * 9)]
    v, q = spark.createDataFrame(vectors, "memory_id string, vector array<double>").repartition(5), spark.createDataFrame(queries, "qid long, query_vector array<double>")
    got = {}
    for x in retrieval.vector_top(v, q, 7).orderBy("qid", "position").collect():
        got.setdefault(x["qid"], []).append((x["memory_id"], round(x["score"], 9)))
    want = {}
    for i, a in queries:
        scored = sorted((-reduce(lambda s, p: s + p[0] * p[1], zip(a, b, strict=True), 0.0), m) for m, b in vectors if a and b and len(a) == len(b) and None not in b)
        if scored:
            want[i] = [(m, round(-s, 9)) for s, m in scored[:7]]
    assert {k: [(m, s + 0.0) for m, s in v] for k, v in got.items()} == {k: [(m, s + 0.0) for m, s in v] for k, v in want.items()}
    assert retrieval.vector_top(v.limit(0), q, 3).count() == 0 and retrieval.vector_top(v, q.limit(0), 3).count() == 0


def test_nearest_ranks_of_a_hot_key_with_ties(spark):
    r = random.Random(3)
    rows = [("hot", float(r.randrange(50))) for _ in range(900)] + [("one", 4.0), (None, 1.0), (None, 3.0), ("hot", None), ("none", None)] + [("same", 2.0)] * 40
    got = {x["k"]: tuple(x)[1:] for x in quantiles.nearest_rank(spark.createDataFrame(rows, "k string, v double").repartition(7), "k", "v", {"low": 0.0, "half": 0.5, "most": 0.95, "all": 1.0}).collect()}
    want = {}
    for key in {k for k, v in rows if v is not None}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        want[key] = tuple(values[max(1, math.ceil(len(values) * s)) - 1] for s in (0.0, 0.5, 0.95, 1.0))
    assert got == want


def test_hashed_embeddings_by_their_definition(spark):
    texts = ["Hello, world 2024", "本地 a优先b", "", None, "!!!", "É ß x", "a"]

    def by_definition(text, dim):
        joined = re.sub(r"[\W_]", "", (text or "").lower())
        out = [0.0] * dim
        for run in re.findall("[぀-ヿ㐀-䶿一-鿿]+|[^぀-ヿ㐀-䶿一-鿿]+", joined):
            cjk = "぀" <= run[0] <= "鿿"
            found = ["c:" + c for c in run] if cjk else ["w:" + run]
            found += [("b:" if cjk else "g:") + x + y for x, y in zip(run, run[1:], strict=False)]
            for f in found:
                value = int(hashlib.sha1(f.encode()).hexdigest()[:12], 16)
                out[value % dim] += 1.0 if value >> 40 & 1 else -1.0
        length = math.sqrt(sum(x * x for x in out))
        return [x / length if length else x for x in out]

    got = {x["id"]: x["vector"] for x in vx.hash_embeddings(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 8).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(by_definition(t, 8))


def test_semantic_search_by_visible_scopes(spark):
    rows = memories(spark, (1, "a", "global", "active"), (2, "a", "persona:x", "active"), (3, "a", "persona:y", "active"))
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "memory_id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0], ["global", "persona:x"]), (1, [1.0, 0.0], [])], "qid long, query_vector array<double>, visible array<string>")
    assert [(r["qid"], r["id"]) for r in retrieval.semantic(rows, vectors, queries, 5, None).orderBy("qid", "position").collect()] == [(0, "1"), (0, "2")]
    assert [r["id"] for r in retrieval.semantic(rows, vectors, queries.drop("visible").filter("qid = 0"), 5, resolve()).collect()] == ["1"]


def test_context_of_many_scopes_against_brute_force(spark, tmp_path, monkeypatch):
    """Queries aren't collected, parts of a scope and both ways of adding up agree with the index-free sum, old texts don't count."""
    monkeypatch.setattr(postings, "PART_DOCS", 7)
    monkeypatch.setattr(postings, "CELLS", 30)
    monkeypatch.setattr(postings, "DENSE_CELLS", 14)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.choice((1, 1, 2)) for _ in range(n))
    rows = memories(spark, *[(i, text(rng.randrange(9)), f"persona:{i % 3}" if i % 4 else "global", "active") for i in range(90)])
    said = spark.createDataFrame([(i, text(4), f"persona:{i % 4}") for i in range(25)], "id long, text string, scope string")
    made = postings.Index(str(tmp_path / "i"))
    made.extend(spark, "old", retrieval.indexed_memories(rows.withColumn("content", F.concat("content", F.lit(" a b")))), retrieval.MEMORY_FIELDS)
    made.extend(spark, "new", retrieval.indexed_memories(rows), retrieval.MEMORY_FIELDS)
    want = retrieval.formation_context(rows, said, 2).orderBy("id", "position").collect()
    with monkeypatch.context() as m:
        m.setattr(type(rows), "toArrow", lambda self: pytest.fail("queries are collected"))
        got = retrieval.formation_context(rows, said, 2, made)
    assert got.orderBy("id", "position").collect() == want and len(want) > 25


def test_scoped_queries_in_rounds_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Each query's best over rounds, parts and lanes, phrases too, are those of the index-free sum; what a round shuffled is gone with it, and only results stay in the shared folder."""
    for name, value in (("PART_DOCS", 100), ("ROUND_BYTES", 1), ("ROUND_QUERIES", 30), ("LANE", 4), ("RUN_BYTES", 3000), ("CELLS", 1000)):
        monkeypatch.setattr(postings, name, value, raising=False)
    rng = random.Random(11)
    words = [rng.choice(("été", "Été", "ete", "茶", "x")) + f"{i:x}" for i in range(400)]
    text = lambda n: " ".join(words[int(400 * rng.random() ** 3)] for _ in range(n))
    texts = [text(rng.randrange(120)) for _ in range(600)]
    rows = memories(spark, *[(i, t, f"persona:{i % 2}" if i % 4 else "global", "deleted" if i % 9 == 0 else "active") for i, t in enumerate(texts)])
    # Some are said as a memory has it, with half a word at either end.
    said = spark.createDataFrame([(i, texts[5 * i][2:19] if i % 2 else text(6), f"persona:{i % 3}") for i in range(90)], "id long, text string, scope string")
    made = postings.Index(str(tmp_path / "i"))
    made.extend(spark, "all", retrieval.indexed_memories(rows), retrieval.MEMORY_FIELDS)
    asked = said.select(F.col("id").alias("qid"), F.col("text").alias("query"), F.array(F.lit("global"), F.col("scope")).alias("visible"))
    want = {(r["qid"], r["id"]): (r["matched_on"], round(r["score"], 6)) for r in retrieval.memory_keyword(rows, asked, 2, None).collect()}

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    shared = []
    folder = scratch.shared_folder
    monkeypatch.setattr(scratch, "shared_folder", lambda spark, name="work": shared.append((name, folder(spark, name))) or shared[-1][1])
    before = shuffled()
    found = retrieval.memory_keyword(rows, asked, 2, None, index=made)
    assert sum(n for name, n in shuffled().items() if name not in before) < 10_000 < sum(map(len, texts))
    kept = [name for name, at in shared if store.exists(spark, at)]
    assert set(kept) == {"best"} and len(kept) > 2
    assert {(r["qid"], r["id"]): (r["matched_on"], round(r["score"], 6)) for r in found.collect()} == want
    assert {m for m, _ in want.values()} == {"phrase", "fts"} and len(want) > 300


def test_scoped_queries_find_indexed_memories_alone(spark, tmp_path):
    rows = memories(spark, (1, "tea", "global", "active"), (2, "tea pot", "global", "active"), (3, "tea cup", "global", "active"), (4, "", "global", "active"), (5, None, "global", "active"))
    made = postings.Index(str(tmp_path / "i"))
    made.extend(spark, "all", retrieval.indexed_memories(rows.filter("id <> 3")), retrieval.MEMORY_FIELDS)
    made.drop(spark, "gone", rows.filter("id = 2").select("id"))
    said = spark.createDataFrame([(7, "tea, unheard", "global"), (8, "!", "global")], "id long, text string, scope string")
    assert [(r["id"], r["memory_id"]) for r in retrieval.formation_context(rows, said, 5, made).collect()] == [(7, "1")]


def test_copies_in_different_parts_have_equal_ranks(monkeypatch):
    """A part's other documents decide the order in which a sum is taken, but not the rank that it is rounded to."""
    monkeypatch.setattr(postings, "DENSE_CELLS", 30_000)
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{int(300 * rng.random() ** 2)}" for _ in range(n))
    docs = [text(rng.randrange(20, 90)) for _ in range(1500)]
    needles = [text(60) for _ in range(400)]
    dfs = [[1 + int(t[1:]) * 7 for t in sorted(set(n.split()))] for n in needles]
    asked = pa.table({"qid": list(range(len(needles))), "needle": needles, "dfs": pa.array(dfs, pa.list_(pa.int64()))})
    score = postings._scored([1.0, 0.3], [0], 9000, 55.0, len(docs) + 1500)
    part = lambda texts: pa.table({"id": list(range(len(texts))), "created_at": list(range(len(texts))), "form_0": texts, "form_1": ["w7"] * len(texts)})
    ranks = []
    for others in ([], [f"w{200 + i % 40} w{150 + i % 30}" for i in range(1500)]):
        found = score(part(docs + others), asked)
        ranks.append({(q, i): r for q, i, r in zip(*(found[c].to_pylist() for c in ("qid", "id", "rank")), strict=True) if i < len(docs)})
    assert ranks[0] == ranks[1] and len(ranks[0]) > 500_000

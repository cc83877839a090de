"""The store: commits that race, reads as of a commit, snapshots, deletes; and the written index on it."""

import threading

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.visibility import resolve
from lorekeep.jobs import queries
from lorekeep.operators import postings, retrieval, store

ROW = "id long, body string"
MEMORY = "id long, content string, scope string, subject string, tags array<string>, kind string, status string, salience double, created_at long"


def rows(spark, *ids, schema=ROW):
    return spark.createDataFrame([(i, f"b{i}") for i in ids], schema)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_racing_batches_get_numbers_of_their_own(spark, tmp_path):
    root, names = str(tmp_path / "s"), [f"b{i}" for i in range(6)]
    results = {}

    def write(i):
        results[i] = store.append(spark, root, names[i], {"m": rows(spark, i)})

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert all(results.values()) and ids(store.read(spark, root, "m", ROW)) == list(range(6))
    assert sorted(r["seq"] for r in store.commits(spark, root).collect()) == [1, 2, 3, 4, 5, 6]


def test_one_of_two_writers_of_a_number_is_retried(spark, tmp_path, monkeypatch):
    root, real, lost = str(tmp_path / "s"), store.create, []

    def slow(spark, folder, name, value):
        if value.get("batch") == "late" and not lost:
            lost.append(name)
            assert real(spark, folder, name, {"seq": value["seq"], "batch": "early", "adds": [], "drops": []})
        return real(spark, folder, name, value)

    monkeypatch.setattr(store, "create", slow)
    assert store.append(spark, root, "late", {"m": rows(spark, 1)})
    assert [(r["seq"], r["batch"]) for r in store.commits(spark, root).orderBy("seq").collect()] == [(1, "early"), (2, "late")] and lost == ["00000000000000000001.json"]


def test_the_same_batch_raced_is_committed_once(spark, tmp_path, monkeypatch):
    root, real = str(tmp_path / "s"), store.create
    inner = []

    def race(spark, folder, name, value):
        if not inner:
            inner.append(1)
            assert store.append(spark, root, "b", {"m": rows(spark, 2)})
        return real(spark, folder, name, value)

    monkeypatch.setattr(store, "create", race)
    assert not store.append(spark, root, "b", {"m": rows(spark, 1)})
    assert ids(store.read(spark, root, "m", ROW)) == [2]


def test_rows_made_from_an_older_commit_conflict(spark, tmp_path):
    root = str(tmp_path / "s")
    store.append(spark, root, "a", {"m": rows(spark, 1)}, since=0)
    with pytest.raises(store.Conflict):
        store.append(spark, root, "b", {"m": rows(spark, 2)}, since=0)
    assert store.append(spark, root, "b", {"m": rows(spark, 2)}, since=1) and ids(store.read(spark, root, "m", ROW)) == [1, 2]


def test_snapshots_and_reads_as_of_a_commit(spark, tmp_path):
    root, copy = str(tmp_path / "s"), str(tmp_path / "c")
    store.append(spark, root, "a", {"m": rows(spark, 1), "n": rows(spark, 7)})
    assert store.snapshot(spark, root, copy, {"m": ROW, "n": ROW}) == 1 and store.pin(spark, root, "first") == 1
    store.append(spark, root, "b", {"m": rows(spark, 2)})
    assert ids(store.read(spark, root, "m", ROW, upto=1)) == [1] and ids(store.read(spark, root, "m", ROW, upto=store.pinned(spark, root, "first"))) == [1]
    assert ids(store.read(spark, copy, "m", ROW)) == [1]
    assert store.snapshot(spark, root, copy, {"m": ROW, "n": ROW}) == 2 and store.snapshot(spark, root, copy, {"m": ROW, "n": ROW}) == 2
    assert ids(store.read(spark, copy, "m", ROW)) == [1, 2] and ids(store.read(spark, copy, "n", ROW)) == [7]
    with pytest.raises(store.Refused):
        store.pin(spark, root, "first")
    with pytest.raises(LookupError):
        store.pinned(spark, root, "none")


def test_delete_takes_vectors_along_and_refuses_what_others_point_to(spark, tmp_path):
    root = str(tmp_path / "s")
    memory, vector = "id string, superseded_by string", "memory_id string, v double"
    schemas, keys = {"memory": memory, "vector": vector}, {"memory": "id", "vector": "memory_id"}
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    store.append(spark, root, "a", {"memory": spark.createDataFrame([("x", "y"), ("y", None)], memory), "vector": spark.createDataFrame([("x", 1.0), ("y", 2.0)], vector)})
    store.append(spark, root, "b", {"memory": spark.createDataFrame([("z", None)], memory), "vector": spark.createDataFrame([("z", 3.0)], vector)})
    with pytest.raises(store.Refused):
        store.delete(spark, root, "d", of("y"), schemas, keys, {"memory": "superseded_by"})
    assert store.delete(spark, root, "d", of("x", "unknown"), schemas, keys, {"memory": "superseded_by"}) and not store.delete(spark, root, "d", of("y"), schemas, keys)
    left = store.read(spark, root, "memory", memory)
    assert sorted((r["id"], r["seq"]) for r in left.collect()) == [("y", 1), ("z", 2)]
    assert sorted((r["memory_id"], r["seq"]) for r in store.read(spark, root, "vector", vector).collect()) == [("y", 1), ("z", 2)]
    assert ids(store.read(spark, root, "memory", memory, upto=2)) == ["x", "y", "z"]
    assert store.vacuum(spark, root) == 2 and ids(store.read(spark, root, "memory", memory)) == ["y", "z"]
    assert store.delete(spark, root, "e", of("y"), schemas, keys, {"memory": "superseded_by"}) and ids(store.read(spark, root, "vector", "memory_id string, v double").select(F.col("memory_id").alias("id"))) == ["z"]


# -- the index -----------------------------------------------------------------


def memories(spark, *said):
    return retrieval.indexed_memories(spark.createDataFrame([(i, c, "global", "", [], "semantic", "active", 0.5, 0) for i, c in said], MEMORY))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")


def hits(rows, queries, index=None, limit=3):
    found = retrieval.merge(retrieval.memory_keyword(rows, queries, limit, resolve(), index=index), k=limit)
    return [(r["qid"], r["id"], round(r["score"], 9), r["matched_on"]) for r in found.orderBy("qid", "position").collect()]


def test_index_answers_as_the_plain_join_and_extends(spark, tmp_path):
    said = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)] + [(60, None), (61, ""), (62, "本地优先 w3 w3"), (63, "w3")]
    rows, queries = memories(spark, *said), asked(spark, "w1 w3 w3", "本地", "w5 unknown", "!!!", "", "w2 w4 w6 w8 w10")
    whole = postings.Index(str(tmp_path / "whole"))
    assert whole.extend(spark, "all", rows, retrieval.MEMORY_FIELDS) and not whole.extend(spark, "all", rows, retrieval.MEMORY_FIELDS)
    plain = hits(rows, queries)
    assert plain and hits(rows, queries, whole) == plain

    parts = postings.Index(str(tmp_path / "parts"))
    parts.extend(spark, "a", memories(spark, *[(i, "old words w3") for i, _ in said[:20]]), retrieval.MEMORY_FIELDS)
    parts.extend(spark, "b", rows.filter("id >= 10"), retrieval.MEMORY_FIELDS)
    parts.extend(spark, "c", rows.filter("id < 10").unionByName(memories(spark, (99, "w1 w3"))), retrieval.MEMORY_FIELDS)
    parts.drop(spark, "d", spark.createDataFrame([(99,), (1234,)], "id long"))
    assert hits(rows, queries, parts) == plain
    df = lambda i: {r["term"]: r["df"] for r in i.frequencies(spark).collect()}
    assert df(parts) == df(whole) and "old" not in df(parts)
    assert parts.sizes(spark)[:2] == whole.sizes(spark)[:2]


def test_index_in_blocks_of_queries_with_terms_by_join(spark, tmp_path, monkeypatch):
    rows, queries = memories(spark, *[(i, f"w{i % 5} w{i % 3} x") for i in range(30)]), asked(spark, "w1 w2", "x w0", "w4")
    index = postings.Index(str(tmp_path / "i"))
    index.extend(spark, "all", rows, retrieval.MEMORY_FIELDS)
    plain = hits(rows, queries)
    monkeypatch.setattr(postings, "ASKED_TERMS", 2)
    monkeypatch.setattr(postings, "NAMED_TERMS", 0)
    assert hits(rows, queries, index) == plain


def test_index_reads_no_text_and_only_its_terms_parts(spark, tmp_path):
    rows = memories(spark, *[(i, f"w{i}") for i in range(200)])
    rows.write.parquet(str(tmp_path / "rows"))
    rows, index = spark.read.parquet(str(tmp_path / "rows")), postings.Index(str(tmp_path / "i"))
    index.extend(spark, "all", rows, retrieval.MEMORY_FIELDS)
    plan = index.best(asked(spark, "w7"), rows.select("id", "created_at"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "bucket" in plan and "In(term" in plan or "EqualTo(term" in plan
    assert hits(rows.limit(0), asked(spark, "w7"), index) == []


def test_index_of_nothing(spark, tmp_path):
    none, index = memories(spark).limit(0), postings.Index(str(tmp_path / "i"))
    assert hits(none, asked(spark, "a"), index) == []
    index.extend(spark, "all", none, retrieval.MEMORY_FIELDS)
    assert hits(none, asked(spark, "a"), index) == [] and index.sizes(spark)[0] == 0


# -- frequencies ---------------------------------------------------------------

FIELDS = (("content", 1.0), ("subject", 0.5))


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, content string, subject string")


def frequencies(rows):
    return {r["term"]: (r["df"], r["total"]) for r in postings.frequencies(rows, FIELDS).collect()}


@pytest.mark.parametrize("sent", [200_000, 0])
@pytest.mark.parametrize("words", [2_000_000, 2])
def test_frequencies_count_ids_however_many_rows_they_have(spark, monkeypatch, sent, words):
    monkeypatch.setattr(postings, "SENT_IDS", sent)
    monkeypatch.setattr(postings, "COUNTED_WORDS", words)
    rows = texts(spark, (1, "Café cafe x x", "x"), (2, "x", None), (3, None, "y"), (4, "", ""), (5, "a b", "x"), (5, "a", "x"), (5, "a b", "x"), (None, "x only", "y"), (None, "x", None))
    want = {"cafe": (1, 2.0), "x": (3, 7.0), "y": (1, 1.0), "a": (1, 3.0), "b": (1, 2.0), "only": (0, 1.0)}
    assert frequencies(rows) == want and frequencies(rows.limit(0)) == {}


def test_frequencies_shuffle_counts_instead_of_the_terms_of_documents(spark, tmp_path, monkeypatch):
    texts(spark, *[(i, "common words of all " * 20, "en") for i in range(400)]).write.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(queries.t, "memories", lambda spark, sf: spark.read.parquet(sf))
    found = queries.document_frequencies(spark, str(tmp_path / "rows"))
    assert {r["term"]: (r["df"], r["total"]) for r in found.collect()}["common"] == (400, 8000.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(id" not in plan

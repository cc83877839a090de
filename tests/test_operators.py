import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions import validation
from lorekeep.functions.visibility import resolve
from lorekeep.operators import candidates, export, formation, importing, index, ingest, retrieval, store, versions
from lorekeep.sources import vault

MEMORY = "id long, content string, scope string, subject string, tags array<string>, kind string, status string, salience double, created_at long"


def memories(spark, *rows):
    return spark.createDataFrame([(i, c, s, "", [], "semantic", st, 0.5, 0) for i, c, s, st in rows], MEMORY)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")


def recall(rows, queries, limit=10, **who):
    hits = retrieval.merge(retrieval.memory_keyword(rows, queries, limit, resolve(**who)), k=limit)
    return [(r["id"], r["matched_on"]) for r in hits.orderBy("qid", "position").collect()]


def test_bm25_closed_form(spark):
    rows = memories(spark, (1, "a b c", "global", "active"), (2, "a a d", "global", "active"), (3, "e f", "global", "active"), (4, "g", "global", "active"))
    got = {r["id"]: r["rank"] for r in retrieval.bm25(retrieval.build_index(rows, (("content", 1.0),)), asked(spark, "d d c")).collect()}
    idf = math.log((4 - 1 + 0.5) / 1.5)
    part = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2.25))
    assert got[1] == pytest.approx(-part, abs=1e-8) and got[2] == pytest.approx(-2 * part, abs=1e-8)


def test_phrase_goes_before_scattered_and_ties_by_id(spark):
    rows = memories(spark, (1, "本着地道的原则", "global", "active"), (2, "本地优先", "global", "active"), (3, "x", "global", "active"), (4, "x", "global", "active"))
    assert recall(rows, asked(spark, "本地")) == [("2", "phrase"), ("1", "fts")]
    assert [i for i, _ in recall(rows, asked(spark, "x"))] == ["3", "4"]
    assert recall(rows, asked(spark, "!!!")) == [] and recall(rows, asked(spark, "")) == []


def test_hidden_rows_count_in_statistics_only(spark):
    rows = memories(spark, (1, "dark", "global", "active"), (2, "dark", "persona:x", "active"), (3, "dark", "global", "deleted"))
    assert recall(rows, asked(spark, "dark")) == [("1", "phrase")]
    assert {i for i, _ in recall(rows, asked(spark, "dark"), persona="x")} == {"1", "2"}


def test_hybrid_with_one_empty_side_is_the_other(spark):
    rows = memories(spark, (1, "dark theme", "global", "active"), (2, "light theme", "global", "active"))
    keyword = retrieval.merge(retrieval.memory_keyword(rows, asked(spark, "theme dark"), 10, resolve()), k=30)
    none = keyword.limit(0)
    fused = retrieval.fuse(keyword, none, 10)
    key = lambda df: [(r["id"], r["score"], r["matched_on"]) for r in df.orderBy("position").collect()]
    assert key(fused) == key(keyword)
    both = retrieval.fuse(keyword, keyword.withColumn("matched_on", F.lit("vector")), 10)
    top = both.orderBy("position").first()
    assert top["matched_on"] == "hybrid" and top["score"] == pytest.approx(2 / 61 * (1.25 if keyword.orderBy("position").first()["matched_on"] == "phrase" else 1))


def test_vector_ties_and_clamp(spark):
    vectors = spark.createDataFrame([("c", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "memory_id string, vector array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, query_vector array<double>")
    assert [r["memory_id"] for r in retrieval.vector_top(vectors, q, 2).orderBy("position").collect()] == ["a", "b"]
    assert [retrieval.clamp(x) for x in (None, 0, -1, 5, 1000)] == [10, 10, 10, 5, 100]


def test_versions(spark):
    log = spark.createDataFrame([(1, "k", "a", 1), (2, "k", "b", 2), (3, "k", "c", 2), (4, "j", "d", 1)], "id long, key string, value string, created_at long")
    assert sorted(r["value"] for r in versions.current(log, ["key"]).collect()) == ["c", "d"]
    linked = versions.history(log, ["key"])
    assert {r["id"]: r["superseded_by"] for r in linked.collect()} == {1: 2, 2: 3, 3: None, 4: None}
    assert versions.dangling(linked).count() == 0 and [r["id"] for r in versions.dangling(linked.filter("id <> 2")).collect()] == [1]
    changes = spark.createDataFrame([(1, 1, "archived", None), (1, 2, "superseded", 2), (9, 1, "deleted", None)], "id long, seq long, status string, superseded_by long")
    folded = {r["id"]: (r["status"], r["superseded_by"], r["revision"]) for r in versions.fold_changes(log.withColumn("status", F.lit("active")), changes).collect()}
    assert folded[1] == ("superseded", 2, 3) and folded[2] == ("active", None, 1) and len(folded) == 4


def test_index_rebuild_gives_the_same(spark):
    rows = memories(spark, (1, "one", "global", "active"), (2, "two", "global", "active"), (3, "three", "global", "deleted"))
    none = spark.createDataFrame([], "memory_id long, model_id string, vector array<double>")
    built = index.build(rows, none, "m", 4)
    assert sorted(r["memory_id"] for r in built.collect()) == [1, 2]
    assert index.missing(rows, built, "m").count() == 0
    assert sorted(map(str, index.rebuilt(rows, built, "m", 4).collect())) == sorted(map(str, built.collect()))
    assert index.stats(rows, built.filter("memory_id = 1")).first()["n_missing"] == 1


@pytest.mark.parametrize(
    "text, target, kind, key, value, content",
    [
        ("Remember: buy milk", "memory", "semantic", None, None, "buy milk"), ("记住本地优先", "memory", "semantic", None, None, "本地优先"), ("偏好：theme = dark", "preference", None, "theme", "dark", None),
        ("please remember identity: I am A", "memory", "identity", None, None, "I am A"), ('项目状态：p1 = {"a": 1}', "project_state", None, "p1", '{"a": 1}', None), ("notebook is here", None, None, None, None, None),
        ("preference: theme", None, None, None, None, None), ("project: p1 = [1]", None, None, None, None, None), ("remember", None, None, None, None, None), ("hello", None, None, None, None, None), (None, None, None, None, None, None),
    ],
)
def test_rules(spark, text, target, kind, key, value, content):
    r = formation.extract(spark.createDataFrame([(1, text, "global")], "id long, text string, scope string")).first()
    assert (r["target"], r["kind"], r["key"], r["value"], r["content"]) == (target, kind, key, value, content)
    assert (r["reason"] is None) == (target is not None)


def test_policy(spark):
    schema = "id long, scope string, target string, operation string, confidence double, content string, key string, supersedes string"
    rows = [(1, "g", "memory", "add", 0.35, "long enough", None, None), (2, "g", "memory", "add", 0.34, "long enough", None, None), (3, "g", "memory", "add", 1.0, " A  b C ", None, None), (4, "g", "memory", "add", 1.0, "abc", None, None),
            (5, "g", "preference", "add", 1.0, None, " ", None), (6, "g", "memory", "supersede", 1.0, "another", None, "77"), (7, "g", "memory", "noop", 1.0, "whatever", None, None), (8, "h", "memory", "add", 1.0, "a b c", None, None)]
    stored = spark.createDataFrame([(50, "g", "a B c")], "id long, scope string, content string")
    got = {r["id"]: r["verdict"] for r in formation.judge(spark.createDataFrame(rows, schema), stored).collect()}
    assert got == {1: "accepted", 2: "low confidence", 3: "duplicate", 4: "too short", 5: "no key", 6: "unknown supersede target", 7: "not worth remembering", 8: "accepted"}


def test_front_matter(spark):
    texts = {
        "---\ntitle: 'A # b'\nn: 3 # three\nlist:\n- x\n  - 2\ninline: [a, true, \"q\"]\nnone:\n# a comment: here\nurl: http://x/y#z\nf: +01.50\nn: 007\nyes: no\n---\nbody": (
            {"title": "A # b", "n": 7, "list": ["x", 2], "inline": ["a", True, "q"], "none": [], "url": "http://x/y#z", "f": 1.5, "yes": False}, "body", "A # b"),
        "no block": ({}, "no block", "n"), "---\nopen: 1": ({}, "---\nopen: 1", "n"), "\ufeff---\r\na: \"it\\\\s\"\r\ntitle: 5\r\n...\r\n# Head \r\nx": ({"a": "it\\\\s", "title": 5}, "# Head \nx", "Head"),
        "---\n---\n": ({}, "", "n"), "": ({}, "", "n"),
    }
    rows = spark.createDataFrame([("a/n.md", t) for t in texts], "rel_path string, text string")
    got = [(json.loads(r["front"]), r["body"], r["title"]) for r in ingest.parse(rows).collect()]
    assert got == list(texts.values())


def test_chunks():
    long = "word " * 20
    body = f"# One\n\n{long}\n\n{long}\n\n```\n# not a heading\n```\n\n## Two\n\n记住：短\n\n{long}\n\nshort"
    got = ingest.chunks(body, least=40, most=2000)
    assert [(c[0], c[1]) for c in got] == [(0, ["One"]), (1, ["One", "Two"]), (2, ["One", "Two"])]
    assert got[1][2] == "记住：短" and got[0][2].count("\n") == 1 and (got[0][3], got[0][4]) == (3, 5)
    assert len(ingest.chunks(f"{long}\n\n{long}", most=120)) == 2
    assert ingest.chunks("") == []


def test_ingest_plan_is_idempotent(spark, tmp_path):
    notes = tmp_path / "vault"
    (notes / "Projects" / "p1").mkdir(parents=True)
    (notes / ".git").mkdir()
    (notes / ".git" / "x.md").write_text("hidden " * 20)
    (notes / "Projects" / "p1" / "State.md").write_text("---\ntype: project-state\nproject: p1\nphase: two\n---\nThe project is in its second phase, which is going well.\n")
    (notes / "Note.md").write_text("# Title here\n\n" + "Some knowledge about things. " * 5 + "\n\n记住：本地优先\n")
    scanned = vault.scan(spark, str(notes))
    chunks = ingest.routed(ingest.chunked(ingest.parse(scanned)))
    rows = {(r["rel_path"], r["ordinal"]): (r["route"], r["scope"], r["key"]) for r in chunks.collect()}
    assert rows == {("Projects/p1/State.md", 0): ("project_state", "project:p1", "p1"), ("Note.md", 0): ("knowledge", "global", None), ("Note.md", 1): ("declaration", "global", None)}
    none = chunks.limit(0).select("rel_path", "body_hash", "content_hash")
    first = ingest.plan(chunks, none)
    assert {(r["status"], r["action"]) for r in first.collect()} == {("new", "ingest")}
    again = ingest.plan(chunks, first.select("rel_path", "body_hash", "content_hash"))
    assert {(r["status"], r["action"]) for r in again.collect()} == {("unchanged", "skip")}


def test_query_vectors_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "memory_id long, vector array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(9)], "qid long, query_vector array<double>")
    whole = sorted(map(tuple, retrieval.vector_top(vectors, queries, 3).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert len(whole) == 27 and sorted(map(tuple, retrieval.vector_top(vectors, queries, 3).collect())) == whole
    assert retrieval.vector_top(vectors, queries, 0).count() == 0


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(2, "project:a-b", "t", "x"), (1, "project:a:b", "t", None)], "id long, scope string, title string, body string")
    assert sorted(r["file"] for r in export.scope_names(rows).collect()) == ["project-a-b-2.md", "project-a-b.md"]
    lines = export.json_lines({"m": (rows, "id")})
    assert lines.filter("key = '1'").first()["line"] == '{"body":null,"id":1,"scope":"project:a:b","title":"t"}'
    nested = spark.createDataFrame([(1, (2, [(3, None)]), {"z": 1, "b": None})], "id long, s struct<y:int,a:array<struct<q:int,c:int>>>, m map<string,int>")
    assert nested.select(export.canonical(nested).alias("j")).first()["j"] == '{"id":1,"m":{"b":null,"z":1},"s":{"a":[{"c":null,"q":3}],"y":2}}'
    export.write_json_lines(lines, str(tmp_path / "a"))
    assert spark.read.text(str(tmp_path / "a")).count() == 2
    existing = spark.createDataFrame([("old.md", f"<!-- {export.MARKER} -->"), ("mine.md", "# mine")], "path string, head string")
    assert [r["path"] for r in export.stale(existing, existing.limit(0)).collect()] == ["old.md"]


def test_mirror(spark, tmp_path):
    rows = memories(spark, (10, "ten", "global", "active"), (9, "nine\nlines", "global", "active"), (3, "gone", "global", "deleted")).withColumn("confidence", F.lit(1.0))
    prefs = spark.createDataFrame([("p1", "user:1", "tone", '"calm"', 0.5, 7)], "id string, scope string, key string, value string, confidence double, created_at long")
    states = spark.createDataFrame([("s1", "global", "pr", '{"a":1}', 7)], "id string, scope string, project_id string, state string, created_at long")
    blocks = export.mirror_blocks(rows, prefs, states, "now")
    export.write_mirror(blocks, str(tmp_path / "m"))
    text = lambda f: "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m" / f"file={f}")).collect())
    whole = text("global.md")
    assert whole.index("generated: true") < whole.index("nine\nlines") < whole.index("\nten") < whole.index('{"a":1}') and "gone" not in whole and "memory_count: 2" in whole
    assert 'tone = "calm"' in text("user-1.md") and export.MARKER in text("README.md")
    hits = spark.createDataFrame([(1, 2, "memory", "semantic", "b", None, None), (1, 1, "preference", None, None, "k", "v")], "qid long, position long, item_type string, kind string, content string, key string, value string")
    assert [tuple(r) for r in export.prompt_context(hits, asked(spark, "none", "some")).orderBy("qid").collect()] == [(0, "(no relevant memories)"), (1, "- preference k = v\n- [semantic] b")]


def test_scan_keeps_notes_with_bad_bytes(spark, tmp_path):
    (tmp_path / "b.md").write_bytes(b"caf\xe9 ok")
    (tmp_path / "A.md").write_text("é")
    assert [(r["rel_path"], r["text"]) for r in vault.in_order(vault.scan(spark, str(tmp_path))).collect()] == [("A.md", "é"), ("b.md", "caf\ufffd ok")]


def responses(spark, *raws):
    return spark.createDataFrame([(i, "global", r, ["7"]) for i, r in enumerate(raws)], "id long, scope string, raw string, context_ids array<string>")


@pytest.mark.parametrize(
    "raw, error",
    [
        (None, "no content"), ("hello", "no JSON object"), ("{broken", "not valid JSON"), ('{"memories": []} and more', "not valid JSON"), ('{"m": []}', "unknown top-level key"), ("{}", "memories is missing"), ('{"memories": 1}', "memories is no list"),
        ('{"memories": [1]}', "memories[0]: an entry is no object"), ('{"memories": [{"operation": "noop"}, {"operation": "zap"}]}', "memories[1]: unknown operation"), ('{"memories": [{"operation": "add", "content": " "}]}', "memories[0]: content is missing"),
        ('{"memories": [{"operation": "add", "content": "x", "more": 1}]}', "memories[0]: unknown key"), ('{"memories": [{"operation": "add", "content": "x", "confidence": true}]}', "memories[0]: confidence is no number"),
        ('{"memories": [{"operation": "add", "content": "x", "salience": 2}]}', "memories[0]: salience is not within 0 and 1"), ('{"memories": [{"operation": "add", "content": "x", "tags": ["a", " "]}]}', "memories[0]: a tag is no string"),
        ('{"memories": [{"operation": "update", "content": "x", "supersedes_id": "8"}]}', "memories[0]: supersedes_id was not among the memories shown"), ('{"memories": [{"operation": "add", "content": "x", "supersedes_id": "7"}]}', "memories[0]: supersedes_id without supersede"),
        ('{"memories": [' + ",".join(['{"operation": "noop"}'] * 6) + "]}", "too many candidates"),
    ],
)
def test_responses_that_break_a_rule_give_nothing(spark, raw, error):
    r = candidates.parse(responses(spark, raw)).first()
    assert (r["error"], r["items"]) == (error, None)


def test_responses_give_candidates(spark):
    raw = 'Sure:\n{"memories": [{"operation": "ADD", "content": " tea ", "tags": ["a ", "b"], "confidence": 0.9}, {"operation": "replace", "content": "x", "supersedes_id": "7", "kind": "Identity"}, {"operation": "skip"}]}'
    rows = candidates.extract(responses(spark, raw, "```json\n{\"memories\": []}\n```")).orderBy("ordinal").collect()
    assert [(r["operation"], r["content"], r["kind"], r["supersedes"], r["confidence"]) for r in rows] == [("add", "tea", "semantic", None, 0.9), ("supersede", "x", "identity", "7", 0.6), ("noop", None, None, None, 0.6)]
    assert rows[0]["tags"] == ["a", "b"] and rows[0]["salience"] == 0.5


def test_dedupe_tells_operations_and_targets_apart(spark):
    rows = [(1, "s", "memory", "add", None, "A b", None), (2, "s", "memory", "add", None, "a  B", None), (3, "s", "memory", "supersede", "9", "a b", None), (4, "s", "preference", "add", None, None, "K"), (5, "s", "preference", "add", None, "", "k")]
    table = spark.createDataFrame(rows, "id long, scope string, target string, operation string, supersedes string, content string, key string")
    assert sorted(r["id"] for r in formation.dedupe(table).collect()) == [1, 3, 4]


def test_formation_keeps_every_event_and_prefers_rules(spark):
    said = spark.createDataFrame([(1, "e1", "remember: likes tea", "global", None), (2, "e2", "hello", "global", '{"origin": "import", "ref": "r"}'), (3, "e3", None, "global", None)], "id long, event_id string, text string, scope string, given string")
    model = spark.createDataFrame([(1, "global", '{"memories": [{"operation": "add", "content": "Likes  tea"}]}', []), (2, "global", '{"memories": [{"operation": "add", "content": "says hello", "reason": "why"}]}', []), (3, "global", "no idea", [])], "id long, scope string, raw string, context_ids array<string>")
    found, reasons = formation.collect(formation.rule_candidates(said), candidates.extract(model))
    made = formation.formed(said, found, memories(spark))
    assert made["event"].count() == 3 and {(r["id"], r["origin"]) for r in reasons.collect()} == {(2, "rules"), (3, "rules"), (3, "model")}
    got = {r["content"]: json.loads(r["source"]) for r in made["memory"].collect()}
    assert got == {"likes tea": {"origin": "rules", "event_ids": ["e1"]}, "says hello": {"origin": "import", "formed_by": "model", "reason": "why", "ref": "r", "event_ids": ["e2"]}}


def test_store_appends_all_or_nothing(spark, tmp_path):
    root, schema = str(tmp_path / "s"), "id long, scope string"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    gate = {"m": F.array_compact(F.array(validation.scope(F.col("scope"))))}
    assert store.append(spark, root, "one", {"m": rows((1, "global")), "p": rows((5, "x"))}, gate)
    assert not store.append(spark, root, "one", {"m": rows((2, "global"))}, gate)
    with pytest.raises(store.Refused):
        store.append(spark, root, "two", {"p": rows((6, "y")), "m": rows((3, "global"), (4, "nowhere"))}, gate)
    rows((9, "global")).write.parquet(f"{root}/m/batch=died")  # written, never committed
    assert store.append(spark, root, "three", {"m": rows((7, "user:a"))}, gate)
    assert sorted((r["id"], r["seq"]) for r in store.read(spark, root, "m", schema).collect()) == [(1, 1), (7, 2)] and [r["id"] for r in store.read(spark, root, "p", schema).collect()] == [5]
    assert store.read(spark, root, "none", schema).count() == 0
    store.snapshot(spark, root, str(tmp_path / "copy"), {"m": schema, "p": schema})
    assert sorted(r["id"] for r in store.read(spark, str(tmp_path / "copy"), "m", schema).collect()) == [1, 7]
    with pytest.raises(LookupError):
        store.required(rows((1, "x")).filter("id = 2"), "row 2")
    ids = [r["i"] for r in spark.sql("SELECT explode(array(timestamp'2024-01-01', timestamp'2030-01-01', timestamp'1999-01-01')) AS ts").select("ts", store.sortable_id(F.lit("m"), F.lit("a"), at=F.col("ts")).alias("i")).orderBy("ts").collect()]
    assert ids == sorted(ids) and len(set(ids)) == 3


def test_import_twice_adds_nothing(spark, tmp_path):
    notes, root = tmp_path / "vault" / "Projects" / "p1", str(tmp_path / "store")
    notes.mkdir(parents=True)
    (notes / "State.md").write_text("---\ntype: project-state\nproject: p1\nphase: two\n---\nThe project is in its second phase, which is going well.\n")
    (notes / "Tone.md").write_text("---\ntype: pref\nkey: tone\nvalue: calm\n---\nThe tone of all that is written here shall be calm.\n")
    (notes / "Note.md").write_text("# Title\n\n" + "Some knowledge about things. " * 5 + "\n\n记住：本地优先 always\n")
    (notes / "Short.md").write_text("too short")

    def run(batch, raws=None):
        parsed = ingest.parse(vault.scan(spark, str(tmp_path / "vault")))
        seen = importing.seen(spark, root)
        planned = ingest.plan(ingest.routed(ingest.chunked(parsed)), seen)
        made = importing.records(planned, "v", memories(spark), raws)
        told = importing.counters(importing.documents(parsed, planned, seen), made).first().asDict()
        importing.apply(spark, root, batch, made)
        return {k: v for k, v in told.items() if v}

    first = run("a")
    assert first == {"documents_scanned": 4, "documents_new": 3, "chunks_planned": 4, "chunks_ingested": 4, "events_created": 4, "memories_created": 1, "preferences_set": 1, "project_states_set": 1, "candidates_accepted": 1}
    rows = {n: store.read(spark, root, n, s).collect() for n, s in importing.SCHEMAS.items()}
    assert [r["content"] for r in rows["memory"]] == ["本地优先 always"] and json.loads(rows["memory"][0]["source"])["formed_by"] == "rules"
    assert [(r["key"], r["value"], r["scope"]) for r in rows["preference"]] == [("tone", "calm", "project:p1")] and json.loads(rows["project_state"][0]["state"]) == {"phase": "two"}
    assert {json.loads(rows["preference"][0]["source"])["event_ids"][0], rows["memory"][0]["source"] and json.loads(rows["memory"][0]["source"])["event_ids"][0]} <= {r["id"] for r in rows["event"]}
    assert run("b") == {"documents_scanned": 4, "documents_unchanged": 3}
    (notes / "Note.md").write_text("# Title\n\n" + "Some knowledge about things. " * 5 + "\n\n" + "Something else that is quite new to the store. " * 2)
    changed = run("c")
    assert changed == {"documents_scanned": 4, "documents_unchanged": 2, "documents_changed": 1, "chunks_planned": 1, "chunks_ingested": 1, "events_created": 1}
    assert {n: store.read(spark, root, n, s).count() for n, s in importing.SCHEMAS.items()} == {"event": 5, "memory": 1, "preference": 1, "project_state": 1}


def test_streaming_index(spark, tmp_path):
    from lorekeep.streaming import increment

    source = tmp_path / "in"
    write = lambda rows: spark.createDataFrame(rows, "id long, text string").write.mode("append").parquet(str(source))
    run = lambda: increment.embed_new(spark.readStream.schema("id long, text string").parquet(str(source)), str(tmp_path / "index"), "m", str(tmp_path / "ck"), 4).start().awaitTermination()
    write([(1, "one"), (2, "two")])
    run()
    write([(2, "two"), (3, "three")])
    run()
    assert sorted(r["memory_id"] for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [1, 2, 3]


def test_hash_form_and_routes_by_their_expressions(spark, monkeypatch):
    """What is told by byte searches first equals what the expressions say of every text; notes are cut in small parts."""
    rng = random.Random(3)
    odd = ["", "\n", "\r", "a\r\nb \r", " \n a", "a\x0b\nb", "a\n\n", "\na", "a\x0c", "a b\tc", *["".join(rng.choice("a \n\r\t\x0b\x0c") for _ in range(rng.randrange(9))) for _ in range(200)]]
    want = [re.sub(r"\A\n+|\n+\Z", "", re.sub(r"[ \t\x0b\x0c\r]+(?=\n|\Z)", "", re.sub(r"\r\n?", "\n", t))) for t in odd]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    assert [r["h"] for r in rows.orderBy("i").select(tx.hash_form(F.col("t")).alias("h")).collect()] == want

    said = {"REMEMBER: x": "declaration", "so 记下：x": "declaration", "> [!Memory] x": "declaration", "remember x": "knowledge", "Preference: a ＝ b": "preference", "PREFERENCE: a b": "knowledge", "project state: p = {\"a\": 1}": "project_state", "project state: p = [1]": "knowledge"}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", ingest.route_of(F.col("t"))["route"].alias("r"))
    assert {r["t"]: r["r"] for r in rows.collect()} == said

    notes = ingest.parse(spark.createDataFrame([(f"{i}.md", f"# T\n\n{'word ' * 20}{i}") for i in range(30)], "rel_path string, text string").coalesce(1)).cache()
    whole = sorted(ingest.chunked(notes).collect())
    monkeypatch.setattr(ingest, "CHUNKED_BYTES", 250)
    assert sorted(ingest.chunked(notes).collect()) == whole and len(whole) == 30

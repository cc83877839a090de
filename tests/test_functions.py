import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorekeep.functions import text as tx
from lorekeep.functions import validation as va
from lorekeep.functions import vectors as vx
from lorekeep.functions.visibility import resolve, when_writing


def one(spark, column, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, form",
    [("Local-First Design!", "local first design"), ("本地优先", "本 地 优 先"), ("Python项目 v0.1", "python 项 目 v0 1"), ("用户偏好：本地优先", "用 户 偏 好 本 地 优 先"), ("", ""), ("!!!", ""), ("，。、", ""), (None, "")],
)
def test_search_form(spark, text, form):
    assert one(spark, tx.search_form(F.col("c0")), text) == form


def test_folding_matches_terms_but_not_phrases(spark):
    assert one(spark, tx.index_terms(F.col("c0")), "Café") == ["cafe"]
    assert one(spark, tx.search_form(F.col("c0")), "Café") == "café"


def test_tokens_fold_in_a_batch_as_in_a_column(spark):
    said = ["Café É ÀÉÎ x1", "ǅ ß İ ñandú Ωmega", "本地 abc", "", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id long, s string")
    for r in rows.select(tx.units(F.col("s")).alias("u"), tx.index_terms(F.col("s")).alias("t")).collect():
        assert tx.folded(pa.array(r["u"], pa.string())).to_pylist() == r["t"]


@pytest.mark.parametrize(
    "path, pattern, match",
    [
        ("notes/deep/a.md.bak", "*.md.bak", True), ("Projects/x.md", "Projects/*", True), ("Projects/a/x.md", "Projects/*", False), ("Projects/a/b/x.md", "Projects/**", True), ("a.md", "**/*.md", True),
        ("A/B.MD", "a/*.md", True), ("a/b.md", "a/?.md", True), ("a/bb.md", "a/?.md", False), ("a/b1.md", "a/b[0-3].md", True), ("a/b9.md", "a/b[!0-3].md", True), ("x", "", False),
    ],
)
def test_glob(spark, path, pattern, match):
    assert one(spark, tx.matches_glob(F.col("c0"), pattern), path) is match


def test_hash_form_and_refs(spark):
    assert one(spark, tx.hash_form(F.col("c0")), "\r\n\na  \r\n b\t\n\n") == "a\n b"
    assert one(spark, tx.content_hash(F.col("c0")), "a ") == one(spark, tx.content_hash(F.col("c0")), "\na\n")
    assert one(spark, tx.parse_ref(F.col("c0"))["rel_path"], "obsidian:me/a/b.md") == "a/b.md"
    assert one(spark, tx.parse_ref(F.col("c0"))["vault_id"], "http:me") is None
    assert one(spark, tx.slug(F.col("c0")), "project:a b") == "project-a-b"
    assert one(spark, tx.preview(F.col("c0"), 5), "a\n b cdef") == "a b c..."


def test_visibility(spark):
    rows = spark.createDataFrame([("global",), ("project:a",), ("persona:x",), ("persona:y",), (None,)], "scope string")
    seen = lambda v: [r["scope"] for r in rows.filter(v.predicate(F.col("scope"))).collect()]
    assert seen(resolve()) == ["global", "project:a"]
    assert seen(resolve(persona="x")) == ["global", "persona:x"]
    assert seen(resolve(scope="persona:y", persona="x")) == ["persona:y"]
    assert seen(resolve(scopes=["project:a"], persona="x")) == ["project:a", "persona:x"]
    assert seen(resolve(scopes=[])) == []
    assert seen(when_writing("persona:x")) == ["global", "persona:x"] and seen(when_writing("project:a")) == ["project:a"]


def test_validation(spark):
    schema = "content string, kind string, status string, scope string, salience double, tags array<string>"
    rows = spark.createDataFrame([("ok", "semantic", "active", "user:me", 0.5, ["a"]), (" ", "odd", "active", "planet:x", 1.5, [""]), (None, "semantic", "active", "global", 0.0, [])], schema)
    good, bad = va.split(rows, va.memory_reasons())
    assert good.count() == 1
    assert sorted(len(r["reasons"]) for r in bad.collect()) == [1, 5]


def test_hash_embedding_against_plain_python(spark):
    import hashlib

    def plain(features, dim):
        v = [0.0] * dim
        for f in features:
            value = int(hashlib.sha1(f.encode()).hexdigest()[:12], 16)
            v[value % dim] += 1.0 if (value >> 40) & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    rows = spark.createDataFrame([(1, "Ab c"), (2, "你好"), (3, "..."), (4, None)], "id long, text string")
    got = {r["id"]: list(r["vector"]) for r in vx.hash_embeddings(rows, 8).collect()}
    assert got[1] == pytest.approx(plain(["w:abc", "g:ab", "g:bc"], 8))
    assert got[2] == pytest.approx(plain(["c:你", "c:好", "b:你好"], 8))
    assert got[3] == got[4] == [0.0] * 8

"""Deterministic export: canonical JSON lines, and one Markdown file for each scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

MARKER = "generator: lorekeep-export"


def _sorted(value: Column, kind: T.DataType) -> Column:
    """value with the fields of its structs, and the keys of its maps, sorted at every level."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(value))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: _sorted(value[k], kind.valueType)))
    return value


def canonical(rows: DataFrame) -> Column:
    """A row of rows as JSON: keys sorted at every level, null fields written."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def json_lines(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_no, table, key, line): tables in the given order, rows by their key.

    Ranged partitioning on write keeps the order across files without a single sorting task.
    """
    parts = []
    for i, (name, (rows, key)) in enumerate(tables.items()):
        parts.append(rows.select(F.lit(i).alias("table_no"), F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), canonical(rows).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_json_lines(lines: DataFrame, path: str) -> None:
    """Files whose names sort as their lines do."""
    lines.repartitionByRange("table_no", "key").sortWithinPartitions("table_no", "key").select("line").write.mode("overwrite").text(path)


def _head(kind: str, *bits: Column) -> Column:
    """<!-- kind name=value ... -->, without the bits that are null."""
    return F.concat(F.lit(f"<!-- {kind} "), F.concat_ws(" ", *bits), F.lit(" -->"))


def _bit(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}="), value.cast("string"))


def provenance_bits(source: Column) -> list[Column]:
    """What a JSON source tells of a record's origin; missing fields give null."""
    given = lambda path: F.nullif(F.get_json_object(source, path), F.lit(""))
    events = F.nullif(F.array_join(F.from_json(F.get_json_object(source, "$.event_ids"), "array<string>"), ","), F.lit(""))
    return [_bit("origin", given("$.origin")), _bit("source_ref", given("$.external_ref")), _bit("events", events), _bit("content_hash", given("$.content_hash"))]


def memory_block(source: Column | None = None, generated_by: Column | None = None) -> Column:
    """id, kind, confidence, salience, created_at, scope, content, tags (columns) as one block."""
    head = _head("memory", *[_bit(n, F.col(c)) for n, c in (("id", "id"), ("kind", "kind"), ("confidence", "confidence"), ("salience", "salience"), ("created", "created_at"), ("scope", "scope"))], *([_bit("generated_by", generated_by)] if generated_by is not None else []), *(provenance_bits(source) if source is not None else []))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\ntags: "), F.array_join("tags", ", ")))
    return F.concat_ws("\n", head, F.coalesce("content", F.lit("")), tags, F.lit("<!-- /memory -->\n"))


def preference_block(source: Column | None = None) -> Column:
    """id, key, value, confidence, created_at, scope as one block; the value is JSON text."""
    head = _head("preference", *[_bit(n, F.col(c)) for n, c in (("id", "id"), ("key", "key"), ("confidence", "confidence"), ("created", "created_at"), ("scope", "scope"))], *(provenance_bits(source) if source is not None else []))
    return F.concat_ws("\n", head, F.concat("key", F.lit(" = "), F.col("value")), F.lit("<!-- /preference -->\n"))


def state_block(source: Column | None = None) -> Column:
    """id, project_id, state (JSON text), created_at, scope as one block."""
    head = _head("project-state", *[_bit(n, F.col(c)) for n, c in (("id", "id"), ("project", "project_id"), ("created", "created_at"), ("scope", "scope"))], *(provenance_bits(source) if source is not None else []))
    return F.concat_ws("\n", head, F.coalesce("state", F.lit("null")), F.lit("<!-- /project-state -->\n"))


def scope_names(scopes: DataFrame) -> DataFrame:
    """(scope, file): scopes whose slugs collide get a number from the second on."""
    slugs = scopes.select("scope").distinct().withColumn("slug", tx.slug(F.col("scope")))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("scope"))
    return slugs.withColumn("n", n).select("scope", F.when(F.col("n") == 1, F.concat("slug", F.lit(".md"))).otherwise(F.concat("slug", F.lit("-"), F.col("n").cast("string"), F.lit(".md"))).alias("file"))


KINDS = ("head", "memory", "preference", "project_state")


def mirror_blocks(memories: DataFrame, preferences: DataFrame, states: DataFrame, exported_at: str) -> DataFrame:
    """(file, scope, kind_no, place, id, block): a row for each block of the mirror, so that no scope is held whole.

    Active memories by id, current preferences by key, current states by project; each file begins
    with a head that counts them. Scopes without any row have no file. Rows with a source (JSON), or
    with generated_by, tell it in their block.
    """
    of = lambda rows, c="source": F.col(c) if c in rows.columns else None
    parts = [
        memories.filter("status = 'active'").select("scope", F.lit(1).alias("kind_no"), F.lpad(F.col("id").cast("string"), 20, "0").alias("place"), F.col("id").cast("string").alias("id"), memory_block(of(memories), of(memories, "generated_by")).alias("block")),
        preferences.select("scope", F.lit(2).alias("kind_no"), F.col("key").alias("place"), F.col("id").cast("string").alias("id"), preference_block(of(preferences)).alias("block")),
        states.select("scope", F.lit(3).alias("kind_no"), F.col("project_id").alias("place"), F.col("id").cast("string").alias("id"), state_block(of(states)).alias("block")),
    ]
    body = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = body.groupBy("scope").agg(*[F.count_if(F.col("kind_no") == i).alias(f"n{i}") for i in (1, 2, 3)])
    lines = ["---\ngenerated: true", MARKER, F.concat(F.lit("scope: "), "scope"), f"exported_at: {exported_at}", F.concat(F.lit("memory_count: "), F.col("n1").cast("string")), F.concat(F.lit("preference_count: "), F.col("n2").cast("string")), F.concat(F.lit("project_state_count: "), F.col("n3").cast("string")), "---\n"]
    head = counts.select("scope", F.lit(0).alias("kind_no"), F.lit("").alias("place"), F.lit("").alias("id"), F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("block"))
    return head.unionByName(body).join(scope_names(body), "scope").select("file", "scope", "kind_no", "place", "id", "block")


def readme() -> str:
    """The text beside the mirror's files."""
    return f"{MARKER}\n\nThese files are generated from the store. Edits here are lost with the next export; change the notes they come from.\n"


def write_mirror(blocks: DataFrame, path: str) -> None:
    """A folder for each scope's file, its parts in order; and one for the README."""
    ordered = blocks.repartitionByRange("file", "kind_no", "place", "id").sortWithinPartitions("file", "kind_no", "place", "id")
    ordered.select("file", F.col("block").alias("value")).write.mode("overwrite").partitionBy("file").text(path)
    spark = blocks.sparkSession
    spark.createDataFrame([(readme(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/file=README.md")


def format_hit() -> Column:
    """A hit (item_type, kind, content, key, value) as a line for a prompt."""
    return F.when(F.col("item_type") == "preference", F.concat(F.lit("preference "), "key", F.lit(" = "), F.coalesce("value", F.lit("null")))).otherwise(F.concat(F.lit("["), "kind", F.lit("] "), F.coalesce("content", F.lit(""))))


def prompt_context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, context): each query's formatted hits, best first; a query without hits says so. Hits are a top-k, so lists are short."""
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("- "), format_hit()).alias("line")))).alias("lines"))
    return queries.select("qid").join(listed, "qid", "left").select("qid", F.coalesce(F.array_join("lines.line", "\n"), F.lit("(no relevant memories)")).alias("context"))


def stale(existing: DataFrame, current: DataFrame) -> DataFrame:
    """Generated files (path, head) that the current export no longer writes; others are never named."""
    ours = existing.filter(F.instr(F.substring("head", 1, 400), MARKER) > 0)
    return ours.join(current.select("path").distinct(), "path", "left_anti").select("path")

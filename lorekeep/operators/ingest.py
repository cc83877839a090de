"""Markdown ingestion: parse, chunk, hash, route, and plan what is new.

The plan is one lazy DataFrame from scan to action; applying it appends its `ingest` rows, a dry
run shows them. The chunker folds over lines with a running size, which no window frame
expresses, so it runs in Arrow batches inside the tasks; everything else is Columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Limits, markers, type names, reserved keys, scope map and inline patterns of the note format.
MIN_CHARS, MAX_CHARS = 40, 2000
#: Bytes of notes that a task cuts at once.
CHUNKED_BYTES = 4 << 20
MARKERS = ("记住：", "记住:", "记下：", "记下:", "别忘了：", "别忘了:", "remember:", "remember that", "> [!memory]")
TYPES = {"preference": "preference", "pref": "preference", "project-state": "project_state", "project_state": "project_state", "projectstate": "project_state"}
RESERVED = ("type", "scope", "persona", "project", "project_id", "title", "key", "value", "state", "tags")
SCOPE_MAP = (("Projects/*", "project:{name}"), ("Projects/*/**", "project:{name}"), ("Personas/*", "persona:{name}"), ("Personas/*/**", "persona:{name}"))
PREFERENCE = r"(?im)(?:偏好|preference)\s*[:：]\s*([^\s=＝,，]+)\s*[=＝]\s*(\S.*?)\s*$"
PROJECT_STATE = r"(?im)(?:项目状态|project\s*state)\s*[:：]\s*([^\s=＝,，]+)\s*[=＝]\s*(\{.*\})\s*$"
_HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\s*\Z")


# The lines of a front matter block, told apart by what they start with: entries, their list items.
_ENTRY = r"(?m)^[ \t]*([^#\s:-][^:\n]*|-[^ :\n][^:\n]*):([^\n]*)"
_BLOCK = r"(?s)\A[ \t]*---[ \t]*\n(|.*?\n)[ \t]*(?:---|\.\.\.)[ \t]*(?:\n|\z)"
_QUOTED = r"\A(\"[^\"]*\"|'[^']*')"
_INTEGER, _NUMBER = r"\A[+-]?\d+\z", r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def _json_text(value: Column) -> Column:
    """A string as JSON, by Spark's own writer."""
    return F.regexp_replace(F.to_json(F.array(value)), r"\A\[|\]\z", "")


def _json_word(raw: Column) -> Column:
    """A front matter value that is no list, as JSON: quoted string, word, number or plain text."""
    text, low = F.trim(raw), F.lower(F.trim(raw))
    number = F.regexp_replace(F.regexp_replace(text, r"\A\+", ""), r"\A(-?)0+(?=\d)", "$1")
    return (
        F.when(F.regexp_extract(text, _QUOTED + r"\z", 1) != "", _json_text(F.substring(text, F.lit(2), F.length(text) - 2)))
        .when(low.isin("", "~", "null"), F.lit("null")).when(low.isin("true", "yes"), F.lit("true")).when(low.isin("false", "no"), F.lit("false"))
        .when(text.rlike(_INTEGER), number).when(text.rlike(_NUMBER), text.try_cast("double").cast("string")).otherwise(_json_text(text))
    )


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, _json_word), ","), F.lit("]"))


def _json_value(raw: Column, below: Column) -> Column:
    """The value of an entry as JSON: what stands behind its colon, less a comment, or the items below it."""
    text = F.trim(raw)
    quoted = F.regexp_extract(text, _QUOTED, 1)
    plain = F.when(quoted != "", quoted).otherwise(F.trim(F.regexp_replace(text, r"(\A| )#.*\z", "")))
    inside = F.regexp_extract(plain, r"(?s)\A\[(.*)\]\z", 1)
    inline = F.when(F.trim(inside) == "", F.lit("[]")).otherwise(_json_list(F.split(inside, ",")))
    items = F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]*- ([^\n]*)$"), F.lit(1))
    return F.when(plain == "", _json_list(items)).when(plain.rlike(r"(?s)\A\[.*\]\z"), inline).otherwise(_json_word(plain))


def front_json(block: Column) -> Column:
    """The entries of a front matter block as one JSON object, keys sorted; the last of equal keys counts.

    The block is cut at its entries: a piece holds an entry's value and the lines up to the next.
    """
    keys = F.transform(F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(1)), lambda k: F.trim(k))
    values = F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(2))
    below = F.split(block, _ENTRY)
    entries = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e, i: F.struct(e["k"].alias("k"), _json_value(e["v"], F.get(below, i + 1)).alias("v")))
    last = F.filter(entries, lambda e, i: (e["k"] != "") & ~F.exists(F.slice(keys, i + 2, F.size(keys)), lambda k: k == e["k"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(last), lambda e: F.concat(_json_text(e["k"]), F.lit(":"), e["v"])), ","), F.lit("}"))


def normal(text: str) -> str:
    return "\n".join(line.rstrip() for line in re.sub(r"\r\n?", "\n", text).split("\n")).strip("\n")


def _marked(text: str) -> bool:
    return text.strip().lower().startswith(MARKERS)


def paragraphs(text: str, with_code: bool = False) -> Iterator[tuple[tuple[str, ...], list[int], list[str]]]:
    """(heading path, line numbers from 1, lines) of each run of non-blank lines under one heading."""
    path: list[str] = []
    own: list[str] = []
    at: list[int] = []
    fence = ""
    for i, line in enumerate([*text.split("\n"), ""]):
        bare = line.strip()
        heading = None if fence else _HEADING.match(bare)
        hidden = bool(fence) or bare.startswith(("```", "~~~"))
        if fence:
            fence = "" if bare.startswith(fence) else fence
        elif hidden:
            fence = bare[:3]
        if hidden and not with_code:
            continue
        if own and (heading or not bare):
            yield tuple(path), at, own
            own, at = [], []
        if heading:
            path = [*path[: len(heading[1]) - 1], heading[2].strip()]
            yield tuple(path), [], []  # a new section: nothing is joined across it
        elif bare:
            own.append(line)
            at.append(i + 1)
    if own:
        yield tuple(path), at, own


def chunks(body: str, least: int = MIN_CHARS, most: int = MAX_CHARS, with_code: bool = False) -> list[tuple[int, list[str], str, int, int]]:
    """(ordinal, heading path, text, first line, last line) of a note.

    Paragraphs are gathered up to `most` characters; one that starts with a marker stands alone
    and may be short; other chunks under `least` characters are dropped.
    """
    out: list[tuple[int, list[str], str, int, int]] = []
    held: list[tuple[list[int], list[str]]] = []
    where: tuple[str, ...] = ()

    def close() -> None:
        lines = [line for _, p in held for line in p]
        text = normal("\n".join(lines))
        if held and len(text) >= (1 if _marked(text) else least):
            out.append((len(out), list(where), text, held[0][0][0], held[-1][0][-1]))
        held.clear()

    size = 0
    for path, at, lines in paragraphs(normal(body), with_code):
        length = len("\n".join(lines)) + 2
        alone = bool(lines) and _marked("\n".join(lines))
        if not lines or path != where or alone or (held and 0 < most < size + length):
            close()
            size, where = 0, path
        if lines:
            held.append((at, lines))
            size += length
        if alone:
            close()
            size = 0
    close()
    return out


_CHUNKED = "rel_path string, title string, front string, body_hash string, ordinal int, heading_path array<string>, text string, line_start int, line_end int"


def title_of(front_title: Column, body: Column, path: Column) -> Column:
    """The front matter's title, else the first heading of level one, else the file's name."""
    heading = F.regexp_extract(body, r"(?m)^[^\S\n]*# [^\S\n]*(\S.*?)[^\S\n]*$", 1)
    name = F.regexp_replace(F.substring_index(F.coalesce(path, F.lit("")), "/", -1), r"(?<=.)\.[^.]*\z", "")
    given = F.trim(front_title)
    return F.when(given != "", given).when(heading != "", heading).otherwise(name)


def parse(notes: DataFrame) -> DataFrame:
    """notes (rel_path, text) with title, front matter as JSON, and body; all of it Columns."""
    clean = tx.one_line_end(F.coalesce(F.col("text").cast("string"), F.lit("")))
    clean = F.when(clean.startswith("\ufeff"), F.regexp_replace(clean, r"\A\x{FEFF}", "")).otherwise(clean)
    split = notes.select(F.col("rel_path").cast("string").alias("rel_path"), clean.alias("clean"))
    has = F.col("clean").rlike(_BLOCK)
    split = split.select("rel_path", F.when(has, F.regexp_extract("clean", _BLOCK, 1)).otherwise("").alias("block"), F.when(has, F.regexp_replace("clean", _BLOCK, "")).otherwise(F.col("clean")).alias("body"))
    named = split.select("rel_path", "body", F.when(F.col("block") == "", "{}").otherwise(front_json(F.col("block"))).alias("front"))
    # A title that is no string doesn't count: a VARIANT tells them apart.
    value = F.try_variant_get(F.try_parse_json("front"), "$.title", "string")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("front"), "$.title", "variant"))
    return named.select("rel_path", title_of(F.when(kind == "STRING", value), F.col("body"), F.col("rel_path")).alias("title"), "front", "body")


def chunked(parsed: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """A row for each chunk; a note of a declared type is one chunk."""
    schema = pa.schema([("rel_path", pa.string()), ("title", pa.string()), ("front", pa.string()), ("body_hash", pa.string()), ("ordinal", pa.int32()), ("heading_path", pa.list_(pa.string())), ("text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(3)), 0)).astype(np.int64))
            cut = np.flatnonzero(np.diff(size // CHUNKED_BYTES, prepend=-1)).tolist()
            for start, stop in zip(cut, [*cut[1:], batch.num_rows]):  # noqa: B905 - no rows, no part
                yield part(batch.slice(start, stop - start))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for path, title, front, body, sha, declared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if declared:
                text = normal(body)
                own = [(0, [title], text, 1, text.count("\n") + 1)] if len(text) >= least else []
            else:
                own = chunks(body, least, most)
            rows += [(path, title, front, sha, *c) for c in own]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    declared = F.coalesce(F.lower(front("type")).isin(*TYPES), F.lit(False))
    return parsed.select("rel_path", "title", "front", "body", tx.content_hash(F.col("body")).alias("body_hash"), declared.alias("declared")).mapInArrow(run, _CHUNKED).withColumn("content_hash", tx.content_hash(F.col("text")))


def mapped_scope(path: Column, scope_map: Sequence[tuple[str, str]] = SCOPE_MAP) -> Column:
    """The scope of the first pattern that the path matches; {name} is what its first * stands for."""
    out = F.lit(None).cast("string")
    for pattern, template in reversed(tuple(scope_map)):
        first = [True]

        def one(m: re.Match, first=first) -> str:
            if m[0] == "**":
                return ".*"
            if m[0] == "*":
                group, first[0] = ("([^/]+)" if first[0] else "[^/]*"), False
                return group
            return "[^/]" if m[0] == "?" else re.escape(m[0])

        regex = "(?i)^" + re.sub(r"\*\*|.", one, pattern) + "$"
        before, _, after = template.partition("{name}")
        named = F.concat(F.lit(before), F.regexp_extract(path, regex, 1), F.lit(after)) if "{name}" in template and not first[0] else F.lit(template)
        out = F.when(path.rlike(regex), named).otherwise(out)
    return out


def front(name: str) -> Column:
    """A front matter value as text, null if it is missing, blank or no string."""
    value = F.trim(F.get_json_object("front", f"$['{name}']"))
    return F.when(value != "", value)


def scope_of(path: Column, default: str = "global") -> Column:
    """Front matter scope, persona, project; then the path; then the default."""
    return F.coalesce(front("scope"), F.concat(F.lit("persona:"), front("persona")), F.concat(F.lit("project:"), front("project")), mapped_scope(path), F.lit(default))


def route_of(text: Column) -> Column:
    """STRUCT<route, key, value> of a chunk without a declared type."""
    # Both forms need a sign, and a state needs a brace: without them no expression is tried.
    signed = F.contains(text, F.lit("=")) | F.contains(text, F.lit("＝"))
    state = F.when(signed & F.contains(text, F.lit("{")), F.regexp_extract(text, PROJECT_STATE, 2)).otherwise("")
    is_state = F.coalesce(F.schema_of_variant(F.try_parse_json(state)).startswith("OBJECT"), F.lit(False))
    marked = text.rlike("(?i)" + "|".join(re.escape(m) for m in MARKERS if m.isascii()))
    for m in MARKERS:  # others have no case
        marked = marked if m.isascii() else marked | F.contains(text, F.lit(m))

    def made(route: str, key: Column | None = None, value: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(route).alias("route"), (none if key is None else key).alias("key"), (none if value is None else value).alias("value"))

    return (
        F.when(is_state, made("project_state", F.regexp_extract(text, PROJECT_STATE, 1), state))
        .when(signed & text.rlike(PREFERENCE), made("preference", F.regexp_extract(text, PREFERENCE, 1), F.regexp_extract(text, PREFERENCE, 2)))
        .when(marked, made("declaration")).otherwise(made("knowledge"))
    )


def routed(chunk_rows: DataFrame) -> DataFrame:
    """chunks with scope, route, key and value."""
    kind = F.lower(front("type"))
    declared = F.lit(None).cast("string")
    for name, target in TYPES.items():
        declared = F.when(kind == name, F.lit(target)).otherwise(declared)
    rest = F.map_filter(F.from_json("front", "map<string,string>"), lambda k, v: ~k.isin(*RESERVED) & v.isNotNull())
    given = F.get_json_object("front", "$.state")
    given = F.when(F.schema_of_variant(F.try_parse_json(given)).startswith("OBJECT"), given)
    state = F.coalesce(given, F.when(F.size(rest) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rest))))))
    project = F.coalesce(front("project"), front("project_id"))
    inline = route_of(F.col("text"))
    null = F.lit(None).cast("string")
    as_struct = lambda r, k, v: F.struct(F.lit(r).alias("route"), k.alias("key"), v.alias("value"))
    value = F.get_json_object("front", "$.value")
    route = (
        F.when((declared == "project_state") & project.isNotNull() & state.isNotNull(), as_struct("project_state", project, state)).when((declared == "preference") & front("key").isNotNull() & F.coalesce(F.array_contains(F.json_object_keys("front"), "value"), F.lit(False)), as_struct("preference", front("key"), value))
        .when(declared.isNotNull(), as_struct("knowledge", null, null)).otherwise(inline)
    )
    return chunk_rows.withColumn("scope", scope_of(F.col("rel_path"))).withColumn("r", route).select("*", "r.route", "r.key", "r.value").drop("r")


def plan(chunk_rows: DataFrame, seen: DataFrame) -> DataFrame:
    """chunks with document status (new, changed, unchanged) and action (ingest, skip).

    seen: (rel_path, body_hash, content_hash) of what was ingested before, any version.
    """
    documents = seen.select("rel_path", "body_hash").distinct().withColumn("same_body", F.lit(True))
    paths = seen.select("rel_path").distinct().withColumn("known_path", F.lit(True))
    known = seen.select("rel_path", "content_hash").distinct().withColumn("known_chunk", F.lit(True))
    joined = chunk_rows.join(documents, ["rel_path", "body_hash"], "left").join(paths, "rel_path", "left").join(known, ["rel_path", "content_hash"], "left")
    status = F.when(F.coalesce("same_body", F.lit(False)), "unchanged").when(F.coalesce("known_path", F.lit(False)), "changed").otherwise("new")
    action = F.when((status == "unchanged") | F.coalesce("known_chunk", F.lit(False)), "skip").otherwise("ingest")
    return joined.withColumn("status", status).withColumn("action", action).drop("same_body", "known_path", "known_chunk")

"""From utterances to records: rules, proposals of several extractors, acceptance, provenance, routing.

Everything is Column expressions over a table of utterances, so extraction is a projection and
the duplicate check an anti join instead of a search per candidate.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The rule vocabulary, in the order it is tried, and the policy's thresholds.
VERBS = ("请记住", "别忘了", "记住", "记下", "please remember", "remember that", "remember", "note that", "note")
TRIGGERS = (
    ("项目状态", "project_state"), ("project state", "project_state"), ("project", "project_state"), ("偏好", "preference"), ("preference", "preference"), ("pref", "preference"),
    ("身份", "identity"), ("identity", "identity"), ("persona", "identity"), ("事件", "episodic"), ("episodic", "episodic"),
)
SEPARATORS = "：:,，、;；= \t\n"
MIN_CONFIDENCE, MIN_CHARS = 0.35, 4
_SEP = "[" + re.escape(SEPARATORS) + "]"


def _starts(prefix: str) -> str:
    """The regular expression of a prefix with what separates it: an ASCII word must end there."""
    end = "" if any(ord(c) > 0x3000 for c in prefix) else rf"(?={_SEP}|\z)"
    return rf"(?is)\A{re.escape(prefix)}{end}{_SEP}*"


def _first(text: Column, prefixes: tuple[str, ...]) -> Column:
    """The first prefix that the text starts with, or null."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for p in prefixes:
        found = found.when(text.rlike(_starts(p)), F.lit(p))
    return found


def _after(text: Column, prefix: Column, prefixes: tuple[str, ...]) -> Column:
    rest = F.when(F.lit(False), text)
    for p in prefixes:
        rest = rest.when(prefix == p, F.regexp_replace(text, _starts(p), ""))
    return rest.otherwise(text)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _assignment(raw: Column) -> Column:
    """STRUCT<key, value> of 'key = value'; '=' is tried before the full-width sign; null if neither splits."""
    out = F.lit(None).cast("struct<key:string,value:string>")
    for sign in ("＝", "="):
        at = F.instr(raw, sign)
        key, value = _strip(raw.substr(F.lit(1), at - 1)), _strip(raw.substr(at + 1, F.length(raw)))
        out = F.when((at > 1) & (key != "") & (value != ""), F.struct(key.alias("key"), value.alias("value"))).otherwise(out)
    return out


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """df and columns that later expressions read as they are: a generated row is not folded into them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def extract(utterances: DataFrame) -> DataFrame:
    """utterances (id, text, scope) with target, kind, key, value, content and the reason where nothing forms."""
    names = tuple(t for t, _ in TRIGGERS)
    df = _with(utterances.select("id", "text", "scope"), stripped=_strip(F.coalesce(F.col("text"), F.lit(""))))
    df = _with(df, verb=_first(F.col("stripped"), VERBS))
    df = _with(df, payload=_strip(_after(F.col("stripped"), F.col("verb"), VERBS)))
    df = _with(df, trigger=_first(F.col("payload"), names))
    df = _with(df, remainder=_strip(_after(F.col("payload"), F.col("trigger"), names)))
    kind = F.when(F.col("trigger").isNull(), F.lit("semantic"))
    for name, target in TRIGGERS:
        kind = kind.when(F.col("trigger") == name, F.lit(target))
    df = _with(df, route=kind, pair=_assignment(F.col("remainder")))
    typed = F.col("route").isin("preference", "project_state")
    state_ok = F.coalesce(F.schema_of_variant(F.try_parse_json("pair.value")).startswith("OBJECT"), F.lit(False))
    reason = (
        F.when(F.col("stripped") == "", "empty utterance").when(F.col("payload") == "", "nothing after the trigger").when(F.col("trigger").isNull() & F.col("verb").isNull(), "no explicit instruction")
        .when(F.col("remainder") == "", "empty payload").when((F.col("route") == "preference") & F.col("pair").isNull(), "a preference needs key = value").when((F.col("route") == "project_state") & F.col("pair").isNull(), "a project state needs project_id = object")
        .when((F.col("route") == "project_state") & ~state_ok, "a project state must be a JSON object")
    )
    df = _with(df, reason=reason)
    formed = F.col("reason").isNull()
    return df.select(
        "id", "scope",
        F.when(formed, F.when(typed, F.col("route")).otherwise(F.lit("memory"))).alias("target"), F.when(formed & ~typed, F.col("route")).alias("kind"),
        F.when(formed & typed, F.col("pair.key")).alias("key"), F.when(formed & typed, F.col("pair.value")).alias("value"), F.when(formed & ~typed, F.col("remainder")).alias("content"), "reason",
    )


def rule_candidates(utterances: DataFrame) -> DataFrame:
    """The rules' proposals in the columns of candidates.extract, at full confidence; a row without a target says why nothing forms."""
    e = extract(utterances)
    none = F.lit(None)
    return e.select(
        "id", "scope", F.lit(0).alias("ordinal"), "target", F.when(F.col("target").isNotNull(), F.lit("add")).alias("operation"), "kind", "key", "value", "content", F.when(F.col("target") == "memory", F.lit("user:self")).alias("subject"),
        none.cast("array<string>").alias("tags"), F.when(F.col("target") == "memory", F.lit(0.5)).alias("salience"), F.when(F.col("target").isNotNull(), F.lit(1.0)).alias("confidence"), none.cast("string").alias("supersedes"), "reason", F.lit("rules").alias("origin"),
    )


def collect(*proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, reasons): the proposals of several extractors, in the order given, without repeats in an utterance.

    An extractor that found nothing, or failed, has left a row with a reason; the others count all the same.
    """
    every = None
    for rank, rows in enumerate(proposals):
        ranked = rows.withColumn("extractor", F.lit(rank))
        every = ranked if every is None else every.unionByName(ranked)
    reasons = every.filter("target IS NULL AND reason IS NOT NULL").select("id", "extractor", "origin", "reason")
    return dedupe(every.filter("target IS NOT NULL"), within=("id",), order=("extractor", "ordinal")), reasons


def dedupe(candidates: DataFrame, within: Sequence[str] = ("scope",), order: Sequence[str] = ("id",)) -> DataFrame:
    """The first of equal candidates: same target, operation, superseded id and normalised content, or key where there is none."""
    name = tx.duplicate_form(F.coalesce(F.when(F.col("content") != "", F.col("content")), F.col("key")))
    named = candidates.withColumn("_name", F.sha2(name, 256))
    w = Window.partitionBy(*within, "target", "operation", "supersedes", "_name").orderBy(*order)
    return named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_name", "_n")


def judge(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidates with accepted and verdict; the first rule that refuses is the verdict.

    candidates: id, scope, target, operation, confidence, content, key, supersedes. existing:
    id, scope, content and maybe status of stored memories: only active ones are duplicates, and
    any may be superseded. Both look-ups are joins, on the content and on the id, so no candidate
    searches the store.
    """
    active = existing.filter("status = 'active'") if "status" in existing.columns else existing
    held = active.select(F.col("scope").alias("held_scope"), tx.duplicate_form(F.col("content")).alias("held")).distinct().withColumn("is_held", F.lit(True))
    known = existing.select(F.col("id").cast("string").alias("known")).distinct().withColumn("is_known", F.lit(True))
    form = tx.duplicate_form(F.col("content"))
    df = candidates.withColumn("_form", form).join(held, (F.col("scope") == F.col("held_scope")) & (F.col("_form") == F.col("held")), "left").join(known, F.col("supersedes") == F.col("known"), "left")
    blank = F.coalesce(_strip(F.coalesce("key", F.lit(""))) == "", F.lit(True))
    verdict = (
        F.when(F.col("operation") == "noop", "not worth remembering").when(F.col("confidence") < MIN_CONFIDENCE, "low confidence").when((F.col("target") == "memory") & (F.length("_form") < MIN_CHARS), "too short")
        .when((F.col("target") == "memory") & F.coalesce("is_held", F.lit(False)), "duplicate").when((F.col("target") != "memory") & blank, "no key")
        .when((F.col("operation") == "supersede") & F.col("supersedes").isNotNull() & F.col("is_known").isNull(), "unknown supersede target").otherwise("accepted")
    )
    return df.withColumn("verdict", verdict).withColumn("accepted", F.col("verdict") == "accepted").drop("_form", "held_scope", "held", "is_held", "known", "is_known")


def routed(judged: DataFrame) -> dict[str, DataFrame]:
    """The accepted candidates by the log they are appended to."""
    good = judged.filter("accepted")
    return {target: good.filter(F.col("target") == target) for target in ("memory", "preference", "project_state")}


def provenance() -> Column:
    """A record's source as a JSON object: how it was formed, its event, and then what the caller gives (column `given`).

    What is given replaces the record's own fields; an origin that it replaces stays as formed_by.
    """
    own = tx.json_fields(F.to_json(F.struct("origin", "reason", F.array("event_id").alias("event_ids"))))
    given = tx.json_fields(F.col("given"))
    formed_by = tx.json_fields(F.when(F.map_contains_key(given, "origin"), F.to_json(F.struct(F.col("origin").alias("formed_by")))))
    return tx.json_merged(own, formed_by, given)


def formed(utterances: DataFrame, candidates: DataFrame, existing: DataFrame, once: bool = False) -> dict[str, DataFrame]:
    """event, outcome, memory, preference and project_state rows of utterances (id, event_id, text, scope, and given: JSON or null).

    Every utterance is an event, whatever comes of it. Candidates are judged; accepted ones become
    rows of their log with the event as provenance. Writing the tables is the caller's choice:
    what a dry run shows and what is committed are the same rows. With `once`, what is judged is
    written to a table that all of them read. utterances may have a place and an `at`: the order of
    their records in a commit, and the time in their ids.
    """
    from .scratch import written
    from .store import sortable_id

    events = utterances.select(F.col("event_id").alias("id"), "scope", F.col("text").alias("content"), F.col("given").alias("metadata"))
    judged = judge(candidates, existing).join(utterances.select("id", "event_id", "given", *[c for c in ("place", "at") if c in utterances.columns]), "id")
    name = tx.duplicate_form(F.coalesce("content", "key"))
    at = F.col("at") if "at" in judged.columns else None
    rows = judged.withColumn("item_id", sortable_id(F.col("target"), F.col("event_id"), F.col("operation"), F.coalesce("supersedes", F.lit("")), name, at=at)).withColumn("source", provenance())
    place = F.concat("place", F.lit("-"), F.lpad(F.col("ordinal").cast("string"), 6, "0")) if "place" in rows.columns else F.lit("")
    rows = rows.drop("at").withColumn("place", place)
    rows = written(rows, "formed") if once else rows
    outcome = rows.select("id", "target", "operation", "accepted", F.when(F.col("accepted"), F.col("reason")).otherwise(F.col("verdict")).alias("reason"), F.when(F.col("accepted"), F.col("item_id")).alias("item_id"))
    good = routed(rows)
    return {
        "event": events, "outcome": outcome,
        "memory": good["memory"].select(F.col("item_id").alias("id"), "scope", "content", "kind", "subject", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("salience", F.lit(0.5)).alias("salience"), "confidence", "supersedes", F.lit("active").alias("status"), "source", "place"),
        "preference": good["preference"].select(F.col("item_id").alias("id"), "scope", "key", "value", "confidence", "source", "place"),
        "project_state": good["project_state"].select(F.col("item_id").alias("id"), F.concat(F.lit("project:"), "key").alias("scope"), F.col("key").alias("project_id"), F.col("value").alias("state"), "source", "place"),
    }

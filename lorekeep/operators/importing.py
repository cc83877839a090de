"""Importing notes: what a run would do, what it did, and the rows it appends.

A dry run and an import are the same plan; the import also writes it, as one batch of the store.
Each chunk gives an event first, whatever else comes of it; events carry the hashes by which the
next run knows what it has seen.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import validation as va
from . import candidates as cd
from . import formation, ingest, records as rc, scratch, store

ORIGIN, SOURCE = "notes", "note-import"
SCHEMAS = rc.SCHEMAS


def documents(parsed: DataFrame, planned: DataFrame, seen: DataFrame) -> DataFrame:
    """(rel_path, body_hash, status, n_chunks, n_ingest, n_skipped) of every note: new, changed, unchanged or empty."""
    chunks = planned.groupBy("rel_path", "body_hash").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("action") == "ingest").alias("n_ingest"))
    bodies = seen.select("rel_path", "body_hash").distinct().withColumn("same", F.lit(True))
    paths = seen.select("rel_path").distinct().withColumn("known", F.lit(True))
    notes = parsed.select("rel_path", tx.content_hash(F.col("body")).alias("body_hash"))
    joined = notes.join(bodies, ["rel_path", "body_hash"], "left").join(paths, "rel_path", "left").join(chunks, ["rel_path", "body_hash"], "left")
    status = F.when(F.col("same"), "unchanged").when(F.col("n_chunks").isNull(), "empty").when(F.col("known"), "changed").otherwise("new")
    fresh = F.col("status") != "unchanged"
    told = joined.withColumn("status", status).fillna(0, ["n_chunks", "n_ingest"])
    return told.select("rel_path", "body_hash", "status", *[F.when(fresh, c).otherwise(0).cast("long").alias(n) for n, c in (("n_chunks", F.col("n_chunks")), ("n_ingest", F.col("n_ingest")), ("n_skipped", F.col("n_chunks") - F.col("n_ingest")))])


def _metadata(vault_id: str, ingested_at: str | None) -> Column:
    fields = {
        "origin": F.lit(ORIGIN), "vault_id": F.lit(vault_id), "external_ref": F.col("ref"), "document_title": F.col("title"), "document_hash": F.col("body_hash"), "content_hash": F.col("content_hash"),
        "heading_path": F.col("heading_path"), "line_start": F.col("line_start"), "line_end": F.col("line_end"), "ingested_at": F.lit(ingested_at), "route": F.col("route"),
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": "false"})


def _given(vault_id: str) -> Column:
    """What an imported record's source tells of its note."""
    names = {"origin": F.lit(ORIGIN), "vault_id": F.lit(vault_id), "external_ref": F.col("ref"), "document_title": F.col("title"), "heading_path": F.col("heading_path"), "content_hash": F.col("content_hash"), "document_hash": F.col("body_hash")}
    return F.to_json(F.struct(*[c.alias(n) for n, c in names.items()]))


def records(planned: DataFrame, vault_id: str, existing: DataFrame, responses: DataFrame | None = None, ingested_at: str | None = None, at: Column | None = None) -> dict[str, DataFrame]:
    """The complete rows of a plan's `ingest` chunks by relation, and the outcome of each candidate.

    Preferences and project states are written as declared; a declaration is formed by the rules,
    and a model isn't asked again; knowledge is formed from responses (event_id, raw, context_ids)
    where a model gave any, and is an event alone where none did. at: the commit's time, which the
    rows and their ids bear. What the chunks give, and what is judged, are written once.
    """
    ref = tx.external_ref(F.lit(vault_id), F.col("rel_path"))
    todo = planned.filter("action = 'ingest'").withColumns({"ref": ref, "at": F.lit(None).cast("timestamp") if at is None else at})
    todo = todo.withColumn("event_id", store.sortable_id(F.lit("evt"), F.col("ref"), F.col("content_hash"), F.col("ordinal").cast("string"), at=None if at is None else F.col("at"))).withColumn("given", _given(vault_id))
    todo = scratch.written(todo.withColumn("place", F.concat("rel_path", F.lit("#"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))), "chunks")
    event = todo.select(F.col("event_id").alias("id"), F.col("ref").alias("session_id"), "scope", F.lit("document").alias("kind"), F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(SOURCE).alias("source"), _metadata(vault_id, ingested_at).alias("metadata"), "place")
    source = tx.json_merged(tx.json_fields(F.col("given")), tx.json_fields(F.to_json(F.struct(F.array("event_id").alias("event_ids")))))
    typed = todo.withColumn("source", source)
    said = todo.filter(F.col("route").isin("declaration", "knowledge")).select(F.col("event_id").alias("id"), "event_id", "text", "scope", "given", "route", "place", *(["at"] if at is not None else []))
    proposals = [formation.rule_candidates(said.filter("route = 'declaration'"))]
    if responses is not None:
        asked = said.filter("route = 'knowledge'").join(responses.select(F.col("event_id").alias("of_event"), "raw", "context_ids"), F.col("id") == F.col("of_event"))
        proposals.append(cd.extract(asked))
    found, _ = formation.collect(*proposals)
    made = formation.formed(said, found, existing, once=True)
    own_id = lambda name: store.sortable_id(F.lit(name), F.col("event_id"), at=None if at is None else F.col("at")).alias("id")
    preference = typed.filter("route = 'preference'").select(own_id("preference"), "scope", "key", "value", F.lit(1.0).alias("confidence"), "source", "place")
    state = typed.filter("route = 'project_state'").select(own_id("project_state"), "scope", F.col("key").alias("project_id"), F.col("value").alias("state"), "source", "place")
    out = {"event": event, "memory": made["memory"], "preference": preference.unionByName(made["preference"]), "project_state": state.unionByName(made["project_state"])}
    return {"outcome": made["outcome"]} | {name: rc.completed(name, rows, at) for name, rows in out.items()}


def counters(docs: DataFrame, made: Mapping[str, DataFrame]) -> DataFrame:
    """One row that sums a run up."""
    status = lambda s: F.count_if(F.col("status") == s)
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = docs.agg(
        F.count("*").alias("documents_scanned"), status("unchanged").alias("documents_unchanged"), status("new").alias("documents_new"), status("changed").alias("documents_changed"),
        whole("n_chunks").alias("chunks_planned"), whole("n_skipped").alias("chunks_skipped_seen"), whole("n_ingest").alias("chunks_ingested"),
    )
    for name, relation in (("events_created", "event"), ("memories_created", "memory"), ("preferences_set", "preference"), ("project_states_set", "project_state")):
        out = out.crossJoin(F.broadcast(made[relation].agg(F.count("*").alias(name))))  # one row beside one row
    verdicts = made["outcome"].agg(F.count_if("accepted").alias("candidates_accepted"), F.count_if(~F.col("accepted")).alias("candidates_rejected"))
    return out.crossJoin(F.broadcast(verdicts))


def apply(spark: SparkSession, root: str, batch: str, made: Mapping[str, DataFrame], since: int | None = None) -> bool:
    """Append a run's rows to the store at root, all or none; False if the batch is there already."""
    return store.append(spark, root, batch, {name: made[name] for name in SCHEMAS}, {name: rc.reasons(name) for name in SCHEMAS}, since)


def run(spark: SparkSession, root: str, batch: str, notes: DataFrame, vault_id: str, at: Column | None = None, responses: DataFrame | None = None) -> DataFrame:
    """Import notes (rel_path, text) into the store at root as one batch; gives the run's counters.

    The plan is made from the store as it is; a batch that another writer commits meanwhile is a
    Conflict, and the run is then repeated by the caller. A chunk that the store's gate would refuse
    stays out, with all it would give, and counts as skipped. A batch that is there already counts as
    it would now: all unchanged.
    """
    since = store.last(spark, root)
    known = scratch.written(seen(spark, root), "seen")
    parsed = scratch.written(ingest.parse(notes), "notes")
    planned = ingest.plan(ingest.routed(ingest.chunked(parsed)), known)
    refused = (F.col("action") == "ingest") & va.text(F.col("text"), "content").isNotNull()
    planned = scratch.written(planned.withColumn("action", F.when(refused, "refuse").otherwise(F.col("action"))), "plan")
    made = records(planned, vault_id, store.read(spark, root, "memory", SCHEMAS["memory"], since), responses, at=at)
    told = scratch.written(counters(documents(parsed, planned, known), made), "counters")
    apply(spark, root, batch, made, since)
    return told


def seen(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, body_hash, content_hash) of what the store's events were made from."""
    events = store.read(spark, root, "event", SCHEMAS["event"])
    return events.filter(F.col("source") == SOURCE).select(tx.parse_ref(F.col("session_id"))["rel_path"].alias("rel_path"), F.get_json_object("metadata", "$.document_hash").alias("body_hash"), F.get_json_object("metadata", "$.content_hash").alias("content_hash"))

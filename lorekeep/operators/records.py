"""The records of a store: their columns, what is filled in at a commit, and the gate each row passes.

Whatever makes rows (an import, a formation, a caller) gives the columns it knows; completed() adds
the rest, the commit's time among them, so that retrieval, versions and mirror read rows of any
origin. The order of a record's versions is the commit's time, its number, and the place in it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import validation as va
from . import store

SCHEMAS: Mapping[str, str] = {
    "event": "id string, session_id string, scope string, kind string, role string, content string, source string, metadata string, created_at timestamp, place string",
    "memory": "id string, scope string, content string, kind string, subject string, structured string, tags array<string>, salience double, confidence double, supersedes string, status string, source string, superseded_by string, generated_by string, "
    "valid_from timestamp, valid_to timestamp, created_at timestamp, updated_at timestamp, revision int, place string",
    "preference": "id string, scope string, key string, value string, statement string, confidence double, source string, created_at timestamp, place string",
    "project_state": "id string, scope string, project_id string, state string, note string, source string, created_at timestamp, place string",
}
#: What tells versions of one key apart, last of all the id.
VERSION_ORDER = ("created_at", "seq", "place", "id")
KEYS: Mapping[str, tuple[str, ...]] = {"preference": ("scope", "key"), "project_state": ("project_id", "scope")}


def columns(relation: str) -> dict[str, str]:
    """Name and type of each column of a relation."""
    return dict(c.split(" ", 1) for c in SCHEMAS[relation].split(", "))


def _defaults(relation: str, at: Column) -> dict[str, Callable[[], Column]]:
    text = lambda v: lambda: F.lit(v)
    of = {
        "event": {"kind": text("message"), "role": text("user"), "scope": text("global"), "source": text("cli")},
        "memory": {
            "kind": text("semantic"), "scope": text("global"), "subject": text("user:self"), "tags": lambda: F.array().cast("array<string>"), "salience": lambda: F.lit(0.5), "confidence": lambda: F.lit(1.0),
            "status": text("active"), "updated_at": lambda: at, "revision": lambda: F.lit(1),
        },
        "preference": {"scope": text("global"), "confidence": lambda: F.lit(1.0), "statement": lambda: F.concat("key", F.lit(" = "), "value")},
        "project_state": {"scope": lambda: F.concat(F.lit("project:"), "project_id")},
    }
    return of[relation] | {"created_at": lambda: at, "place": text("")}


def completed(relation: str, rows: DataFrame, at: Column | None = None) -> DataFrame:
    """rows with every column of the relation: the given ones, defaults for what is missing or null, else null."""
    at = F.lit(None).cast("timestamp") if at is None else at
    filled = store.with_defaults(rows, _defaults(relation, at))
    return filled.select(*[(F.col(c) if c in filled.columns else F.lit(None)).cast(kind).alias(c) for c, kind in columns(relation).items()])


def reasons(relation: str) -> Column:
    """Every reason why a completed row may not be written."""
    name = va.text(F.col("id"), "id", va.MAX_SHORT)
    json = lambda c: F.when(F.col(c).isNotNull(), va.json_object(F.col(c), c))
    of = {
        "event": [va.text(F.col("content"), "content"), va.one_of(F.col("role"), "role", va.ROLES), va.one_of(F.col("kind"), "kind", va.EVENT_KINDS), json("metadata"), va.text(F.col("source"), "source", va.MAX_SHORT)],
        "memory": [
            va.text(F.col("content"), "content"), va.text(F.col("subject"), "subject", va.MAX_SHORT), va.one_of(F.col("kind"), "kind", va.MEMORY_KINDS), va.one_of(F.col("status"), "status", va.STATUSES), va.unit_float(F.col("salience"), "salience"),
            va.unit_float(F.col("confidence"), "confidence"), va.tag_list(F.col("tags")), json("structured"), json("source"), F.when(F.col("revision") < 1, F.lit("revision is less than 1")),
        ],
        "preference": [va.text(F.col("key"), "key", va.MAX_SHORT), va.text(F.col("statement"), "statement", may_be_empty=True), va.unit_float(F.col("confidence"), "confidence"), json("source")],
        "project_state": [va.text(F.col("project_id"), "project_id", va.MAX_SHORT), va.json_object(F.col("state"), "state"), json("source")],
    }
    return F.array_compact(F.array(name, va.scope(F.col("scope")), *of[relation]))


def json_value(value: Column) -> Column:
    """A preference's value as JSON text: itself if it is JSON, else the string."""
    return F.to_json(tx.json_or_text(value))

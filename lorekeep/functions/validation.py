"""Row checks: each gives the reason a row is refused, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits, enumerations and the scope grammar.
MAX_CONTENT, MAX_SHORT, MAX_TAG, MAX_TAGS = 20000, 512, 64, 32
ROLES = ("user", "assistant", "system", "tool")
EVENT_KINDS = ("message", "note", "system", "document")
MEMORY_KINDS = ("semantic", "episodic", "identity")
STATUSES = ("active", "superseded", "archived", "deleted")
SCOPE_PREFIXES = ("project", "session", "device", "user", "org", "persona")
SCOPE = r"^[a-z][a-z0-9_]*:[A-Za-z0-9][A-Za-z0-9._:-]*$"


def text(value: Column, name: str, most: int = MAX_CONTENT, may_be_empty: bool = False) -> Column:
    reason = F.when(value.isNull(), F.lit(f"{name} is missing"))
    if not may_be_empty:
        reason = reason.when(F.trim(F.regexp_replace(value, r"\s+", " ")) == "", F.lit(f"{name} is empty"))
    return reason.when(F.length(value) > most, F.lit(f"{name} is too long")).when(value.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit(f"{name} holds control characters"))


def one_of(value: Column, name: str, allowed: tuple[str, ...]) -> Column:
    return F.when(~F.coalesce(value.isin(*allowed), F.lit(False)), F.lit(f"{name} is none of the allowed values"))


def scope(value: Column) -> Column:
    clean = F.trim(value)
    known = F.substring_index(clean, ":", 1).isin(*SCOPE_PREFIXES)
    return F.when(~F.coalesce((clean == "global") | (clean.rlike(SCOPE) & known), F.lit(False)), F.lit("scope is not valid"))


def unit_float(value: Column, name: str) -> Column:
    return F.when(value.isNull() | F.isnan(value) | ~value.between(0.0, 1.0), F.lit(f"{name} is not within 0 and 1"))


def json_object(value: Column, name: str) -> Column:
    return F.when(~F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False)), F.lit(f"{name} is no JSON object"))


def tag_list(value: Column) -> Column:
    return F.when(F.size(F.array_distinct(value)) > MAX_TAGS, F.lit("too many tags")).when(F.exists(value, lambda t: t.isNull() | (F.length(t) > MAX_TAG) | (F.trim(t) == "")), F.lit("a tag is not valid"))


def iso_time(value: Column, name: str) -> Column:
    return F.when(value.isNotNull() & F.try_to_timestamp(value).isNull(), F.lit(f"{name} is no ISO-8601 time"))


def memory_reasons() -> Column:
    """Every reason a memory row is refused; an empty array accepts it."""
    checks = [text(F.col("content"), "content"), one_of(F.col("kind"), "kind", MEMORY_KINDS), one_of(F.col("status"), "status", STATUSES), scope(F.col("scope")), unit_float(F.col("salience"), "salience"), tag_list(F.col("tags"))]
    return F.array_compact(F.array(*checks))


def split(rows: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with reasons): the refused are kept, not thrown away."""
    judged = rows.withColumn("reasons", reasons)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)

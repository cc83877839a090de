"""Strict parsing of model responses into candidate records.

A response is a JSON object, maybe inside a fence or prose, with closed key sets. Everything is
Columns over VARIANT values, so a table of any size is parsed by a projection; a response that
breaks a rule anywhere gives its first error and no candidate at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import validation as va

# Key sets, names of operations, limits and defaults of the response format.
TOP_KEYS = ("memories",)
ITEM_KEYS = ("operation", "content", "kind", "subject", "tags", "confidence", "salience", "reason", "supersedes_id")
OPERATIONS = {"add": "add", "create": "add", "update": "supersede", "supersede": "supersede", "replace": "supersede", "noop": "noop", "no-op": "noop", "none": "noop", "skip": "noop"}
KINDS = ("semantic", "episodic", "identity")
MAX_REASON, MAX_SUBJECT, MAX_ID, MAX_CANDIDATES = 500, 200, 200, 5
CONFIDENCE, SALIENCE, SUBJECT = 0.6, 0.5, "user:self"

def _none() -> Column:
    return F.lit(None).cast("string")


def json_object(raw: Column) -> Column:
    """The text of the JSON object in a response: fence lines and surrounding prose are left out."""
    text = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\A\s+|\s+\z", ""))
    inner = F.regexp_replace(F.regexp_replace(text, r"\A[^\n]*(\n|\z)", ""), r"(\A|\n)[ \t]*```[^\n]*\z", "")
    body = F.trim(F.when(text.startswith("```"), inner).otherwise(text))
    return F.when(body.startswith("{"), body).otherwise(F.regexp_extract(body, r"(?s)\{.*\}", 0))


def _type(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _text(value: Column) -> Column:
    """The trimmed string of a VARIANT, null where it is blank."""
    text = F.trim(F.try_variant_get(value, "$", "string"))
    return F.when(text != "", text)


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _bad_text(value: Column, name: str, most: int) -> Column:
    return F.when(~_type(value).isin("VOID", "STRING"), F.lit(f"{name} is no string")).when(F.length(_text(value)) > most, F.lit(f"{name} is too long"))


def _bad_number(value: Column, name: str) -> Column:
    numeric = _type(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when((_type(value) != "VOID") & ~numeric, F.lit(f"{name} is no number")).when(numeric & ~_number(value).between(0.0, 1.0), F.lit(f"{name} is not within 0 and 1"))


def _item(item: Column, i: Column, context_ids: Column, default: float) -> Column:
    """STRUCT<error, operation, kind, content, subject, tags, salience, confidence, supersedes, reason> of one list entry."""
    fields = F.try_variant_get(item, "$", "map<string,variant>")
    v = {k: F.element_at(fields, k) for k in ITEM_KEYS}
    operation = F.lit(None).cast("string")
    for name, target in OPERATIONS.items():
        operation = F.when(F.lower(_text(v["operation"])) == name, F.lit(target)).otherwise(operation)
    kind = F.when(_type(v["kind"]) == "VOID", F.lit("semantic")).when(_type(v["kind"]) == "STRING", F.lower(F.coalesce(_text(v["kind"]), F.lit(""))))
    tags = F.try_variant_get(v["tags"], "$", "array<variant>")
    given_id = _type(v["supersedes_id"]) != "VOID"
    known = F.coalesce(F.array_contains(F.coalesce(context_ids, F.array().cast("array<string>")), _text(v["supersedes_id"])), F.lit(False))
    noop, supersede = operation == "noop", operation == "supersede"
    reason = (
        F.when(fields.isNull(), "an entry is no object").when(F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, ITEM_KEYS)))) > 0, "unknown key")
        .when(_type(v["operation"]) != "STRING", "operation is no string").when(operation.isNull(), "unknown operation")
        .when(_bad_text(v["reason"], "reason", MAX_REASON).isNotNull(), _bad_text(v["reason"], "reason", MAX_REASON)).when(_bad_number(v["confidence"], "confidence").isNotNull(), _bad_number(v["confidence"], "confidence"))
        .when(noop & given_id, "a noop names a target").when(noop, _none())
        .when(_bad_text(v["content"], "content", va.MAX_CONTENT).isNotNull(), _bad_text(v["content"], "content", va.MAX_CONTENT)).when(_text(v["content"]).isNull(), "content is missing")
        .when(~F.coalesce(kind.isin(*KINDS), F.lit(False)), "kind is none of the allowed values").when(_bad_text(v["subject"], "subject", MAX_SUBJECT).isNotNull(), _bad_text(v["subject"], "subject", MAX_SUBJECT))
        .when(supersede & _bad_text(v["supersedes_id"], "supersedes_id", MAX_ID).isNotNull(), _bad_text(v["supersedes_id"], "supersedes_id", MAX_ID)).when(supersede & _text(v["supersedes_id"]).isNull(), "supersedes_id is missing")
        .when(supersede & ~known, "supersedes_id was not among the memories shown").when(~supersede & given_id, "supersedes_id without supersede")
        .when((_type(v["tags"]) != "VOID") & tags.isNull(), "tags is no list").when(F.size(tags) > va.MAX_TAGS, "too many tags").when(F.exists(tags, lambda t: (_type(t) != "STRING") | _text(t).isNull()), "a tag is no string")
        .when(_bad_number(v["salience"], "salience").isNotNull(), _bad_number(v["salience"], "salience"))
    )
    kept = lambda c: F.when(~noop, c)
    return F.struct(
        F.when(reason.isNotNull(), F.concat(F.lit("memories["), i.cast("string"), F.lit("]: "), reason)).alias("error"), operation.alias("operation"), kept(kind).alias("kind"), kept(_text(v["content"])).alias("content"),
        kept(F.coalesce(_text(v["subject"]), F.lit(SUBJECT))).alias("subject"), kept(F.coalesce(tx.tags(F.transform(tags, _text)), F.array().cast("array<string>"))).alias("tags"), kept(F.coalesce(_number(v["salience"]), F.lit(SALIENCE))).alias("salience"),
        F.coalesce(_number(v["confidence"]), F.lit(default)).alias("confidence"), F.when(supersede, _text(v["supersedes_id"])).alias("supersedes"), F.coalesce(_text(v["reason"]), F.when(noop, F.lit("not worth remembering"))).alias("reason"),
    )


def parse(responses: DataFrame, most: int = MAX_CANDIDATES, default: float = CONFIDENCE) -> DataFrame:
    """responses (id, raw, context_ids array<string>, any others) with error and items; error: the items are null."""
    df = responses.withColumn("_json", json_object(F.col("raw")))
    # Inside brackets, what follows the object is an error too.
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), "_json", F.lit("]"))), "$", "array<variant>")
    df = df.withColumn("_v", F.when(F.size(whole) == 1, F.get(whole, 0))).withColumn("_list", F.try_variant_get("_v", "$.memories", "array<variant>"))
    unknown = F.size(F.array_except(F.map_keys(F.try_variant_get("_v", "$", "map<string,variant>")), F.array(*map(F.lit, TOP_KEYS)))) > 0
    given = _type(F.try_variant_get("_v", "$.memories", "variant"))
    error = (
        F.when(F.trim(F.coalesce("raw", F.lit(""))) == "", "no content").when(F.col("_json") == "", "no JSON object").when(F.col("_v").isNull(), "not valid JSON").when(~_type(F.col("_v")).startswith("OBJECT"), "no JSON object")
        .when(unknown, "unknown top-level key").when(given == "VOID", "memories is missing").when(F.col("_list").isNull(), "memories is no list").when(F.size("_list") > most, "too many candidates")
    )
    items = F.transform("_list", lambda x, i: _item(x, i, F.col("context_ids"), default))
    df = df.withColumn("_error", error).withColumn("_items", F.when(F.col("_error").isNull(), items))
    first = F.get(F.filter(F.transform("_items", lambda x: x["error"]), lambda e: e.isNotNull()), 0)
    df = df.withColumn("error", F.coalesce("_error", first))
    return df.withColumn("items", F.when(F.col("error").isNull(), F.col("_items"))).drop("_json", "_v", "_list", "_error", "_items")


def extract(responses: DataFrame, most: int = MAX_CANDIDATES, default: float = CONFIDENCE) -> DataFrame:
    """(id, scope, ordinal, candidate fields, reason) of parsed responses (id, scope, raw, context_ids); an error gives one row without a target."""
    parsed = parse(responses, most, default)
    rows = parsed.select("id", "scope", "error", F.posexplode_outer("items").alias("ordinal", "item"))
    good = F.col("item").isNotNull()
    return rows.filter(good | F.col("error").isNotNull()).select(
        "id", "scope", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.when(good, F.lit("memory")).alias("target"), F.col("item.operation").alias("operation"), F.col("item.kind").alias("kind"),
        _none().alias("key"), _none().alias("value"), F.col("item.content").alias("content"), F.col("item.subject").alias("subject"), F.col("item.tags").alias("tags"), F.col("item.salience").alias("salience"),
        F.col("item.confidence").alias("confidence"), F.col("item.supersedes").alias("supersedes"), F.coalesce("error", "item.reason").alias("reason"), F.lit("model").alias("origin"),
    )

"""Derived vector indexes: what is missing, building, rebuilding, dropping, statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..functions.visibility import Visibility
from .scratch import written


def missing(memories: DataFrame, vectors: DataFrame, model: str, seen: Visibility | None = None) -> DataFrame:
    """Ids of active memories without a vector of the model."""
    wanted = memories.filter(F.col("status") == "active")
    if seen is not None:
        wanted = wanted.filter(seen.predicate(F.col("scope")))
    have = vectors.filter(F.col("model_id") == model).select(F.col("memory_id").alias("have"))
    return wanted.select("id").join(have, F.col("id") == F.col("have"), "left_anti")


def document_text(memories: DataFrame) -> DataFrame:
    """(id, text): content, subject and tags by line, the text that is embedded."""
    tag_line = F.when(F.size("tags") > 0, F.array_join("tags", " "))
    return memories.select("id", F.concat_ws("\n", F.col("content"), F.when(F.col("subject") != "", F.col("subject")), tag_line).alias("text"))


def build(memories: DataFrame, vectors: DataFrame, model: str, dim: int = 64) -> DataFrame:
    """Vector rows for what is missing, by the hashing embedder."""
    todo = memories.join(missing(memories, vectors, model), "id", "left_semi")
    return vx.hash_embeddings(document_text(todo), dim).select(F.col("id").alias("memory_id"), F.lit(model).alias("model_id"), "vector")


def build_by(memories: DataFrame, vectors: DataFrame, model: str, embed: Callable[[list[str]], Sequence[Sequence[float]]], batch: Column | None = None, batch_size: int = 64, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, failures) of what is missing, or of the first `limit` ids of it, by an embedder that takes texts by the batch.

    vectors: (memory_id, model_id, vector); failures: (memory_id, error). A batch whose embedder raises, or
    gives another number of vectors, is a failure of each of its memories and stops no other one; as it leaves no
    vectors, the next build takes it up again. batch: a column that deals memories to calls, by default a
    hash of the id; a call never has more than batch_size texts. The embedder is asked once a batch.
    """
    todo = missing(memories, vectors, model)
    if limit is not None:
        todo = todo.orderBy("id").limit(max(0, limit))
    rows = memories.join(todo, "id", "left_semi")
    dealt = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows.count() // batch_size)))) if batch is None else batch
    texts = document_text(rows).join(rows.select("id", dealt.alias("call")), "id")
    kind = rows.schema["id"].dataType.simpleString()

    def call(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("id", "ascending")]))
        ids, said = group["id"].combine_chunks(), group["text"].to_pylist()
        made: list[Sequence[float] | None] = []
        errors: list[str | None] = []
        for first in range(0, len(said), batch_size):
            part = said[first : first + batch_size]
            try:
                got = [[float(x) for x in v] for v in embed(part)]
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                made, errors = [*made, *got], [*errors, *[None] * len(part)]
            except Exception as problem:  # a provider may raise anything; it is told, not hidden
                made, errors = [*made, *[None] * len(part)], [*errors, *[f"{type(problem).__name__}: {problem}"] * len(part)]
        return pa.table({"memory_id": ids, "vector": pa.array(made, pa.list_(pa.float64())), "error": pa.array(errors, pa.string())})

    out = written(texts.groupBy("call").applyInArrow(call, f"memory_id {kind}, vector array<double>, error string"), "vectors")
    return out.filter("error IS NULL").select("memory_id", F.lit(model).alias("model_id"), "vector"), out.filter("error IS NOT NULL").select("memory_id", "error")


def rebuilt(memories: DataFrame, vectors: DataFrame, model: str, dim: int = 64) -> DataFrame:
    """All vectors, with the model's made anew."""
    others = dropped(vectors, model)
    return others.unionByName(build(memories, others, model, dim))


def dropped(vectors: DataFrame, model: str | None = None) -> DataFrame:
    return vectors.filter(F.col("model_id") != model) if model else vectors.limit(0)


def stats(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """(model_id, n_vectors, n_missing) for each model that has vectors."""
    per = vectors.groupBy("model_id").agg(F.count("*").alias("n_vectors"))
    active = memories.filter(F.col("status") == "active").select("id")
    covered = vectors.select("model_id", F.col("memory_id").alias("id")).distinct().join(active, "id", "left_semi").groupBy("model_id").agg(F.count("*").alias("covered"))
    total = active.agg(F.count("*").alias("active"))
    return per.join(covered, "model_id", "left").crossJoin(F.broadcast(total)).select("model_id", "n_vectors", (F.col("active") - F.coalesce("covered", F.lit(0))).alias("n_missing"))

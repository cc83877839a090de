"""Streams into a store and out of one: notes imported by micro-batches, and what holds now kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import importing


def import_notes(notes: DataFrame, root: str, vault_id: str, checkpoint: str, name: str = "stream", at: Column | None = None) -> DataStreamWriter:
    """Import a stream of notes (rel_path, text) into the store at root: a micro-batch is a batch of the store.

    The batch's name is the stream's and the micro-batch's number, so one that is run again after
    a failure finds itself committed and adds nothing: each note is imported exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        importing.run(batch.sparkSession, root, f"{name}-{number:010d}", batch.select("rel_path", "text"), vault_id, at)

    return notes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write)


_STATE = "created_at timestamp, id string, value string"


def current(versions: DataFrame, late: str = "1 day", forget: str | None = None) -> DataFrame:
    """(scope, key, created_at, id, value, active) of a stream of versions (scope, key, created_at, id, value), in update mode.

    State holds one version a key: the one written last, by created_at and id, in whatever order they come.
    A key gives a row whenever that changes. forget: keys without a new version for so long, by the
    watermark, give a last row that isn't active, and leave the state.
    """
    timed = versions.select("scope", "key", F.col("created_at").cast("timestamp").alias("created_at"), F.col("id").cast("string").alias("id"), F.col("value").cast("string").alias("value")).withWatermark("created_at", late)
    wait = None if forget is None else int(pd.Timedelta(forget).total_seconds() * 1000)

    def keep(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(held: tuple, active: bool) -> pd.DataFrame:
            return pd.DataFrame([(*key, *held, active)], columns=["scope", "key", "created_at", "id", "value", "active"])

        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield row(held, False)
            return
        before = state.get if state.exists else None
        last = before
        for frame in frames:
            for found in zip(frame["created_at"], frame["id"], frame["value"], strict=True):
                if last is None or (found[0], found[1]) > (last[0], last[1]):
                    last = found
        if last is not None and last != before:
            state.update(last)
            yield row(last, True)
        if wait is not None and state.exists:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(state.get[0]).timestamp() * 1000) + wait, state.getCurrentWatermarkMs() + 1))

    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.EventTimeTimeout
    return timed.groupBy("scope", "key").applyInPandasWithState(keep, f"scope string, key string, {_STATE}, active boolean", _STATE, "update", timeout)

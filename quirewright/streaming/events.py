"""The event log as a stream: windowed counters with a watermark for late events, and states kept for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import Transitions, state_names


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Events as Parquet files that arrive in ``folder``."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, value): works on a stream and on a table alike."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count("*").alias("events"), F.sum("value").alias("value")
    ).select(F.col("w.start").alias("window_start"), "event_type", "events", "value")


def state_stream(events: DataFrame, transitions: Transitions, start: str, key: str = "user_id", late: str = "2 hours") -> DataFrame:
    """(``key``, state, events): after each trigger the keys with new events and the state these have led to.

    A stream of ``operators.events.folded_states``: what is kept of a key is its state and a count. Events of one trigger are
    taken in the order of ts and event_id; those that come in a later trigger follow, and those beyond the watermark are dropped
    by the source's deduplication. Write it in update mode.
    """
    names = state_names(transitions, start)
    goes = {(a, e): b for a, e, b in transitions}
    key_type = events.schema[key].dataType.simpleString()
    rows = events.filter(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

    def run(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, n = state.get if state.exists else (0, 0)
        name = names[at]
        every = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in every["event_type"]:
            name = goes.get((name, kind), name)
        n += len(every)
        state.update((names.index(name), n))
        yield pd.DataFrame({key: [of[0]], "state": [name], "events": [n]})

    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {key_type}, state STRING, events LONG", "at INT, events LONG", "update", GroupStateTimeout.NoTimeout
    )

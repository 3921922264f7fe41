"""Structured Streaming forms of the log and task operators; batch twins are in pagelith.operators.work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelith.operators.work import IDLE, STATE, reduce_event

HELD = "stage string, status string, completed long, total long, failed long, rejected long"


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windows(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and mean value by event-time window (tumbling, or sliding if slide is given)."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        (events.withWatermark("ts", late) if events.isStreaming else events)
        .groupBy(w, "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("begin"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events no further apart than the gap."""
    return (
        (events.withWatermark("ts", late) if events.isStreaming else events)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "user_id", "n")
    )


def task_states(events: DataFrame) -> DataFrame:
    """events(project, seq, type, count) as a stream -> each project's state after every batch."""

    def fold(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HELD.split(", ")]
        now = dict(zip(names, state.get)) if state.exists else {**IDLE, "rejected": 0}
        for e in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            try:
                now = {**reduce_event(now, e), "rejected": now["rejected"]}
            except ValueError:
                now = {**now, "rejected": now["rejected"] + 1}
        state.update(tuple(now[n] for n in names))
        yield pd.DataFrame([(key[0], now["stage"], now["status"], now["completed"], now["total"], now["rejected"])], columns=[c.split()[0] for c in STATE.split(", ")])

    return events.groupBy("project").applyInPandasWithState(fold, STATE, HELD, "update", GroupStateTimeout.NoTimeout)

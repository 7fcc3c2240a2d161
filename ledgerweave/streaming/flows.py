"""Streaming forms of the per-window alert counts and of the observation context (an extension: the domain itself is batch)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type; state older than the watermark goes."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """One row for each user's run of events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _gaps(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, last = state.get if state.exists else (0, None)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    out = []
    for r in rows.itertuples():
        now = r.ts.timestamp()
        count += 1
        out.append((key[0], r.event_id, count, round(now - last, 3) if last is not None else 0.0))
        last = now
    state.update((count, last))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "sequence", "seconds_since_previous"])


def observation_context(events: DataFrame) -> DataFrame:
    """Each event's place and gap within its user, carried over triggers in two numbers of state a user."""
    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(
        _gaps, "user_id long, event_id long, sequence long, seconds_since_previous double", "count long, last double", "append", GroupStateTimeout.NoTimeout
    )

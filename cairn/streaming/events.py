"""Event-time operators: an extension, since the inventory has no streams. The same plans run on batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", lateness) if lateness else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", lateness) if lateness else events
    return e.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", lateness) if lateness else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def first_of_key(events: DataFrame, key: str, lateness: str) -> DataFrame:
    """Drops repeated keys within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame) -> DataFrame:
    """user_id, n, total after each batch, kept in state per user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)

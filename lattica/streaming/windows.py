"""Structured Streaming over events: windows with watermarks, deduplication, sessions, stateful counts.

The same functions serve a stream and a table: they only use transformations that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet files at a path, with the schema of those that are there."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Events with their zone-less time as a timestamp of the session, and a watermark on it."""
    return events.filter(F.col(ts).isNotNull()).withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)


def window_counts(events: DataFrame, ts: str, key: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Per window and key: count and sum. Windows are half-open; without a slide they don't overlap."""
    w = F.window("__ts", width, slide) if slide else F.window("__ts", width)
    sums = timed(events, ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: runs of events each less than the gap after the one before."""
    sums = timed(events, ts, late).groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_deliveries(events: DataFrame, ts: str, row_id: str, late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark([row_id]).drop("__ts")


def running_degrees(events: DataFrame, key: str, row_id: str) -> DataFrame:
    """key, n, last: the number of rows per key so far, kept as state and sent on with every batch that has the key."""

    def count(keys: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, -1)
        for part in rows:
            n += len(part)
            last = max(last, int(part[row_id].max()))
        state.update((n, last))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "last": [last]})

    grouped = events.select(key, row_id).groupBy(key)
    return grouped.applyInPandasWithState(count, f"{key} bigint, n bigint, last bigint", "n bigint, last bigint", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, in batches, and goes on from its checkpoint when called again.

    Each batch is written as path/batch=<number>; one that is run again after a failure overwrites its own files, so
    nothing is written twice. In the mode complete the last batch is the result, in update the last row of each key.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")).start()
    query.awaitTermination()


def last_batch(rows: DataFrame) -> DataFrame:
    """The rows of the last batch, after a run in the mode complete."""
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def last_per_key(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key, after a run in the mode update."""
    values = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(key, "v.*")

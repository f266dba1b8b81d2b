"""Streams of claims and answers: resumable, idempotent, event time from timestamps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", files) if files else r).load(path)


def once_per_id(stream: DataFrame, id_col: str, at: str, delay: str = "1 day") -> DataFrame:
    """The first delivery of each identifier; later ones within ``delay`` of event time are dropped.

    A repeat that comes later than that is let through, and left to operators.delivery over the stored table.
    """
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.dropDuplicatesWithinWatermark([id_col])


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", *by, "n")


def sessions(stream: DataFrame, at: str, by: list[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def latest_values(stream: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """(keys, ts, value) whenever a key's newest value changes, by time and not by arrival; state is one row per key."""
    schema = stream.select(*keys, F.col(ts).cast("bigint").alias("ts"), F.col(value).alias("value")).schema
    kept = f"ts bigint, value {schema['value'].dataType.simpleString()}"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, now = state.get if state.exists else (None, None)
        before = now
        for b in batches:
            for t, v in zip(b["ts"], b["value"]):
                if pd.notna(t) and v is not None and (at is None or (t, v) > (at, now)):
                    at, now = int(t), v
        if now is not None:
            state.update((at, now))
            if now != before:
                yield pd.DataFrame([(*key, at, now)], columns=schema.fieldNames())

    rows = stream.select(*keys, F.col(ts).cast("bigint").alias("ts"), F.col(value).alias("value"))
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, kept, "update", GroupStateTimeout.NoTimeout)


def sink(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Write what is there and stop; run again it goes on where it stopped. Exactly once by the file sink's log."""
    return stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def batch_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each micro-batch overwrites its own folder, so a batch that is repeated after a failure replaces itself.

    Keys that come in several batches stay; upserted() reads the newest row of each.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The table behind batch_sink() as an upsert by key: of each key the row with the greatest ``order``, ties to the later batch."""
    rows = spark.read.parquet(path)
    last = rows.dropna(subset=key).groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(order, "batch")).alias("__r"))
    return last.select(*key, "__r.*").drop("batch")

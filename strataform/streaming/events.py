"""Event-time operators over the events table as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.session import ship, table
from strataform.storage import work_dir

LATE = "2 hours"


def source(spark: SparkSession, sf_dir: str, delay: str = LATE) -> DataFrame:
    """The table's file as a file stream with a watermark."""
    ship(spark)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(stream: DataFrame, size: str) -> DataFrame:
    counted = stream.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(stream: DataFrame, size: str, step: str) -> DataFrame:
    counted = stream.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    counted = stream.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def totals(stream: DataFrame) -> DataFrame:
    """Counts and sums by user in state of our own: what a batch brings is added, and the user's row is sent anew."""

    def add(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 2)]})

    return stream.groupBy("user_id").applyInPandasWithState(add, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")


def drain(writer, spark: SparkSession, state: str | None = None) -> None:
    """Runs a query over all there is, and ends it. Offsets and state are in the shared folder."""
    query = writer.option("checkpointLocation", state or work_dir(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()


def run(spark: SparkSession, stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The stream's result once all input is through, from files of the shared folder: a folder for each batch, which a
    retried batch writes anew. Of a complete result the last batch counts, of updates the last row for each key."""
    path = work_dir(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={epoch}")

    drain(stream.writeStream.foreachBatch(write).outputMode(mode), spark)
    rows = spark.read.schema(stream.schema.add("_batch", "long")).parquet(path)
    if mode == "complete":
        rows = rows.where(F.col("_batch") == rows.agg(F.max("_batch")).first()[0])
    if mode == "update":
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "_batch").alias("r")).select("r.*")
    return rows.drop("_batch")

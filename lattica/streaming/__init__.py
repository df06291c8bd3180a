"""Streams: the stateless operators apply as they are; here are upserts of results and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import results


def upserting(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes every micro-batch to a folder of its own number: a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merging(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Keeps the newest row of every key in a results table in ``path``: what a micro-batch writes grows with the batch, and one that runs
    again changes nothing. ``newest`` reads the table, which is empty at first."""
    spark = stream.sparkSession
    results.create(spark, path, transform(spark.createDataFrame([], stream.schema)).schema, key)

    def put(batch: DataFrame, number: int) -> None:
        results.upsert(transform(batch), path, order, writer=checkpoint, batch=number)
        results.compact(batch.sparkSession, path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    return results.read(spark, path)


def event_windows(events: DataFrame, time: str, width: str, late: str, by: list[str], key: str | None = None) -> DataFrame:
    """Counts in windows by time; rows later than ``late`` are dropped, repeats of ``key`` within it count once."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    if key:
        rows = rows.dropDuplicatesWithinWatermark([key])
    got = rows.groupBy(F.window("__t", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, user: str) -> DataFrame:
    """Counts in sessions of a user that end after a gap."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    got = rows.groupBy(F.session_window("__t", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")

"""Resumable batches and, as an extension, windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(batches: DataFrame, done: DataFrame, key: str = "batch_index") -> DataFrame:
    """Batches that are not done; one that is done with other content is an error when it is read."""
    rows = batches.join(done.select(key, F.col("content_sha256").alias("_done")), key, "left")
    clash = F.raise_error(F.concat(F.lit("a finished batch has other content: "), F.col(key).cast("string")))
    rows = rows.withColumn("_ok", F.when(F.col("_done").isNull(), True).when(F.col("_done") == F.col("content_sha256"), False).otherwise(clash))
    return rows.filter("_ok").drop("_done", "_ok")


def run_batches(spark: SparkSession, source: str, schema, place: str, work: Callable[[DataFrame], DataFrame], *, files: int = 1) -> None:
    """Work through the files of a folder once each: what a run has finished, the next one skips.

    The stream's checkpoint remembers the files, and each batch overwrites its
    own folder, so a batch that is repeated after a failure changes nothing.
    """

    def one(df: DataFrame, batch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{place}/out/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def windowed(events: DataFrame, *, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by window and key; a stream drops what is later than ``late``. An extension."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, *, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key that a gap ends. An extension."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")

"""Streams as a way in: query spectra arrive as files and meet static tables; progress is in a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.writers import scratch


def spectra_stream(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    """New Parquet files of a folder, so many in a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def each_batch(stream: DataFrame, predict: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Predictions of each batch, appended under its number: a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        predict(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts by event time; state older than the watermark goes."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count("*").alias("n"))


def through(spark: SparkSession, rows: DataFrame, predict: Callable[[DataFrame], DataFrame], files: int = 2) -> DataFrame:
    """What predict makes of rows that arrive as a stream of files, batch by batch, once all have been read."""
    folder, out, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "progress")
    rows.repartition(2 * files).write.mode("overwrite").parquet(folder)
    each_batch(spectra_stream(spark, folder, rows.schema, files), predict, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def windowed(spark: SparkSession, events: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """windowed_counts over a stream of files, as they stand after the last batch."""
    folder, out, checkpoint = scratch(spark, "in"), scratch(spark, "counts"), scratch(spark, "progress")
    events.repartition(4).write.mode("overwrite").parquet(folder)
    counts = windowed_counts(spectra_stream(spark, folder, events.schema, 2), time, length, late, *by)
    # A complete result replaces the one before: a batch that runs again changes nothing. It is shuffled into its file: were
    # it coalesced, one task would hold the state and the hash tables of all partitions at once.
    write = lambda batch, _: batch.repartition(1).write.mode("overwrite").parquet(out)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def drained(spark: SparkSession, table: str, where: str) -> DataFrame:
    """The count of a table's rows that hold, by a stream over a copy of it that stops where the files end."""
    folder, out, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "progress")
    static = spark.read.parquet(table)
    static.repartition(4).write.mode("overwrite").parquet(folder)
    each_batch(spectra_stream(spark, folder, static.schema, 2), lambda b: b.where(where).agg(F.count("*").alias("n")), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).agg(F.sum("n").alias("n"))

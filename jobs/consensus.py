"""A library of consensus peaks that grows with the peak files that arrive.

Spectra of a molecule and adduct are taken together: peaks within a width of the first one of their run are one
cluster, with its range, number of peaks, summed strength and weighted mean. The job is a file stream that stops where
the files end (availableNow): Spark's checkpoint knows which files were taken, so a run reads only what is new. Each
batch

1. writes its clean peaks to peaks/bucket=*/batch=N, replacing what an earlier try of batch N left there;
2. computes the clusters of the buckets that it touched from all their peaks, and replaces those partitions of
   library/bucket=*. Other buckets are neither read nor written.

So a batch that runs again, after a failure at any point, leaves the same rows, and a run without new files changes
nothing. Peaks without an id, molecule, adduct, mass or strength are dropped; of a molecule's rows
of one id the first counts: that of the earliest batch, then of least mass, strength and adduct. Masses are whole numbers of millionths: sums don't depend on their order. A
molecule with a great share of all peaks is dealt over ranges of mass, not gathered (operators/clusters.py).

    python -m jobs.consensus --events PATH --output PATH --checkpoint PATH [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.clusters import anchored

from .common import configured, log, main

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
PEAKS = "seq bigint, molecule_id bigint, adduct string, mz bigint, strength bigint, bucket int, batch bigint"
LIBRARY = "molecule_id bigint, adduct string, lowest bigint, highest bigint, n_peaks bigint, strength bigint, mz double, bucket int"


def clean(events: DataFrame, buckets: int) -> DataFrame:
    """Peaks of events (k of props being a peak's strength), with the bucket of their molecule."""
    mz = F.when(F.abs("value") < 1e12, F.floor(F.col("value") * 1e6 + 0.5))
    own = events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("molecule_id"), F.col("event_type").alias("adduct"), mz.alias("mz"), (F.get_json_object("props", "$.k").try_cast("bigint") + 1).alias("strength"))
    return own.na.drop().where("strength > 0").withColumn("bucket", F.pmod("molecule_id", F.lit(buckets)).cast("int"))


def once(peaks: DataFrame) -> DataFrame:
    """The first peak of each id of a molecule."""
    rest = F.struct("batch", "mz", "strength", "adduct")
    return peaks.groupBy("bucket", "molecule_id", "seq").agg(F.min(rest).alias("p")).select("bucket", "molecule_id", "seq", "p.*")


def clusters(peaks: DataFrame, width: int) -> DataFrame:
    """The clusters of each molecule and adduct."""
    runs = anchored(peaks.select("molecule_id", "adduct", "mz", "strength", "bucket"), ["molecule_id", "adduct"], "mz", width)
    sums = runs.groupBy("bucket", "molecule_id", "adduct", F.col("anchor").alias("lowest")).agg(
        F.max("mz").alias("highest"), F.count("*").alias("n_peaks"), F.sum("strength").alias("strength"), F.sum(F.col("mz").cast("decimal(38,0)") * F.col("strength")).alias("moment")
    )
    return sums.withColumn("mz", F.col("moment").cast("double") / F.col("strength") / 1e6).drop("moment")


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict | None = None) -> str:
    """Takes the new files at a path into the library; returns the library's path. Waits until all are taken."""
    config = config or configured("consensus")
    peaks, library = f"{output}/peaks", f"{output}/library"
    buckets = config["buckets"]

    def take(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        new = clean(batch, buckets).withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(peaks)
        stored = own.read.schema(PEAKS).parquet(peaks)
        touched = sorted(r.bucket for r in stored.where(F.col("batch") == number).select("bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            log.info("consensus: batch %s has no peaks", number)
            return
        made = clusters(once(stored.where(F.col("bucket").isin(touched))), config["width_micro"])
        # A bucket's rows lie together: a file or a few for each.
        made.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(library)
        log.info("consensus: batch %s wrote %s peaks and replaced %s of %s buckets of the library", number, stored.where(F.col("batch") == number).count(), len(touched), buckets)

    # The library has its schema before the first peak: a run over no files leaves an empty table.
    for path, schema in ((peaks, PEAKS), (library, LIBRARY)):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("bucket", *(["batch"] if schema == PEAKS else [])).parquet(path)
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(events)
    query = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("consensus: read %s new rows of %s; the library at %s has %s clusters", read, events, library, rows(spark, library).count())
    return library


def rows(spark: SparkSession, library: str) -> DataFrame:
    """The library as it stands."""
    return spark.read.schema(LIBRARY).parquet(library)


if __name__ == "__main__":
    main("consensus", __doc__, {"events": "folder of Parquet files, or a pattern of such: event_id, user_id, event_type, value, props", "output": "folder of peaks and library", "checkpoint": "folder of the stream's progress"}, run)

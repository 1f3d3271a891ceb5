"""Writers. All commit through Spark's protocol; none writes from the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .shared import dropped_at_end, new_folder


#: Full files that a task of reshard writes; its tasks at most.
FILES, MOST_TASKS = 200, 2048


def csv(df: DataFrame, path: str, single: bool = True) -> str:
    """With a header; in one file if the reader needs one."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)
    return path


def by_mass(df: DataFrame, path: str, mass: str, shards: int, max_rows: int = 0) -> str:
    """Ranges of mass, sorted within: readers skip row groups by their least and greatest mass."""
    df.repartitionByRange(shards, mass).sortWithinPartitions(mass).write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(path)
    return path


def chunked(df: DataFrame, path: str, rows: int = 1_000_000) -> str:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    return path


def reshard(df: DataFrame, path: str, by: str, rows: int) -> str:
    """Files of at most so many rows; partitions that a run doesn't touch stay as they are.

    Files are what takes time, and a compressed table is few tasks to Spark: it is dealt into tasks of FILES files each.
    """
    tasks = min(-(-df.count() // (rows * FILES)), MOST_TASKS)
    (df.repartition(tasks) if tasks > 1 else df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows).partitionBy(by).parquet(path)
    return path


def replaced(df: DataFrame, placeholder: DataFrame, path: str) -> str:
    """A placeholder first, then the real rows in its place: a reader finds an output even if the second write fails."""
    placeholder.write.mode("overwrite").parquet(path)
    made = f"{path.rstrip('/')}.made"
    df.write.mode("overwrite").parquet(made)
    spark = df.sparkSession
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, made))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{made} could not take the place of {path}")
    return path


def scratch(spark, name: str) -> str:
    """A fresh folder in the one that all executors share, which goes when the application ends."""
    return dropped_at_end(spark, new_folder(spark, name))

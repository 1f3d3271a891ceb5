"""Stored pools of candidates: files in ranges of mass, with an index of what each file holds.

A pool of billions of rows is looked into by bands that meet a small part of it. ``write_pool`` sorts it into files by
mass and writes (file, least, greatest, rows) of each beside them; ``in_bands`` opens only files whose range some
query's band meets. Within those, row groups are skipped by their statistics, for rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast

#: Narrowest cell that files and bands meet in: a narrower band looks into more of a file's range than it needs.
CELL = 0.01


def write_pool(pool: DataFrame, path: str, mass: str, shards: int, max_rows: int = 0) -> str:
    """Writes path/rows, in files by mass, and path/index. Rows without a mass, which no band meets, are left out.

    The index is written last: a pool whose writing broke off has none, and readers say so.
    """
    spark = pool.sparkSession
    rows = pool.where(F.col(mass).isNotNull() & ~F.isnan(mass))
    rows.repartitionByRange(shards, mass).sortWithinPartitions(mass).write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"), F.col(mass).cast("double").alias("m"))
    index = stored.groupBy("file").agg(F.min("m").alias("least"), F.max("m").alias("greatest"), F.count("*").alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/index")  # a row for each file
    return path


def index_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, least double, greatest double, rows bigint").parquet(f"{path}/index")


def _cells(low: Column, high: Column, cell: float) -> Column:
    at = lambda c: F.floor(c / F.lit(cell)).cast("long")
    return F.explode(F.sequence(at(low), at(high)))


def files_in_bands(spark: SparkSession, path: str, queries: DataFrame, center: str, width: float) -> DataFrame:
    """Rows of the index whose files a band center +- width of a query meets.

    Queries are summed up to the least and greatest center of each cell, so that their number doesn't matter; the
    files' ranges lie side by side, so that their cells are about as many as the pool's range has.
    """
    cell = max(width, CELL)
    centers = queries.select(F.col(center).cast("double").alias("c")).where("c IS NOT NULL AND NOT isnan(c)").select("c", _cells(F.col("c") - width, F.col("c") + width, cell).alias("cell"))
    asked = centers.groupBy("cell").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    index = index_of(spark, path)
    offered = index.select("*", _cells(F.col("least"), F.col("greatest"), cell).alias("cell"))
    # In a cell, bands of all its centers lie between those of the least and greatest one.
    met = offered.join(bounded_broadcast(asked), "cell").where((F.col("greatest") >= F.col("lo") - width) & (F.col("least") <= F.col("hi") + width))
    return index.join(met.select("file").distinct(), "file", "left_semi")


def in_bands(spark: SparkSession, path: str, queries: DataFrame, center: str, width: float, schema=None) -> DataFrame:
    """The pool's rows in files that some query's band meets: all rows that a band join of that width, or a narrower
    one, can find. The driver gets the names of those files, and Spark opens no others."""
    names = [f"{path}/rows/{r.file}" for r in files_in_bands(spark, path, queries, center, width).select("file").collect()]
    schema = schema or spark.read.parquet(f"{path}/rows").schema
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)

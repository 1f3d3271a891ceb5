"""Rank cuts, ordered deduplication, pooling and tier fill. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import durable


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def max_pool(df: DataFrame, by: list[str], score: str, payload: str, seq: str) -> DataFrame:
    """Per group the greatest positive score, and the payload of its first row in the order of seq."""
    return df.where(F.col(score) > 0).groupBy(*by).agg(F.max(score).alias(score), F.max_by(payload, F.struct(F.col(score), -F.col(seq))).alias(payload))


def first_per_key(df: DataFrame, by: list[str], key: str, rank: str, k: int) -> DataFrame:
    """The first row of each key in the order of rank, ranked anew and cut at k."""
    first = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by, key).orderBy(rank))).where("__n = 1").drop("__n")
    return top_k(first.withColumnRenamed(rank, "__old"), by, [F.col("__old")], k, rank).drop("__old")


def keep_best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each group: the first in order."""
    return top_k(df, by, order, 1, "__n").drop("__n")


def best_with(df: DataFrame, by: list[str], order: list[tuple[str, bool]], *aggregates: Column) -> DataFrame:
    """One row of each group, the first in order, and aggregates of the whole group, in one pass over df.

    order: (column, whether it falls); only whole numbers fall; nulls are last. Columns that are not in it break ties.
    Each task sums up its own groups first: a group that many rows share is a few rows in the shuffle.
    """
    types, falls = dict(df.dtypes), dict(order)
    rest = [c for c in df.columns if c not in (*by, *falls)]
    ordered = [x for c, fall in order for x in (F.col(c).isNull().alias(f"__no_{c}"), (-F.col(c).cast("long") if fall else F.col(c)).alias(c))]
    found = df.groupBy(*by).agg(F.min(F.struct(*ordered, *rest)).alias("__first"), *aggregates)
    own = lambda c: F.col("__first")[c]
    out = [((-own(c)).cast(types[c]) if falls.get(c) else own(c)).alias(c) for c in df.columns if c not in by]
    return found.select(*by, *out, *(c for c in found.columns if c not in (*by, "__first")))


def tier_fill(first: DataFrame, second: DataFrame, by: str, key: str, rank: str, k: int, cap: int | None = None) -> DataFrame:
    """first's rows up to cap, then second's with keys not there yet, up to k; groups that are full skip second."""
    cap = k if cap is None else min(cap, k)
    head = first.where(F.col(rank) <= cap).withColumn("tier", F.lit(1))
    full = head.groupBy(by).count().where(F.col("count") >= k).select(by)
    rest = second.join(full, by, "left_anti").withColumn("tier", F.lit(2))
    both = head.unionByName(rest).withColumn("__at", F.row_number().over(Window.partitionBy(by).orderBy("tier", rank))).drop(rank)
    return first_per_key(both.withColumnRenamed("__at", rank), [by], key, rank, k)


def dense_code(df: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct values of column with codes from 0 in their order.

    Values are sorted into ranges and numbered within; each range's first code is the number of values in those
    before it, of which the driver sees a row for each range.
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = durable(distinct.orderBy(column).withColumn("__at", F.monotonically_increasing_id()))
    # A range's number is in the bits above 33, the place in it below.
    sizes = sorted((r.part, r.n) for r in placed.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    firsts, total = [], 0
    for part, n in sizes:
        firsts.append((part, total))
        total += n
    before = F.broadcast(df.sparkSession.createDataFrame(firsts, "__part long, __first long"))  # a row for each range
    own = placed.withColumn("__part", F.shiftright("__at", 33)).join(before, "__part")
    return own.select(column, (F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias(code))


def counts_above(rows: DataFrame, by: list[str], value: str, count: str, ranges: int | None = None) -> DataFrame:
    """(by, value, above) of each distinct value: how many rows of its group have a greater one. rows: by, value, count.

    Distinct values are sorted into ranges, so that a group of any size is dealt over tasks; what greater ranges hold is
    a number for each range that a group is in. No group is null.
    """
    parts = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = rows.groupBy(*by, value).agg(F.sum(count).alias("__c"))
    placed = durable(same.repartitionByRange(parts, *by, F.col(value).desc()).withColumn("__range", F.spark_partition_id()))
    greater = lambda w: F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = placed.groupBy(*by, "__range").agg(F.sum("__c").alias("__c"))
    before = ranged.select(*by, "__range", greater(Window.partitionBy(*by).orderBy("__range")).alias("__before"))
    within = placed.withColumn("__within", greater(Window.partitionBy(*by, "__range").orderBy(F.col(value).desc())))
    return within.join(before, [*by, "__range"]).select(*by, value, (F.col("__within") + F.col("__before")).alias("above"))

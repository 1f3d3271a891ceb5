"""Joins that Spark has no operator for: bands, adaptive widening, and hints that check sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..sources.shared import dropped_at_end, new_folder, shared_dir


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as Parquet, for many or wide rows: a checkpoint writes them as they are in memory, several times as large."""
    spark = df.sparkSession
    path = dropped_at_end(spark, new_folder(spark, "stored"))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a side may be estimated to have for a broadcast hint.
BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if Spark's own estimate of its size in bytes is small enough.

    Else it is left to adaptive execution, which goes by the size that is measured at run time.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= most else df


def in_band(mass: Column, center: Column, width: float) -> Column:
    """Both ends belong to the band; two comparisons, for abs() rounds differently."""
    return (mass >= center - F.lit(width)) & (mass <= center + F.lit(width))


def band_join(queries: DataFrame, pool: DataFrame, center: str, mass: str, width: float, on: list[str] = ()) -> DataFrame:
    """Pairs with pool.mass in center +- width (and equal columns ``on``), as an equi-join on cells of that width.

    Only the query side is copied, to the cells that its band touches (three at most); the pool is read once. A
    dense cell is a skewed key of a plain join, which adaptive execution splits.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    q = queries.withColumn("__cell", F.explode(F.sequence(cell(F.col(center) - width), cell(F.col(center) + width))))
    p = pool.withColumn("__cell", cell(F.col(mass)))
    # Rounding at a cell's border can put an end into the next one; both sides' cells are compared again.
    return q.join(p, [*on, "__cell"]).where(in_band(F.col(mass), F.col(center), width)).drop("__cell")


def cells_of(mass: Column, widths: tuple[float, ...]) -> Column:
    """For each width, from level 1 on: the cell of that width that a mass is in."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.floor(mass / F.lit(w)).cast("long").alias("cell")) for k, w in enumerate(widths, 1)))


def touched_cells(center: Column, widths: tuple[float, ...]) -> Column:
    """For each width, the cells that a band of that width around center meets (three at most, as cells are as wide)."""
    cell = lambda c, w: F.floor(c / F.lit(w)).cast("long")
    each = [F.transform(F.sequence(cell(center - w, w), cell(center + w, w)), _at_level(k)) for k, w in enumerate(widths, 1)]
    return F.concat(*each)


def _at_level(level: int):
    return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))


def least_levels(queries: DataFrame, pool: DataFrame, query_id: str, center: str, mass: str, widths: tuple[float, ...] = DEFAULT.widths) -> DataFrame:
    """(query_id, center, level): the least width, from 1, at which a query's band holds a mass of the pool; queries without one are left out.

    No candidate is joined for it. The pool is summed up to the least and greatest mass of each cell, at each width
    (in its own tasks first: a cell of any number of rows is two numbers). A band of twice a cell's width ends inside
    two cells and covers those between, so those two numbers tell whether it holds any of a cell's masses.
    """
    known = pool.select(F.col(mass).alias("m")).where(F.col("m").isNotNull()).select("m", F.explode(cells_of(F.col("m"), widths)).alias("c"))
    sums = known.groupBy("c.level", "c.cell").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    asked = queries.select(query_id, F.col(center).alias("center")).where(F.col("center").isNotNull()).distinct().withColumn("c", F.explode(touched_cells(F.col("center"), widths)))
    met = asked.select(query_id, "center", "c.level", "c.cell").join(sums, ["level", "cell"])
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("level"))
    return met.where((F.col("hi") >= F.col("center") - width) & (F.col("lo") <= F.col("center") + width)).groupBy(query_id, "center").agg(F.min("level").alias("level"))


def widening_join(queries: DataFrame, pool: DataFrame, query_id: str, center: str, mass: str, widths: tuple[float, ...] = DEFAULT.widths, accept: Column | None = None) -> DataFrame:
    """Each query's band join at the least width at which it finds something; adds level (from 1).

    Widths are decided first, by counting (least_levels); one join follows, in which each query looks only into cells
    of its own width, and only pool rows of cells that some query looks into are moved. accept: a row only counts as
    found where this holds (rows that don't are dropped); as it may need both sides, queries then widen one join after
    the other.
    """
    if accept is not None:
        return widening_cascade(queries, pool, query_id, center, mass, widths, accept)
    levels = least_levels(queries, pool, query_id, center, mass, widths).withColumnsRenamed({query_id: "__id", "center": "__center"})
    open_ = queries.join(levels, (F.col(query_id) == F.col("__id")) & (F.col(center) == F.col("__center"))).drop("__id", "__center")
    looked = open_.withColumn("__c", F.explode(F.filter(touched_cells(F.col(center), widths), lambda c: c["level"] == F.col("level"))))
    looked = looked.withColumn("__cell", F.col("__c.cell")).drop("__c")
    wanted = bounded_broadcast(looked.select(F.col("level").alias("__level"), "__cell").distinct())
    offered = pool.withColumn("__c", F.explode(cells_of(F.col(mass), widths))).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c").join(wanted, ["__level", "__cell"], "left_semi")
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("level"))
    met = looked.join(offered.withColumnRenamed("__cell", "__own"), (F.col("level") == F.col("__level")) & (F.col("__cell") == F.col("__own")))
    inside = (F.col(mass) >= F.col(center) - width) & (F.col(mass) <= F.col(center) + width)
    names = [F.col(f"`{c}`") for c in [*queries.columns, *pool.columns]]
    return met.where(inside).select(*names, "level")


def widening_cascade(queries: DataFrame, pool: DataFrame, query_id: str, center: str, mass: str, widths: tuple[float, ...] = DEFAULT.widths, accept: Column | None = None) -> DataFrame:
    """The same, width by width: each joins the queries that narrower ones left open.

    Each turn's rows are kept, or each would compute all before it again.
    """
    found, open_ = None, durable(queries)
    for level, width in enumerate(widths, 1):
        hits = band_join(open_, pool, center, mass, width)
        hits = durable((hits if accept is None else hits.where(accept)).withColumn("level", F.lit(level)))
        found = hits if found is None else found.unionByName(hits)
        if level < len(widths):
            open_ = durable(open_.join(hits.select(query_id).distinct(), query_id, "left_anti"))
            if open_.isEmpty():
                break
    return found


def widening_join_tagged(queries: DataFrame, pool: DataFrame, query_id: str, center: str, mass: str, widths: tuple[float, ...] = DEFAULT.widths, accept: Column | None = None) -> DataFrame:
    """The same in one join at the widest band, each row tagged with the least level that holds it. For sparse pools."""
    from pyspark.sql import Window

    wide = band_join(queries, pool, center, mass, widths[-1])
    wide = wide if accept is None else wide.where(accept)
    level = F.coalesce(*(F.when(in_band(F.col(mass), F.col(center), w), F.lit(k)) for k, w in enumerate(widths, 1)))
    best = F.min("level").over(Window.partitionBy(query_id))
    return wide.withColumn("level", level).withColumn("__best", best).where("level = __best").drop("__best")

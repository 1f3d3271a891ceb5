"""Sweeps: a grid of configurations as rows, each of which ranks all molecules in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import paired
from .ranking import first_per_key, keep_best

#: Configurations of a grid at most: every one multiplies the rows that are ranked.
MOST_CONFIGS = 1000


def with_grid(rows: DataFrame, grid: list[tuple], schema: str) -> DataFrame:
    """Every row under every configuration. The grid is the caller's list, so its broadcast is bounded by it."""
    if len(grid) > MOST_CONFIGS:
        raise ValueError(f"a grid of {len(grid)} configurations; {MOST_CONFIGS} at most")
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame(grid, schema)))


def truth_ranks(scored: DataFrame, by: list[str], order: list[Column], truth: str = "truth") -> DataFrame:
    """(by, rank) of the rows that are the truth, among all rows of their group in a total order."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(truth)).select(*by, "rank")


def with_rr(ranks: DataFrame, k: int = 25) -> DataFrame:
    return ranks.withColumn("rr", F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0))


def paired_sweep(ranks: DataFrame, base: str, config: str = "config", on: str = "molecule_id", k: int = 25) -> DataFrame:
    """Each configuration against the base one, molecule by molecule: see evaluate.paired."""
    return paired(with_rr(ranks, k), base, config, on)


def tier_caps(first: DataFrame, second: DataFrame, answers: DataFrame, caps: list[int], share: float, k: int = 25) -> DataFrame:
    """For each cap on the first tier: MRR of molecules whose answer it can reach, of the others, and both by share.

    first, second: molecule_id, rank, ckey; answers: molecule_id, ckey, reachable. Answers without a row count 0.
    """
    grid = [(int(c),) for c in caps]
    head = with_grid(first.select("molecule_id", "rank", "ckey"), grid, "cap int").where(F.col("rank") <= F.col("cap"))
    rest = with_grid(second.select("molecule_id", "rank", "ckey"), grid, "cap int")
    both = head.withColumn("tier", F.lit(1)).unionByName(rest.withColumn("tier", F.lit(2)))
    order = Window.partitionBy("cap", "molecule_id").orderBy("tier", "rank")
    listed = first_per_key(both.withColumn("at", F.row_number().over(order)).drop("rank").withColumnRenamed("at", "rank"), ["cap", "molecule_id"], "ckey", "rank", k)
    hits = listed.join(answers.select("molecule_id", "ckey"), ["molecule_id", "ckey"]).select("cap", "molecule_id", (1 / F.col("rank")).alias("rr"))
    every = with_grid(answers.select("molecule_id", "reachable"), grid, "cap int")
    rr = every.join(hits, ["cap", "molecule_id"], "left").withColumn("rr", F.coalesce("rr", F.lit(0.0)))
    means = rr.groupBy("cap").agg(F.avg(F.when(F.col("reachable"), F.col("rr"))).alias("reachable"), F.avg(F.when(~F.col("reachable"), F.col("rr"))).alias("unreachable"))
    return means.withColumn("weighted", share * F.col("reachable") + (1 - share) * F.col("unreachable"))


def selected(scores: DataFrame, score: str, config: str, by: list[str] = ()) -> DataFrame:
    """The best configuration (of each regime); scores that agree to nine digits are ties, which the name breaks."""
    return keep_best(scores, [*by] or [F.lit(0)], [F.round(score, 9).desc(), F.col(config)])

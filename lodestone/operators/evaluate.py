"""Ranked-list metrics, paired comparisons and their verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reciprocal_ranks(answers: DataFrame, predictions: DataFrame, k: int = 25) -> DataFrame:
    """(molecule_id, rr): 1 / the first rank up to k whose key is the answer's, else 0; null keys never match."""
    hits = predictions.where(F.col("rank") <= k).join(answers.select("molecule_id", F.col("ckey").alias("want")), "molecule_id").where("ckey = want")
    best = hits.groupBy("molecule_id").agg(F.min("rank").alias("rank"))
    return answers.select("molecule_id").join(best, "molecule_id", "left").select("molecule_id", F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("rr"))


def mrr(answers: DataFrame, predictions: DataFrame, k: int = 25) -> DataFrame:
    return reciprocal_ranks(answers, predictions, k).agg(F.avg("rr").alias("mrr"), F.count("*").alias("n"))


def paired(scores: DataFrame, base: str, by: str = "config", on: str = "molecule_id", value: str = "rr", tie: float = 1e-9) -> DataFrame:
    """For each other config: mean difference to base, its 95 % interval, verdict, and better/worse/same counts.

    Differences of at most ``tie`` count as the same: the last bits of a mean depend on the order of its rows.
    """
    ref = scores.where(F.col(by) == base).select(on, F.col(value).alias("__ref"))
    diff = scores.where(F.col(by) != base).join(ref, on).withColumn("d", F.col(value) - F.col("__ref"))
    ci = 1.96 * F.stddev_samp("d") / F.sqrt(F.count("*"))
    better, worse, same = F.count_if(F.col("d") > tie), F.count_if(F.col("d") < -tie), F.count_if(F.abs("d") <= tie)
    stats = diff.groupBy(by).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), ci.alias("ci"), better.alias("better"), worse.alias("worse"), same.alias("same"))
    return stats.withColumn("verdict", F.when(F.abs("mean") > F.col("ci"), F.when(F.col("mean") > 0, "better").otherwise("worse")).otherwise("not significant"))


def weighted(parts: DataFrame, score: str, n: str) -> DataFrame:
    return parts.agg((F.sum(F.col(score) * F.col(n)) / F.sum(n)).alias("weighted"))


def submission(predictions: DataFrame, expected: DataFrame, fallback: list[str], k: int = 25, id_: str = "molecule_id") -> DataFrame:
    """(id, smiles): the first k non-empty guesses joined by ';', the fallback where there are none.

    A molecule of two lists (two rows of one rank) is an error; without a fallback, so is a molecule without a
    guess. Ids that are not expected stay.
    """
    kept = predictions.where(F.col("smiles").isNotNull() & (F.col("smiles") != ""))
    order = F.array_sort(F.collect_list(F.struct("rank", "smiles")))
    lists = kept.groupBy(id_).agg(order.alias("l"), (F.count("*") - F.count_distinct("rank")).alias("twice"))
    checked = lists.withColumn("l", F.when(F.col("twice") > 0, F.raise_error(F.concat(F.lit("duplicate id: "), F.col(id_).cast("string"))).cast("array<struct<rank:int,smiles:string>>")).otherwise(F.col("l")))
    given = checked.select(id_, F.array_join(F.slice(F.transform("l", lambda x: x["smiles"]), 1, k), ";").alias("smiles"))
    ids = expected.select(id_).union(predictions.select(id_)).distinct()
    default = F.lit(";".join([s for s in fallback if s][:k])) if fallback else F.raise_error(F.concat(F.lit("no guess for "), F.col(id_).cast("string"))).cast("string")
    return ids.join(given, id_, "left").select(id_, F.coalesce("smiles", default).alias("smiles"))

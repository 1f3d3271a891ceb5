"""Views of the driver tables that stand for the engine's inputs, in Spark and (for the oracle) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long peaks: molecule_id, adduct, mz, intensity, seq."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("molecule_id"), F.col("event_type").alias("adduct"), F.col("value").alias("mz"), ((F.get_json_object("props", "$.k").cast("int") + 1) / 100.0).alias("intensity"), F.col("event_id").alias("seq"))


PEAKS = "peaks AS (SELECT user_id AS molecule_id, event_type AS adduct, value AS mz, (CAST(json_extract_string(props, '$.k') AS INT) + 1) / 100.0::DOUBLE AS intensity, event_id AS seq FROM events)"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spectrum for each (molecule, adduct): seq, molecule_id, adduct, peaks (ascending)."""
    return peaks(spark, sf_dir).groupBy("molecule_id", "adduct").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("mz", "intensity"))).alias("peaks"))


SPECTRA = PEAKS + ", spectra AS (SELECT molecule_id, adduct, min(seq) AS seq, list(struct_pack(mz := mz, intensity := intensity) ORDER BY mz, intensity) AS peaks FROM peaks GROUP BY ALL)"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: key, name, mass, fp (two 32-bit words), popcount, embedding."""
    e, p = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "part")
    joined = e.join(p, e.vec_id == p.p_partkey)
    return joined.select(F.col("vec_id").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("mass"), B.sign_words(F.col("embedding"), 2).alias("fp"), "embedding", "label").withColumn("popcount", B.popcount(F.col("fp")))


_WORD = "list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {at}] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT"
POOL = f"pool AS (SELECT vec_id AS key, p_name AS name, p_retailprice AS mass, {_WORD.format(at=1)} AS w0, {_WORD.format(at=33)} AS w1, embedding, label FROM embeddings JOIN part ON vec_id = p_partkey), pooled AS (SELECT *, bit_count(w0)::INT + bit_count(w1)::INT AS popcount FROM pool)"


def queries(spark: SparkSession, sf_dir: str, offset: float = 0.0004) -> DataFrame:
    """Masses to look for: of all parts, each off by a little more; beyond the pool's for some."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("query_id"), (F.col("p_retailprice") + F.col("p_size") * offset + F.when(F.col("p_partkey") % 5 == 0, 101.0).otherwise(0.0)).alias("center"))


QUERIES = "queries AS (SELECT p_partkey AS query_id, p_retailprice + p_size * 0.0004::DOUBLE + CASE WHEN p_partkey % 5 = 0 THEN 101.0::DOUBLE ELSE 0.0::DOUBLE END AS center FROM part)"

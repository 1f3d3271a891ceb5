"""Readers with explicit schemas. All of them only see Spark paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPECTRA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("inchikey14", T.StringType()), T.StructField("normalized_smiles", T.StringType()),
    T.StructField("precursor_mz", T.DoubleType()), T.StructField("adduct", T.StringType()), T.StructField("ionization_mode", T.StringType()),
    T.StructField("ms2_mzs", T.ArrayType(T.DoubleType())), T.StructField("ms2_normalized_intensities", T.ArrayType(T.DoubleType())), T.StructField("ingest_lib", T.StringType()),
])


def spectra(spark: SparkSession, path: str, test: bool = False) -> DataFrame:
    """Labelled spectra, or (test) unlabelled ones with molecule_id, under the engine's names."""
    schema = T.StructType([f for f in SPECTRA.fields if not (test and f.name in ("inchikey14", "normalized_smiles"))] + ([T.StructField("molecule_id", T.StringType())] if test else []))
    names = {"inchikey14": "key", "normalized_smiles": "smiles", "ionization_mode": "mode", "ms2_mzs": "mzs", "ms2_normalized_intensities": "intensities"}
    return spark.read.schema(schema).parquet(path).withColumnsRenamed({a: b for a, b in names.items() if a in schema.names})


def columns(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Only these columns are read."""
    return spark.read.parquet(path).select(*names)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def structures(spark: SparkSession, path: str) -> DataFrame:
    """An external table of structures: the key is the first block of its identifier."""
    return structures_from(spark.read.parquet(path), "inchikey", "canonical_smiles")


def structures_from(df: DataFrame, identifier: str, smiles: str, sep: str = "-") -> DataFrame:
    return df.withColumn("key", F.split(identifier, sep)[0]).withColumnRenamed(smiles, "smiles")


def tsv_lines(spark: SparkSession, path: str, limit: int | None = None, tasks: int | None = None) -> DataFrame:
    """(id, smiles) of lines with two fields exactly; others are skipped. Gzip files don't split: rows are dealt anew."""
    parts = F.split(F.regexp_replace("value", r"[\r\n]+$", ""), "\t", -1)
    rows = spark.read.text(path).withColumn("p", parts).where(F.size("p") == 2)
    rows = rows if limit is None else rows.limit(limit)
    return (rows if tasks is None else rows.repartition(tasks)).select(F.get("p", F.lit(0)).alias("id"), F.get("p", F.lit(1)).alias("smiles"))


def by_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in keys."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def late(ranked: DataFrame, wide: DataFrame, on: str) -> DataFrame:
    """Wide columns for the few rows that a ranking left."""
    from ..operators.joins import bounded_broadcast

    return wide.join(bounded_broadcast(ranked), on)

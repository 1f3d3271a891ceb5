"""A leak-free evaluation split of a collection from several sources.

Whoever evaluates a model on sources that it was not trained on must be sure that no held-out row has a copy in the
sources it was trained on. This job normalises every text (white space, case), drops empty ones, and takes rows of equal
normalised text as one key. Of each key the best row stays: that of best quality, then of lowest id. A key is

* ``held``, if all its rows come from held-out sources;
* ``train`` or ``validation`` otherwise, by the first digits of its hash, so that copies never part;
  ``leaked`` marks keys that held-out sources have too.

Output: rows/split=*/lang=* (Parquet), and summary/ with a row for each of those partitions. Both are replaced as a
whole: a second run over the same tables leaves the same rows. Rows without a source count as not held out; texts
without a language go to ``none``; of several quality labels of an id the best counts; null ids come last among equals.

    python -m jobs.holdout --documents PATH --labels PATH --output PATH [--config FILE]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ranking import best_with

from .common import configured, log, main

ROWS = "key string, doc_id bigint, text string, source string, quality int, n_rows bigint, n_sources bigint, leaked boolean, split string, lang string"


def keyed(documents: DataFrame, labels: DataFrame, held_out: list[str]) -> DataFrame:
    """Rows with a text: their key, quality and whether their source is held out."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # Other white space becomes spaces by plain replacement: the pattern then only meets the few runs of several.
    spaced = F.col("text")
    for c in "\t\n\r\f":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    normal = F.lower(F.trim(F.regexp_replace(spaced, " {2,}", " ")))
    # A text is empty once normalised if it has white space only, which its first letter tells: no text is normalised for it.
    full = documents.where(F.col("text").rlike(r"[^ \t\n\r\f]")).join(best, "doc_id", "left")
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit("none"))
    return full.select(F.sha2(normal, 256).alias("key"), "doc_id", "text", lang.alias("lang"), "source", "quality", F.coalesce(F.col("source").isin(held_out), F.lit(False)).alias("held"))


def split(rows: DataFrame, validation_percent: int) -> DataFrame:
    """The best row of each key, and where it goes. Keys are pre-aggregated in their tasks: one that a third of all rows share is a few rows in the shuffle."""
    order = [("quality", True), ("doc_id", False), ("source", False), ("lang", False), ("text", False)]
    of_key = [F.count("*").alias("n_rows"), F.size(F.collect_set("source")).cast("long").alias("n_sources"), F.min("held").alias("all_held"), F.max("held").alias("any_held")]
    best = best_with(rows, ["key"], order, *of_key)
    validation = F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % 100 < validation_percent
    where = F.when(F.col("all_held"), "held").when(validation, "validation").otherwise("train")
    return best.drop("held").withColumn("leaked", F.col("any_held") & ~F.col("all_held")).withColumn("split", where)


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict | None = None) -> str:
    """Writes the split of the tables at two paths; returns the path of its rows."""
    config = config or configured("holdout")
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    made = split(keyed(docs, spark.read.parquet(labels).select("doc_id", "quality"), config["held_out_sources"]), config["validation_percent"])
    names = [c.split()[0] for c in ROWS.split(", ")]
    # Rebalanced by partition: files of the size that Spark aims at, however much one language has.
    made.select(*names).hint("rebalance", "split", "lang").write.mode("overwrite").option("maxRecordsPerFile", config["records_per_file"]).partitionBy("split", "lang").parquet(f"{output}/rows")
    log.info("holdout: read %s rows of %s and %s of %s", docs.count(), documents, spark.read.parquet(labels).count(), labels)
    written = spark.read.schema(ROWS).parquet(f"{output}/rows")
    summary = written.groupBy("split", "lang").agg(F.count("*").alias("keys"), F.sum("n_rows").alias("rows"), F.sum(F.col("leaked").cast("long")).alias("leaked"), F.sum(F.length("text")).alias("chars"))
    summary.coalesce(1).write.mode("overwrite").parquet(f"{output}/summary")  # a row for each partition
    for r in spark.read.parquet(f"{output}/summary").orderBy("split", "lang").collect():
        log.info("holdout: wrote split=%s lang=%s: %s keys of %s rows, %s leaked", r.split, r.lang, r["keys"], r["rows"], r.leaked)
    return f"{output}/rows"


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that run wrote."""
    return spark.read.schema(ROWS).parquet(path)


if __name__ == "__main__":
    main("holdout", __doc__, {"documents": "Parquet: doc_id, text, lang, source", "labels": "Parquet: doc_id, quality", "output": "folder to write to"}, run)

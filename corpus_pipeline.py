"""A corpus pipeline over documents. STAGES lists its stages; each one's rows are the next one's documents.

Every stage takes (spark, docs, sf_dir) and looks at all of docs; all but the last return the columns of
documents. Decisions are made on rows, not on ids: a row is its doc_id and its text, so rows with a null or
repeated doc_id are judged one by one. A stage copes with what its operator copes with: nulls in any column,
empty and very long texts, repeated rows, tables without rows, and further columns of any type and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, langid, packing, pii
from lodestone.llm.common import BROADCAST_IDS, cut, fresh, plain, table

#: A prediction of at least this score, on a text of so many code points, replaces another language that is given.
SURE, ENOUGH = 0.9, 100
NEAR = jaccard.Rule(5, 80)


def _whole(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct, ``doc``, beside columns of its own, whose names then can't clash."""
    return docs.select(F.struct(*plain(docs)).alias("doc"), *(c.alias(n) for n, c in more.items()))


def _without(rows: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """rows less those equal to one of gone in ``on``, nulls being equal; gone is broadcast only if few."""
    gone = cut(gone.select(*(F.col(c).alias(f"gone_{c}") for c in on)).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in on]
    return rows.join(few, same, "left_anti")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language (no text, or no letter in it).

    lang becomes the predicted one where none is given, and where the prediction is sure.
    """
    model = langid.learn(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    if model is None:  # not a single known language to learn from: what has letters stays
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    said, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    told = langid.predict(docs, model, plain(docs), names=(said, score))
    spoken = told.where(F.col(said) != langid.UNKNOWN)
    sure = (F.col(score) >= SURE) & (F.length("text") >= ENOUGH)
    best = F.when(F.col("lang").isNull() | sure, F.col(said)).otherwise(F.col("lang"))
    return spoken.withColumn("lang", best).select(*plain(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group linked by 5-word shingles at 80 percent.

    First is the least doc_id (null last), then the least hash of the text. Of rows that are equal in both,
    one stays, with the least other columns as JSON. Texts without words are nobody's copy, but for equal rows.
    """
    key = ["doc_id", "text_hash"]
    rows = _whole(docs, doc_id=F.col("doc_id").cast("long"), text_hash=F.xxhash64("text"))
    later = jaccard.later_copies(docs, NEAR)
    kept = _without(rows, later, key)
    again = cut(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).count().where("count > 1"))
    if again.isEmpty():
        return kept.select("doc.*")
    once = _without(kept, again, key).select("doc")
    listed = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key]
    repeated = kept.alias("k").join(listed.alias("a"), same, "left_semi")
    one = repeated.groupBy(*key).agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return once.union(one.select("doc")).select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, verbatim or paraphrased: it is their text that decides."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark"))
    rows = _whole(docs, text_hash=F.xxhash64("text"))
    return _without(rows, found.select(F.col("doc_id").alias("text_hash")), ["text_hash"]).select("doc.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each piece of personal data in its place."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids. See packing. Workers that ran other stages have less to spare."""
    return packing.pack_documents(docs, end_id=1, window=2048, keep=150_000)


STAGES = [
    ("language", languages),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: No SQL for a learned classifier or a tokenizer: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, decontaminate, fingerprint, jaccard, langid, packing, pii, suffixes, token_store, toxicity, unigram, whitening
from .common import dropped_at_end, new_folder, table
from .oracles import ORACLES


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents. See decontaminate."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out. See langid."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs, model, ["doc_id", langid.held_out().alias("held_out")])


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document through the store's files. See token_store."""
    path = token_store.write_store(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), end_id=0)
    return token_store.read_digests(spark, dropped_at_end(spark, path))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingles at 85 percent. See jaccard."""
    return jaccard.components_by_jaccard(table(spark, sf_dir, "documents"), jaccard.Rule(4, 85))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes. See suffixes."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), 400)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2048. See packing."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), end_id=1, window=2048)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text. See fingerprint."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated windows of 35 words. See blocks."""
    return blocks.remove_repeats(table(spark, sf_dir, "documents"), 35)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. See pii."""
    return pii.find(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram vocabulary. See unigram."""
    return unigram.token_counts(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding. See whitening."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels that are not held out. See toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, model, [F.col("doc_id"), toxicity.held_out().alias("held_out")])


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_langid, op3_token_store, op4_jaccard, op5_suffixes, op6_pack, op7_fingerprint, op8_blocks, op9_pii, op10_token_counts, op11_whitening, op12_toxicity)}

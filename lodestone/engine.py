"""The engine as one object: ingest pools, build libraries, search, predict, sample decoys, evaluate, sweep.

Tables come and go as DataFrames; readers and writers for paths are in sources, and ``python -m lodestone`` runs the
same steps from a shell. Chemistry and trained networks are callables or tables (see functions.models).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT, EngineConfig
from .functions import models
from .functions import peaks as P
from .operators import evaluate, library, predict, sweeps
from .operators.joins import widening_join
from .operators.ranking import keep_best, top_k
from .sources import readers, writers


class Engine:
    def __init__(self, spark: SparkSession, cfg: EngineConfig = DEFAULT):
        self.spark, self.cfg = spark, cfg

    # --- pools and libraries -------------------------------------------------------------------------------------

    def ingest_pool(self, path: str, out: str, parse: models.StructureParser, limit: int | None = None, shards: int = 64, rows: int = 4_000_000) -> DataFrame:
        """Raw lines (id, tab, structure) at path as a pool at out: filtered, the lightest row of each key, sorted by mass."""
        raw = readers.tsv_lines(self.spark, path, limit, shards)
        taken = models.pool_rows(raw, parse, self.cfg)
        best = keep_best(taken, ["key"], [F.col("exact_mass"), F.col("id")])
        return self.spark.read.parquet(writers.by_mass(best, out, "exact_mass", shards, rows))

    def reshard(self, src: str, out: str, rows: int, by: str = "exact_mass", shards: int = 64) -> DataFrame:
        """A pool in files of at most so many rows, ranges of mass staying together."""
        return self.spark.read.parquet(writers.by_mass(self.spark.read.parquet(src), out, by, shards, rows))

    def build_library(self, spectra: DataFrame) -> DataFrame:
        return library.build_library(spectra, self.cfg)

    def build_pool(self, *sources: DataFrame) -> DataFrame:
        """Structures of several sources; where several have a key, the first one's row stays."""
        columns = sources[0].columns
        ranked = [s.select(*columns).withColumn("__source", F.lit(i)) for i, s in enumerate(sources)]
        both = ranked[0]
        for s in ranked[1:]:
            both = both.unionByName(s)
        return keep_best(both, ["key"], [F.col("__source"), *map(F.col, columns)]).drop("__source")

    # --- search and prediction -----------------------------------------------------------------------------------

    def search(self, spectra: DataFrame, known: DataFrame) -> DataFrame:
        """Anchors of each spectrum (seq, mode, precursor_mz, mzs, intensities) in a library."""
        peaks = P.make_peaks(F.col("mzs"), F.col("intensities"))
        queries = spectra.select(F.col("seq").alias("query_id"), F.lower(F.trim("mode")).alias("mode"), "precursor_mz", peaks.alias("peaks"))
        return library.search(queries, known, self.cfg)

    def predict(self, version: int, spectra: DataFrame, known: DataFrame, pool: DataFrame | None = None, large: DataFrame | None = None, probs: DataFrame | None = None, canonical: DataFrame | None = None, scorer: Callable | None = None) -> DataFrame:
        """(molecule_id, rank, ckey, smiles) by one of the four generations; scorer takes the place of the model score (v3)."""
        if version == 1:
            return predict.predict_v1(spectra, known, canonical, self.cfg)
        if version == 2:
            return predict.predict_v2(spectra, known, pool, canonical, self.cfg)
        if version == 3:
            return predict.predict_v3(spectra, known, pool, probs, canonical, self.cfg, scorer)
        if version == 4:
            return predict.predict_v4(spectra, known, pool, large, probs, canonical, self.cfg)
        raise ValueError(f"no prediction of version {version}; there are 1 to 4")

    def submission(self, predictions: DataFrame, expected: DataFrame, fallback: list[str]) -> DataFrame:
        return evaluate.submission(predictions, expected, fallback, self.cfg.guesses)

    # --- decoys --------------------------------------------------------------------------------------------------

    def decoys(self, truths: DataFrame, pool: DataFrame, n: int = 30_000, k: int | None = None, seed: int = 0) -> DataFrame:
        """For n of the truths (key, mass, fp), k candidates of their window at random, by a seeded hash: reproducible."""
        hashed = lambda *c: F.xxhash64(*c, F.lit(seed))
        chosen = truths.orderBy(hashed("key"), "key").limit(n).select(F.col("key").alias("query_id"), F.col("mass").alias("center"), F.col("fp").alias("true_fp"))
        window = widening_join(chosen, pool.select("key", "exact_mass", "fp"), "query_id", "center", "exact_mass", self.cfg.widths)
        others = window.where("fp <> true_fp")
        size = others.groupBy("query_id").count().where(F.col("count").between(1, self.cfg.max_window)).select("query_id")
        kept = others.join(size, "query_id", "left_semi")
        return top_k(kept, ["query_id"], [hashed("query_id", "key"), F.col("key")], k or self.cfg.decoys).select("query_id", "rank", "key", "fp")

    def mine_decoys(self, window: DataFrame, truth: DataFrame, k: int | None = None) -> DataFrame:
        """The k best-scored wrong candidates of each window, with the truth's rank: see predict.hard_decoys."""
        return predict.hard_decoys(window, truth, k or self.cfg.decoys, self.cfg)

    # --- evaluation ----------------------------------------------------------------------------------------------

    def evaluate(self, predictions: DataFrame, answers: DataFrame) -> DataFrame:
        """(mrr, n) of predictions against answers (molecule_id, ckey)."""
        return evaluate.mrr(answers, predictions, self.cfg.guesses)

    def paired_sweep(self, run: Callable[["Engine"], DataFrame], answers: DataFrame, grid: dict[str, dict], base: str) -> DataFrame:
        """run under every configuration (a name and the fields it changes), each held against base molecule by molecule."""
        scores = None
        for name, fields in grid.items():
            engine = Engine(self.spark, replace(self.cfg, **fields))
            rr = evaluate.reciprocal_ranks(answers, run(engine), engine.cfg.guesses).withColumn("config", F.lit(name))
            scores = rr if scores is None else scores.unionByName(rr)
        return evaluate.paired(scores, base)

    def tier_sweep(self, first: DataFrame, second: DataFrame, answers: DataFrame, caps: list[int], share: float = 0.49) -> DataFrame:
        return sweeps.tier_caps(first, second, answers, caps, share, self.cfg.guesses)

    def select(self, scores: DataFrame, by: list[str] = ()) -> DataFrame:
        """The best configuration of (config, mrr), for each regime if there are any."""
        return sweeps.selected(scores, "mrr", "config", by)

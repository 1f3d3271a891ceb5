"""Spectral libraries: building, the binned index, and two-phase search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import peaks as P
from ..functions.matching import modified_cosines
from .joins import stored
from .ranking import keep_best, top_k
from .values import alike

REQUIRED = ("key", "smiles", "precursor_mz", "adduct", "mode", "mzs", "intensities")


def clean(spectra: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Rows with all required values (NaN counts as missing) and a peak, the mode trimmed and lower-cased."""
    kept = spectra.na.drop(subset=[c for c in required if c in spectra.columns])
    return kept.withColumn("mode", F.lower(F.trim("mode"))).where(F.size("mzs") > 0)


def build_library(spectra: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One row for each (key, adduct): that with most peaks (ties: lowest seq), cut to the strongest peaks.

    spectra: seq, key, smiles, precursor_mz, adduct, mode, mzs, intensities. Adds spec_id and peaks.
    """
    best = keep_best(clean(spectra), ["key", "adduct"], [F.size("mzs").desc(), F.col("seq")])
    kept = P.top_peaks(P.make_peaks(F.col("mzs"), F.col("intensities")), cfg.peaks_kept)
    return best.select(F.col("seq").alias("spec_id"), "key", "smiles", "precursor_mz", "adduct", "mode", kept.alias("peaks"))


def binned(spectra: DataFrame, id_: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(id, mode, bin, w): entropy-weighted intensities summed by bin, of length 1 for each spectrum.

    Summed inside the row: no shuffle, whatever the number of peaks.
    """
    mode = [F.col("mode")] if "mode" in spectra.columns else []
    weighted = spectra.select(id_, *mode, P.reweighted(F.col("peaks")).alias("p"))
    bins = F.transform("p", lambda x: F.struct(P.bin_of(x["mz"], cfg.bin_width, cfg.bins).alias("bin"), x["intensity"].alias("w")))
    sums = F.transform(F.array_sort(F.array_distinct(F.transform("p", lambda x: P.bin_of(x["mz"], cfg.bin_width, cfg.bins)))), lambda b: F.struct(b.alias("bin"), F.aggregate(F.filter("b", lambda x: x["bin"] == b), F.lit(0.0), lambda a, x: a + x["w"]).alias("w")))
    dense = weighted.withColumn("b", bins).withColumn("s", sums)
    scaled = P.let(F.col("s"), lambda s: P.let(P.norm(P.field(s, "w")), lambda n: F.transform(s, lambda x: F.struct(x["bin"].alias("bin"), F.when(n > 0, x["w"] / n).otherwise(0.0).alias("w")))))
    return dense.select(id_, *mode, F.explode(scaled).alias("e")).select(id_, *mode, "e.bin", "e.w")


def coarse(queries: DataFrame, index: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, spec_id, coarse): dots of binned vectors of one mode, positive ones, the best of each query."""
    q = binned(queries, "query_id", cfg).withColumnRenamed("w", "qw")
    dots = q.join(index, ["mode", "bin"]).groupBy("query_id", "spec_id").agg(F.sum(F.col("w") * F.col("qw")).alias("coarse"))
    return top_k(dots.where("coarse > 0"), ["query_id"], [F.col("coarse").desc(), F.col("spec_id")], cfg.coarse_top, "coarse_rank")


def search(queries: DataFrame, library: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Anchors of each query: (query_id, spec_id, key, smiles, sim, rank), by a coarse screen and exact rescoring.

    queries: query_id, mode, precursor_mz, peaks. sim is the modified cosine, plus a bonus for precursors
    within ppm; rows of sim 0 are left out, and several adducts of a key may stay. Queries of equal mode, precursor
    and peaks are searched once.
    """
    q = queries.select("query_id", "mode", "precursor_mz", P.top_peaks(F.col("peaks"), cfg.peaks_kept).alias("peaks")).where(F.size("peaks") > 0)
    one, every = alike(q, "query_id", ["mode", "precursor_mz", "peaks"], ["query_id"])
    found = stored(searched(one, library, cfg)).withColumnRenamed("query_id", "of")
    return every.join(found, "of").select("query_id", "spec_id", "key", "smiles", "sim", "rank")


def searched(q: DataFrame, library: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """search() of queries that all differ, and whose peaks are cut already."""
    screened = coarse(q, binned(library, "spec_id", cfg), cfg)
    # Weights are made once for each spectrum, not for each pair.
    own = q.select("query_id", F.col("precursor_mz").alias("q_mz"), P.reweighted(F.col("peaks")).alias("q_peaks"))
    known = library.select("spec_id", "precursor_mz", P.reweighted(F.col("peaks")).alias("peaks"))
    met = screened.join(own, "query_id").join(known, "spec_id")
    near = F.abs(F.col("precursor_mz") - F.col("q_mz")) <= F.col("q_mz") * cfg.ppm / 1e6
    pairs = met.select("query_id", "spec_id", (F.col("q_mz") - F.col("precursor_mz")).alias("shift"), near.alias("near"), "q_peaks", "peaks")
    exact = modified_cosines(pairs, ["query_id", "spec_id", "near"], "q_peaks", "peaks", "shift", cfg.match_tol)
    scored = exact.withColumn("sim", F.col("sim") + F.when(F.col("near"), cfg.ppm_bonus).otherwise(0.0)).where("sim > 0")
    # Similarities that agree to nine digits are ties; what is left joins its names.
    best = top_k(scored.select("query_id", "spec_id", "sim"), ["query_id"], [F.round("sim", 9).desc(), F.col("spec_id")], cfg.fine_top)
    return best.join(library.select("spec_id", "key", "smiles"), "spec_id").select("query_id", "spec_id", "key", "smiles", "sim", "rank")


def frequent(library: DataFrame, mode: str | None, n: int) -> DataFrame:
    """The n keys with most rows of a mode (of all modes if it has none), payload of the lowest precursor."""
    own = library.where(F.col("mode") == mode) if mode is not None else library
    rows = own if mode is None or not own.isEmpty() else library
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("smiles", F.struct("precursor_mz", "spec_id")).alias("smiles"))
    return counts.orderBy(F.col("n").desc(), "key").limit(n)


def frequent_by_mode(library: DataFrame, n: int) -> DataFrame:
    """(mode, rank, key, smiles) of frequent() for each mode, and for all modes under a null one."""
    both = library.select("mode", "key", "smiles", "precursor_mz", "spec_id").unionByName(library.select(F.lit(None).cast("string").alias("mode"), "key", "smiles", "precursor_mz", "spec_id"))
    counts = both.groupBy("mode", "key").agg(F.count("*").alias("n"), F.min_by("smiles", F.struct("precursor_mz", "spec_id")).alias("smiles"))
    return top_k(counts, ["mode"], [F.col("n").desc(), F.col("key")], n)

"""The four generations of prediction, as compositions of one another's parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import peaks as P
from ..functions import scores as S
from .joins import durable, widening_join
from .library import frequent_by_mode, search
from .nearest import ANCHORS, weighted_best
from .ranking import first_per_key, max_pool, tier_fill, top_k
from .values import alike
from .windows import best_of_windows, best_until_scored, levels_of


def tied(score: Column) -> Column:
    """Scores that agree to nine digits are ties, which the key breaks: last bits depend on the order of sums."""
    return F.round(score, 9)


def adduct_table(spark: SparkSession, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return spark.createDataFrame(cfg.adducts(), "adduct string, n_mer int, charge int, shift double")


def neutral_mass(df: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds mass; null for adducts that the table lacks and masses that are not positive."""
    table = F.broadcast(adduct_table(df.sparkSession, cfg))  # two dozen rows
    mass = (F.col("precursor_mz") * F.col("charge") - F.col("shift")) / F.col("n_mer")
    return df.join(table, "adduct", "left").withColumn("mass", F.when(mass > 0, mass)).drop("n_mer", "charge", "shift")


def consensus(spectra: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One query for each (molecule_id, adduct): groups of several spectra merged, single ones as they are.

    spectra: seq, molecule_id, adduct, mode, precursor_mz, mzs, intensities; the first row's values count.
    """
    own = spectra.withColumn("peaks", P.make_peaks(F.col("mzs"), F.col("intensities")))
    groups = own.groupBy("molecule_id", "adduct").agg(F.min("seq").alias("seq"), F.count("*").alias("n"), F.min_by(F.struct("mode", "precursor_mz"), "seq").alias("first"), F.flatten(F.array_sort(F.collect_list("peaks"))).alias("all"))
    merged = F.when(F.col("n") > 1, P.merge_anchored(F.col("all"), cfg.merge_tol)).otherwise(F.col("all"))
    return groups.select(F.concat_ws("|", "molecule_id", "adduct").alias("query_id"), "molecule_id", "adduct", "seq", F.lower(F.trim("first.mode")).alias("mode"), "first.precursor_mz", merged.alias("peaks"))


def anchors_with_bits(anchors: DataFrame, pool: DataFrame) -> DataFrame:
    """Anchors whose key the pool has, with its fingerprint."""
    return anchors.join(pool.select("key", F.col("fp").alias("a_fp"), F.col("popcount").alias("a_pop")), "key").select("query_id", "sim", "a_fp", "a_pop")


def propagated(window: DataFrame, anchors: DataFrame, cfg: EngineConfig = DEFAULT, by: str = "query_id", few_anchors: bool = False) -> DataFrame:
    """window rows with prop: the greatest sim ** exponent * Tanimoto over the query's anchors, 0 without a pool hit.

    has_anchors tells whether a query has any. Queries may share anchors (by: what rows and anchors have in common)
    and may have any number of them, most pairs being ruled out by bounds (nearest.py); few_anchors: none has more
    than a search leaves.
    """
    weighted = anchors.select(by, "a_fp", "a_pop", F.pow("sim", F.lit(cfg.exponent)).alias("weight"))
    return weighted_best(window, weighted, [by], "prop", few_anchors=few_anchors)


def canonical_top(pooled: DataFrame, canonical: DataFrame | None, cfg: EngineConfig = DEFAULT, k: int | None = None) -> DataFrame:
    """(molecule_id, rank, ckey, smiles): the best keys, one for each canonical key (the structure itself if it has none)."""
    ranked = top_k(pooled, ["molecule_id"], [tied(F.col("score")).desc(), F.col("key")], cfg.fine_top)
    named = ranked.join(canonical, "smiles", "left") if canonical is not None else ranked.withColumn("ckey", F.lit(None).cast("string"))
    return first_per_key(named.withColumn("ckey", F.coalesce("ckey", F.col("smiles").cast("string"))), ["molecule_id"], "ckey", "rank", k or cfg.guesses).select("molecule_id", "rank", "ckey", "smiles")


def with_fallback(found: DataFrame, molecules: DataFrame, library: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Molecules without a guess get the most frequent keys of their mode, or of all modes if it has none."""
    common = frequent_by_mode(library, cfg.guesses)
    missing = molecules.join(found.select("molecule_id").distinct(), "molecule_id", "left_anti")
    own = missing.join(common.where("mode is not null"), "mode").select("molecule_id", "rank", F.col("key").cast("string").alias("ckey"), "smiles")
    rest = missing.join(common.where("mode is not null").select("mode").distinct(), "mode", "left_anti")
    of_all = rest.select("molecule_id").crossJoin(F.broadcast(common.where("mode is null").select("rank", F.col("key").cast("string").alias("ckey"), "smiles")))  # at most `guesses` rows
    return found.select("molecule_id", "rank", "ckey", "smiles").unionByName(own).unionByName(of_all)


def molecules_of(spectra: DataFrame) -> DataFrame:
    return spectra.groupBy("molecule_id").agg(F.lower(F.trim(F.min_by("mode", "seq"))).alias("mode"))


#: What a query's answer depends on, and what else it has.
CONTENT, OWN = ["mode", "precursor_mz", "mass", "peaks"], ["query_id", "molecule_id", "seq"]


def of_every(every: DataFrame, found: DataFrame) -> DataFrame:
    """found (query_id of a content's one query, ...) for each query of that content."""
    return every.join(durable(found.withColumnRenamed("query_id", "of")), "of").drop("of")


def predict_v1(spectra: DataFrame, library: DataFrame, canonical: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Library search of each spectrum; the best similarity of each key."""
    queries = spectra.select(F.col("seq").alias("query_id"), "molecule_id", F.lower(F.trim("mode")).alias("mode"), "precursor_mz", P.make_peaks(F.col("mzs"), F.col("intensities")).alias("peaks"))
    hits = search(queries, library, cfg).join(queries.select("query_id", "molecule_id"), "query_id").withColumnRenamed("sim", "score")
    pooled = max_pool(hits.withColumn("at", F.col("query_id") * 1000 + F.col("rank")), ["molecule_id", "key"], "score", "smiles", "at")
    return with_fallback(canonical_top(pooled, canonical, cfg), molecules_of(spectra), library, cfg)


def predict_v2(spectra: DataFrame, library: DataFrame, pool: DataFrame, canonical: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Consensus spectra; similarities of anchors carried over to candidates of the mass, which widens until one scores."""
    each_query = neutral_mass(consensus(spectra, cfg), cfg).where("mass is not null")
    queries, every = alike(each_query, "query_id", CONTENT, OWN)
    cut = best_until_scored(queries.select("query_id", "mass"), listed_anchors(search(queries, library, cfg), pool, cfg), pool, cfg.widths, cfg.fine_top, cfg)
    cut = of_every(every, cut)
    return with_fallback(canonical_top(max_pool(cut, ["molecule_id", "key"], "score", "smiles", "seq"), canonical, cfg), molecules_of(spectra), library, cfg)


def listed_anchors(found: DataFrame, pool: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, anchors) of queries that have any: weight, fp and pop of the keys found that the pool has."""
    bits = anchors_with_bits(found, pool).where((F.col("sim") > 0) & F.col("a_fp").isNotNull())
    return bits.groupBy("query_id").agg(F.collect_list(F.struct(F.pow("sim", F.lit(cfg.exponent)).alias("weight"), F.col("a_fp").alias("fp"), F.col("a_pop").alias("pop"))).alias("anchors"))


def scored_windows(spectra: DataFrame, library: DataFrame, anchor_pool: DataFrame, pool: DataFrame, probs: DataFrame | None, alpha: float, cfg: EngineConfig = DEFAULT, loglik=None) -> DataFrame:
    """Candidates of each (molecule, adduct) with their fused score, the best of each.

    probs: seq, p of raw spectra (averaged over a group), unless alpha is 1. loglik may give another model score: by its
    ``on_block`` (windows.py), or else as loglik(window, probs), for which all pairs of queries and candidates are made.
    """
    each_query, content = neutral_mass(consensus(spectra, cfg), cfg).where("mass is not null"), CONTENT
    if alpha < 1:
        each_query, content = each_query.join(mean_probs(spectra, probs), "query_id", "left"), [*CONTENT, "p"]
    # Kept: the widths, the windows and the search each start from it, and its folds make long plans.
    queries, every = alike(each_query, "query_id", content, OWN)
    if loglik is not None and not hasattr(loglik, "on_block"):
        return of_every(every, best_of_pairs(queries, library, anchor_pool, pool, alpha, cfg, loglik))
    asked, own = durable(levels_of(queries.select("query_id", "mass"), pool, cfg.widths)), queries.select("query_id", *(["p"] if alpha < 1 else []))
    if alpha > 0:
        own = own.join(listed_anchors(search(queries, library, cfg), anchor_pool, cfg), "query_id", "left")
    return of_every(every, best_of_windows(asked, own, pool, cfg.widths, cfg.fine_top, alpha, cfg, getattr(loglik, "on_block", None)))


def best_of_pairs(queries: DataFrame, library: DataFrame, anchor_pool: DataFrame, pool: DataFrame, alpha: float, cfg: EngineConfig, loglik) -> DataFrame:
    """The best of each window, from a row for each pair, which loglik gets whole."""
    window = widening_join(queries.select("query_id", "mass"), pool.select("key", "smiles", "exact_mass", "fp", "popcount"), "query_id", "mass", "exact_mass", cfg.widths)
    if alpha > 0:
        window = propagated(window, anchors_with_bits(search(queries, library, cfg), anchor_pool), cfg, few_anchors=cfg.fine_top <= ANCHORS).withColumn("prop", F.when(F.col("has_anchors"), F.col("prop")))
    else:
        window = window.withColumn("prop", F.lit(None).cast("double"))
    if alpha < 1:
        window = loglik(window, queries.select("query_id", "p").where("p is not null"), cfg)
    else:
        window = window.withColumn("lik", F.lit(0.0))
    score = S.fused(F.col("prop"), F.col("lik"), ["query_id"], alpha, cfg.model_floor)
    return top_k(window.withColumn("score", score).where("score > 0"), ["query_id"], [tied(F.col("score")).desc(), F.col("key")], cfg.fine_top)


def mean_probs(spectra: DataFrame, probs: DataFrame) -> DataFrame:
    """(query_id, p): bit probabilities averaged over the spectra of a group, element by element."""
    rows = spectra.select("seq", F.concat_ws("|", "molecule_id", "adduct").alias("query_id")).join(probs, "seq")
    summed = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.collect_list("p").alias("all"))
    mean = F.transform(F.aggregate("all", F.transform(F.get("all", F.lit(0)), lambda _: F.lit(0.0)), lambda a, p: F.zip_with(a, p, lambda x, y: x + y)), lambda x: x / F.col("n"))
    return summed.select("query_id", mean.alias("p"))


def plain_loglik(window: DataFrame, probs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds lik: the log-likelihood of a candidate's set bits."""
    bits = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("fp", F.floor(i / 32).cast("int")).bitwiseAND(F.pow(F.lit(2.0), i % 32).cast("long")) != 0)
    lik = P.let(F.transform("p", lambda x: S.logit(x, cfg.prob_eps)), lambda l: F.aggregate(bits, F.lit(0.0), lambda a, i: a + F.get(l, i)))
    return window.join(probs, "query_id", "left").withColumn("lik", F.coalesce(lik, F.lit(0.0))).drop("p")


def predict_v3(spectra: DataFrame, library: DataFrame, pool: DataFrame, probs: DataFrame, canonical: DataFrame | None = None, cfg: EngineConfig = DEFAULT, loglik=None) -> DataFrame:
    """Propagation and the model, fused in each window."""
    hits = scored_windows(spectra, library, pool, pool, probs, cfg.alpha, cfg, loglik)
    pooled = max_pool(hits, ["molecule_id", "key"], "score", "smiles", "seq")
    return with_fallback(canonical_top(pooled, canonical, cfg), molecules_of(spectra), library, cfg)


def rank_large_pool(spectra: DataFrame, library: DataFrame, anchor_pool: DataFrame, large: DataFrame, probs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(molecule_id, rank, key, smiles) of the second tier; keys are not canonical yet. Texts join the survivors only."""
    slim = large.select("key", F.lit("").alias("smiles"), "exact_mass", "fp", "popcount")
    hits = scored_windows(spectra, library, anchor_pool, slim, probs, cfg.tier2_alpha, cfg)
    best = hits.groupBy("molecule_id", "key").agg(F.max("score").alias("score"))
    ranked = top_k(best, ["molecule_id"], [tied(F.col("score")).desc(), F.col("key")], cfg.fine_top)
    return ranked.join(large.select("key", "smiles"), "key").select("molecule_id", "rank", "key", "smiles")


def predict_v4(spectra: DataFrame, library: DataFrame, pool: DataFrame, large: DataFrame, probs: DataFrame, canonical: DataFrame | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The third generation's list, filled from the large pool where it has fewer than the guesses.

    Only molecules whose first tier leaves a place open are looked up in the large pool.
    """
    hits = scored_windows(spectra, library, pool, pool, probs, cfg.alpha, cfg)
    tier1 = durable(canonical_top(max_pool(hits, ["molecule_id", "key"], "score", "smiles", "seq"), canonical, cfg))
    full = tier1.where(F.col("rank") <= min(cfg.tier1_cap, cfg.guesses)).groupBy("molecule_id").count().where(F.col("count") >= cfg.guesses)
    tier2 = rank_large_pool(spectra.join(full.select("molecule_id"), "molecule_id", "left_anti"), library, pool, large, probs, cfg)
    named = tier2.join(canonical, "smiles", "left") if canonical is not None else tier2.withColumn("ckey", F.lit(None).cast("string"))
    tier2 = named.select("molecule_id", "rank", F.coalesce("ckey", "smiles").alias("ckey"), "smiles")
    filled = tier_fill(tier1, tier2, "molecule_id", "ckey", "rank", cfg.guesses, cfg.tier1_cap)
    return with_fallback(filled.select("molecule_id", "rank", "ckey", "smiles"), molecules_of(spectra), library, cfg)


def hard_decoys(window: DataFrame, truth: DataFrame, k: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The k best-scored candidates of each window that are not the truth, with the truth's rank in it.

    window: query_id, key, fp, score; truth: query_id, fp. Windows of fewer than 2 or too many rows are left out.
    """
    w = Window.partitionBy("query_id")
    sized = window.withColumn("n", F.count("*").over(w)).where(F.col("n").between(2, cfg.max_window))
    marked = sized.join(truth.select("query_id", F.col("fp").alias("true_fp")), "query_id").withColumn("is_true", F.col("fp") == F.col("true_fp"))
    best = F.max(F.when(F.col("is_true"), F.col("score"))).over(w)
    ranked = marked.withColumn("true_rank", 1 + F.sum((F.col("score") > best).cast("long")).over(w))
    return top_k(ranked.where("not is_true"), ["query_id"], [tied(F.col("score")).desc(), F.col("key")], k).select("query_id", "rank", "key", "score", "n", "true_rank")

"""The best candidates of each query's window, without a row for any pair of query and candidate.

A window is the pool's rows in a band around a query's mass. Queries of a cell of mass are dealt into blocks, the cell's
candidates are one list, and a task scores a block against the list in numpy: what leaves it is the best rows of each query.
A block is as small as its list is long, so a task holds a bounded number of scores; the list itself is as long as the
windows of one cell, and is copied to as many tasks as the cell has work for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scores import logits, sums_of_bits
from .dots import rounded
from .joins import cells_of, durable, least_levels
from .nearest import _words
from .values import distinct_values

#: Queries of a block at most, pairs of a block, pairs of a task; tasks at most; tasks that a cell is dealt to at most.
QUERIES, SCORES, PAIRS, MOST_TASKS, PIECES = 64, 1 << 20, 1 << 24, 4096, 64


def levels_of(queries: DataFrame, pool: DataFrame, widths: tuple[float, ...]) -> DataFrame:
    """queries (query_id, mass, anything else) that find a mass of the pool (exact_mass), with the level of the least width at which they do."""
    asked = distinct_values(queries, "mass").withColumn("__at", F.col("mass"))
    found = least_levels(asked, distinct_values(pool, "exact_mass"), "__at", "mass", "exact_mass", widths).select("__at", "level")
    return queries.join(found, F.col("mass") == F.col("__at")).drop("__at")


def met(asked: DataFrame, own_parts: DataFrame, pool: DataFrame, widths: tuple[float, ...]) -> DataFrame:
    """(level, queries, candidates): blocks of asked (query_id, mass, level) with what own_parts (query_id, ...) has of them, each
    with all rows of the pool in cells that a band of its cell touches."""
    width = F.element_at(F.array(*map(F.lit, widths)), F.col("level"))
    own = asked.withColumn("__cell", F.floor(F.col("mass") / width).cast("long"))
    ends = [F.floor((F.col("mass") - width) / width).cast("long"), F.floor((F.col("mass") + width) / width).cast("long")]
    cells = own.groupBy("level", "__cell").agg(F.count("*").alias("__n"), F.min(ends[0]).alias("__lo"), F.max(ends[1]).alias("__hi"))
    looks = durable(cells.withColumn("__of", F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi"))
    in_cells = lambda df, c: df.withColumn("__c", F.explode(cells_of(F.col(c), widths))).withColumns({"level": F.col("__c.level"), "__of": F.col("__c.cell")}).drop("__c")
    held = in_cells(pool.groupBy("exact_mass").agg(F.count("*").alias("__k")), "exact_mass").groupBy("level", "__of").agg(F.sum("__k").alias("__k"))
    sized = looks.join(held, ["level", "__of"]).groupBy("level", "__cell").agg(F.max("__n").alias("__n"), F.sum("__k").alias("__k"))
    parts = F.ceil(F.col("__n") / F.greatest(F.lit(1), F.least(F.lit(QUERIES), F.floor(SCORES / F.col("__k")))))
    pieces = F.least(F.ceil(F.col("__n") * F.col("__k") / PAIRS), F.lit(PIECES), F.col("__parts"))
    sized = durable(sized.withColumn("__parts", parts).withColumn("__pieces", pieces))
    total = sized.agg(F.sum(F.col("__n") * F.col("__k")).cast("double").alias("n")).first().n or 0
    tasks, on = int(min(max(total // PAIRS, 2 * pool.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)), ["level", "__cell", "__piece"]
    dealt = own.join(sized.select("level", "__cell", "__parts", "__pieces"), ["level", "__cell"]).withColumn("__part", F.pmod(F.xxhash64("query_id"), F.col("__parts")))
    dealt = dealt.join(own_parts, "query_id")
    rows = F.struct("query_id", "mass", *(c for c in own_parts.columns if c != "query_id"))
    blocks = dealt.withColumn("__piece", F.pmod(F.col("__part"), F.col("__pieces"))).repartition(tasks, *on).groupBy(*on, "__part").agg(F.collect_list(rows).alias("queries"))
    places = looks.drop("__n").join(sized.select("level", "__cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__pieces") - 1)).alias("__piece")), ["level", "__cell"])
    offered = in_cells(pool, "exact_mass").join(places, ["level", "__of"])
    lists = offered.repartition(tasks, *on).groupBy(*on).agg(F.collect_list(F.struct(*pool.columns)).alias("candidates"))
    return blocks.join(lists.hint("merge"), on).select("level", "queries", "candidates")


def plain(words: np.ndarray, probs: list, eps: float, windows: list[np.ndarray]) -> np.ndarray:
    """The log-likelihood of set bits; 0 without probabilities. probs: of each query (values, missing) or None."""
    wide = max((len(x[0]) for x in probs if x is not None), default=0)
    weights = np.zeros((len(probs), wide))
    for k, x in enumerate(probs):
        if x is not None:
            weights[k, : len(x[0])] = logits(*x, eps)
    return sums_of_bits(words, weights)


def _propagated(words: np.ndarray, pops: np.ndarray, anchors: pa.Array) -> np.ndarray:
    """The greatest weight * Tanimoto over a query's anchors (weight, fp, pop) for each candidate."""
    weight, pop = (np.nan_to_num(anchors.field(k).to_numpy(zero_copy_only=False).astype(float)) for k in (0, 2))
    theirs, best = _words(anchors.field(1), words.shape[1]), np.zeros(len(words))
    step = max(1, SCORES // max(1, len(words)))
    for lo in range(0, len(weight), step):
        both = np.zeros((len(weight[lo : lo + step]), len(words)))
        for k in range(words.shape[1]):
            both += np.bitwise_count(theirs[lo : lo + step, k][:, None] & words[:, k])
        either = pop[lo : lo + step][:, None] + pops - both
        best = np.maximum(best, (weight[lo : lo + step][:, None] * np.divide(both, either, out=np.zeros_like(both), where=either > 0)).max(axis=0))
    return best


def _from_0_to_1(x: np.ndarray, constant: float) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return (x - lo) / (hi - lo) if hi > lo else np.full(len(x), constant)


def fused(prop: np.ndarray | None, lik: np.ndarray | None, alpha: float, floor: float, n: int) -> np.ndarray:
    """scores.fused of one window; prop is None without anchors."""
    out = np.zeros(n)
    if alpha > 0 and prop is not None:
        out += alpha * _from_0_to_1(prop, 1.0 if prop.max() > 0 else 0.0)
    if alpha < 1:
        out += (1 - alpha) * (floor + (1 - floor) * _from_0_to_1(lik, 1.0))
    return out


def _best(score: np.ndarray, top: int) -> np.ndarray:
    """Places of the best positive scores, rounded as ranks see them; ties: lower place."""
    at = np.flatnonzero(score > 0)
    ranked = -rounded(score[at], 9)
    if len(at) > 4 * top:
        near = np.flatnonzero(ranked <= np.partition(ranked, top - 1)[top - 1])
        at, ranked = at[near], ranked[near]
    return at[np.argsort(ranked, kind="stable")[:top]]


def _longest(lists: pa.Array) -> int:
    return int(pc.max(pc.list_value_length(lists)).as_py() or 0)


def _values(lists: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray] | None:
    if not lists[row].is_valid:
        return None
    own = lists[row].values
    return own.to_numpy(zero_copy_only=False).astype(float), own.is_null().to_numpy(zero_copy_only=False)


def best_of_windows(asked: DataFrame, own_parts: DataFrame, pool: DataFrame, widths: tuple[float, ...], top: int, alpha: float | None, cfg: EngineConfig = DEFAULT, lik: Callable | None = None) -> DataFrame:
    """(query_id, key, smiles, score): the ``top`` best positive scores of each query's window (ties, to nine digits: lower key).

    asked: query_id, mass, level of the width (levels_of); own_parts: query_id and, as far as the score needs them, anchors (weight, fp,
    pop: an array, null without any) and p. Only asked is read more than once. pool: key, smiles, exact_mass, fp, popcount. alpha: see scores.fused; None: what anchors lend, as it is.
    lik(words of the candidates, probabilities of each query, cfg.prob_eps): the model score, plain() unless told.
    """
    on_anchors, on_model, model, floor, eps = alpha is None or alpha > 0, alpha is not None and alpha < 1, lik or plain, cfg.model_floor, cfg.prob_eps
    of = pool.select("key", "smiles", "exact_mass", "fp", "popcount").where(F.col("exact_mass").isNotNull())
    blocks = met(asked, own_parts.select("query_id", *(["anchors"] if on_anchors else []), *(["p"] if on_model else [])), of, widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from scored(widths[batch.column(0)[row].as_py() - 1], batch.column(1)[row].values, batch.column(2)[row].values)

    def scored(width: float, queries: pa.Array, found: pa.Array) -> Iterator[pa.RecordBatch]:
        found = found.take(pc.array_sort_indices(found.field(0), null_placement="at_start"))
        masses, lists = found.field(2).to_numpy(zero_copy_only=False), found.field(3)
        words = _words(lists, max(_longest(lists), _longest(queries.field("anchors").flatten().field("fp")) if on_anchors else 0))
        pops = np.nan_to_num(found.field(4).to_numpy(zero_copy_only=False).astype(float))
        centers = queries.field(1).to_numpy(zero_copy_only=False)
        band = [np.flatnonzero((masses >= c - width) & (masses <= c + width)) for c in centers]
        whole = model(words, [_values(queries.field("p"), k) for k in range(len(queries))], eps, band) if on_model else None
        ids, places, scores = [], [], []
        for k, at in enumerate(band):
            if not len(at):
                continue
            theirs = queries.field("anchors")[k].values if on_anchors and queries.field("anchors")[k].is_valid else None
            prop = _propagated(words[at], pops[at], theirs) if theirs is not None and len(theirs) else None
            if alpha is None:
                score = prop if prop is not None else np.zeros(len(at))
            else:
                score = fused(prop, whole[k, at] if on_model else None, alpha, floor, len(at))
            best = _best(score, top)
            ids.append(np.full(len(best), k)), places.append(at[best]), scores.append(score[best])
        if ids:
            of_query, place = pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))
            yield pa.record_batch([queries.field(0).take(of_query), found.field(0).take(place), found.field(1).take(place), pa.array(np.concatenate(scores))], ["query_id", "key", "smiles", "score"])

    kind = {f.name: f.dataType.simpleString() for f in [asked.schema["query_id"], of.schema["key"], of.schema["smiles"]]}
    return blocks.mapInArrow(run, f"query_id {kind['query_id']}, key {kind['key']}, smiles {kind['smiles']}, score double")


def best_until_scored(asked: DataFrame, own_parts: DataFrame, pool: DataFrame, widths: tuple[float, ...], top: int, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The same by what anchors lend, at the least width at which a candidate of the query scores; only best rows are kept of a turn."""
    found, open_ = None, durable(asked)
    for level in range(1, len(widths) + 1):
        hits = durable(best_of_windows(open_.withColumn("level", F.lit(level)), own_parts, pool, widths, top, None, cfg))
        found = hits if found is None else found.unionByName(hits)
        if level < len(widths):
            open_ = durable(open_.join(hits.select("query_id").distinct(), "query_id", "left_anti"))
            if open_.isEmpty():
                break
    return found

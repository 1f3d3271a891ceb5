"""Fingerprints of several families side by side: packing them into one row of words, and scoring family by family.

A layout names each family's range of bits in the whole (config.blocks_v1 and blocks_v2 are the two that are known).
Families are made by callables, as no chemistry library is assumed: each gives the bits that are set in its own range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scores as S
from .peaks import let

WORD = 32
#: A family's bits of each structure of a batch; None where it can't be parsed.
FamilyMaker = Callable[[list[str]], list[list[int] | None]]


def bits_of(layout: dict[str, tuple[int, int]]) -> int:
    return max(hi for _, hi in layout.values())


def stacked(structures: DataFrame, makers: dict[str, FamilyMaker], layout: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, fp, popcount) of the structures (key, smiles) that every family parses; a bit outside its family is an error."""
    words = -(-bits_of(layout) // WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            smiles = batch.column(1).to_pylist()
            made = {name: makers[name](smiles) for name in layout}
            keys, rows, counts = [], [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                parts = {name: made[name][i] for name in layout}
                if any(p is None for p in parts.values()):
                    continue
                whole = 0
                for name, own in parts.items():
                    lo, hi = layout[name]
                    for b in own:
                        if not 0 <= b < hi - lo:
                            raise ValueError(f"bit {b} is not in family {name} of {hi - lo} bits")
                        whole |= 1 << (lo + b)
                keys.append(key)
                rows.append([(whole >> (WORD * k)) & ((1 << WORD) - 1) for k in range(words)])
                counts.append(whole.bit_count())
            yield pa.record_batch([pa.array(keys, batch.column(0).type), pa.array(rows, pa.list_(pa.int64())), pa.array(counts, pa.int32())], ["key", "fp", "popcount"])

    return structures.select("key", "smiles").mapInArrow(run, f"key {dict(structures.dtypes)['key']}, fp array<long>, popcount int")


def on_bits(words: Column, lo: int, hi: int) -> Column:
    """Places of the set bits in [lo, hi), from 0 in the whole: word by word, so that empty words cost one test."""
    first, last = lo // WORD, (hi - 1) // WORD
    one = lambda w, k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftright", w, b).bitwiseAND(F.lit(1).cast("long")) != 0), lambda b: k * WORD + b)
    none = F.array().cast("array<int>")
    parts = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: let(F.get(words, k), lambda w: F.when(w == 0, none).otherwise(one(w, k))))
    found = F.flatten(parts)
    return found if lo % WORD == hi % WORD == 0 else F.filter(found, lambda i: (i >= lo) & (i < hi))


def block_counts(words: Column, layout: dict[str, tuple[int, int]]) -> dict[str, Column]:
    return {name: F.size(on_bits(words, lo, hi)) for name, (lo, hi) in layout.items()}


def block_logliks(words: Column, probs: Column, layout: dict[str, tuple[int, int]], eps: float = 1e-4) -> dict[str, Column]:
    """The log-likelihood of each family's set bits."""
    return {name: S.loglik(probs, on_bits(words, lo, hi), eps) for name, (lo, hi) in layout.items()}


def block_score(window: DataFrame, by: list[str], layout: dict[str, tuple[int, int]], weight: float, pooled: bool, families: list[str] | None = None) -> Column:
    """The score of rows with a column for each family: the first one's z and the others', pooled or each by itself."""
    first, *others = [n for n in layout]
    others = [n for n in others if families is None or n in families]
    columns = [F.col(n) for n in others]
    if weight <= 0 or not others:
        return F.col(first) if pooled else S.family_blocks(F.col(first), [], by, weight)
    return S.pooled_blocks(F.col(first), sum(columns[1:], columns[0]), by, weight) if pooled else S.family_blocks(F.col(first), columns, by, weight)


def block_scorer(layout: dict[str, tuple[int, int]], weight: float, pooled: bool, families: list[str] | None = None):
    """A model score for predict.scored_windows: (window, probs, cfg) -> window with lik, family by family."""

    def scorer(window: DataFrame, probs: DataFrame, cfg) -> DataFrame:
        own = window.join(probs, "query_id", "left")
        sums = {f"__{n}": F.coalesce(c, F.lit(0.0)) for n, c in block_logliks(F.col("fp"), F.col("p"), layout, cfg.prob_eps).items()}
        named = {f"__{n}": r for n, r in layout.items()}
        kept = own.withColumns(sums).drop("p")
        score = block_score(kept, ["query_id"], named, weight, pooled, None if families is None else [f"__{n}" for n in families])
        return kept.withColumn("lik", score).drop(*sums)

    def on_block(words: np.ndarray, probs: list, eps: float, windows: list[np.ndarray]) -> np.ndarray:
        """The same for queries (rows of probs: values and which are missing) and candidates, of whose words only a query's window counts."""
        wide, missing = max(bits_of(layout), 1), float(np.log(eps) - np.log1p(-eps))
        weights = np.full((len(probs), wide), missing)
        for k, x in enumerate(probs):
            if x is not None:
                n = min(wide, len(x[0]))
                weights[k, :n] = S.logits(x[0][:n], x[1][:n], eps)
        sums = {n: S.sums_of_bits(words, weights[:, :hi], lo) for n, (lo, hi) in layout.items()}
        first, *others = [sums[n] for n in layout if n == next(iter(layout)) or families is None or n in families]
        out = np.zeros((len(probs), len(words)))
        for k, at in enumerate(windows):
            z = lambda x, at=at, k=k: _z(x[k, at])
            if not len(at):
                continue
            if weight <= 0 or not others:
                out[k, at] = first[k, at] if pooled else z(first)
            elif pooled:
                out[k, at] = z(first) + weight * z(sum(others[1:], others[0]))
            else:
                out[k, at] = sum((weight / len(others) * z(x) for x in others), z(first))
        return out

    scorer.on_block = on_block
    return scorer


def _z(x: np.ndarray) -> np.ndarray:
    """S.z_score of one window."""
    return (x - x.mean()) / x.std() if x.max() > x.min() else np.zeros(len(x))

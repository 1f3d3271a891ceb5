"""Scores of candidates: log-likelihoods of fingerprints and their normalisation within a window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Bits of a word of a fingerprint.
WORD = 32


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-4, weight: Column | float = 1.0, bias: Column | float = 0.0) -> Column:
    """weight * logit(p) + bias, p being clipped to [eps, 1 - eps]."""
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return (F.ln(clipped) - F.log1p(-clipped)) * weight + bias


def loglik(probs: Column, bits: Column, eps: float = 1e-4) -> Column:
    """The Bernoulli log-likelihood of the set bits, but for a constant of the window: the sum of their logits."""
    return F.aggregate(bits, F.lit(0.0), lambda a, i: a + logit(F.get(probs, i.cast("int")), eps))


def min_max(x: Column, by: list[str], constant: Column | float) -> Column:
    """x from 0 to 1 within by; constant where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(constant)


def z_score(x: Column, by: list[str]) -> Column:
    """x less its mean over its population deviation within by; 0 where that is 0."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 0, (x - F.avg(x).over(w)) / sd).otherwise(0.0)


def fused(prop: Column, lik: Column, by: list[str], alpha: float = 0.3, floor: float = 0.05) -> Column:
    """alpha of propagation and the rest of the model, each from 0 to 1 within by; a null prop counts nothing.

    A side that alpha switches off is not part of the plan.
    """
    terms = []
    if alpha > 0:
        constant = F.when(F.max(prop).over(Window.partitionBy(*by)) > 0, 1.0).otherwise(0.0)
        terms.append(alpha * F.coalesce(min_max(prop, by, constant), F.lit(0.0)))
    if alpha < 1:
        terms.append((1 - alpha) * (floor + (1 - floor) * min_max(lik, by, 1.0)))
    return sum(terms[1:], terms[0])


def pooled_blocks(first: Column, rest: Column, by: list[str], weight: float) -> Column:
    """z of the first family and weight times z of all others together; the raw first one at weight 0."""
    return z_score(first, by) + weight * z_score(rest, by) if weight > 0 else first


def family_blocks(first: Column, families: list[Column], by: list[str], weight: float) -> Column:
    """z of the first family and the weight spread over z of each other one."""
    out = z_score(first, by)
    for f in families if weight > 0 else []:
        out = out + weight / len(families) * z_score(f, by)
    return out


def extreme_adjusted(top: Column, mean: Column, sd: Column, n: Column) -> Column:
    """How far a maximum stands out of n draws: its z-score less sqrt(2 ln n); minus infinity without any."""
    return F.when(n == 0, F.lit(float("-inf"))).when((n < 3) | (sd == 0) | sd.isNull(), 0.0).otherwise((top - mean) / sd - F.sqrt(2 * F.ln(n)))


# --- the same on arrays of numpy, in which sums are made in the same order ------------------------------------


def _bits(words: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of the first n bits: which, and the rows (0 or 1) that have it."""
    for i in range(min(n, words.shape[1] * WORD)):
        yield i, (words[:, i // WORD] >> np.uint64(i % WORD) & np.uint64(1)).astype(float)


def logits(p: np.ndarray, missing: np.ndarray, eps: float) -> np.ndarray:
    """As logit: a missing value counts as the least, one that is no number as the greatest."""
    p = np.clip(np.where(missing, eps, np.where(np.isnan(p), 1 - eps, p)), eps, 1 - eps)
    return np.log(p) - np.log1p(-p)


def sums_of_bits(words: np.ndarray, weights: np.ndarray, lo: int = 0) -> np.ndarray:
    """Of each query (row of weights) and candidate: the weights of the bits from lo that it has, added in the order of bits."""
    out = np.zeros((len(weights), len(words)))
    for i, has in _bits(words, weights.shape[1]):
        if i >= lo:
            out += weights[:, i][:, None] * has
    return out

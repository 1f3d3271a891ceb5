"""Column functions on peak lists: arrays of struct<mz: double, intensity: double>, ascending by mz."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT

PEAK = "struct<mz:double,intensity:double>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))


def field(peaks: Column, name: str) -> Column:
    return F.transform(peaks, lambda p: p[name])


def make_peaks(mzs: Column, intensities: Column) -> Column:
    """A peak list from two parallel arrays, ascending by mz."""
    return F.array_sort(F.zip_with(mzs, intensities, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("intensity"))))


def entropy(values: Column) -> Column:
    """Shannon entropy (nats) of positive values as shares of their sum; null without a positive sum."""
    return let(values, lambda v: let(total(v), lambda t: F.when(t > 0, F.aggregate(F.filter(v, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x / t * F.ln(x / t)))))


def entropy_weight(values: Column) -> Column:
    """Values damped by their entropy S: v ** (0.25 + 0.25 S) where S is below 3 and the sum is positive."""
    return let(values, lambda v: let(entropy(v), lambda s: F.when(s.isNull() | (s >= 3), v).otherwise(F.transform(v, lambda x: F.pow(x, 0.25 + 0.25 * s)))))


def reweighted(peaks: Column) -> Column:
    """A peak list with entropy-weighted intensities, negative ones counting as 0."""
    return let(peaks, lambda p: F.zip_with(p, entropy_weight(F.transform(p, lambda x: F.greatest(x["intensity"], F.lit(0.0)))), lambda x, w: F.struct(x["mz"].alias("mz"), w.alias("intensity"))))


def top_peaks(peaks: Column, k: int) -> Column:
    """The k most intense peaks (ties: lower mz first), ascending by mz; unchanged if there are no more."""
    strongest = lambda p: F.array_sort(F.transform(p, lambda x: F.struct((-x["intensity"]).alias("a"), x["mz"].alias("b"))))
    return let(peaks, lambda p: F.when(F.size(p) <= k, p).otherwise(F.array_sort(F.transform(F.slice(strongest(p), 1, k), lambda x: F.struct(x["b"].alias("mz"), (-x["a"]).alias("intensity"))))))


def merge_anchored(peaks: Column, tol: float, scaled: bool = True) -> Column:
    """Consensus peaks: runs within tol of their first peak; weighted mean mz, summed intensity (scaled: over the greatest).

    The state of the fold holds the open run's first mz and sums, and the closed runs.
    """
    closed = lambda a: F.struct(F.when(a["w"] > 0, a["mw"] / a["w"]).otherwise(a["m"] / a["n"]).alias("mz"), a["w"].alias("intensity"))
    state = lambda done, first, mw, w, m, n: F.struct(done.alias("done"), first.alias("first"), mw.alias("mw"), w.alias("w"), m.alias("m"), n.alias("n"))
    start = state(F.array().cast(f"array<{PEAK}>"), F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))

    def step(a: Column, p: Column) -> Column:
        mz, own = p["mz"], p["intensity"]
        joins = mz - a["first"] <= tol
        return F.when(joins, state(a["done"], a["first"], a["mw"] + mz * own, a["w"] + own, a["m"] + mz, a["n"] + 1)).otherwise(
            state(F.when(a["first"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(closed(a)))), mz, mz * own, own, mz, F.lit(1.0))
        )

    runs = F.aggregate(F.array_sort(peaks), start, step, lambda a: F.when(a["first"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(closed(a)))))
    if not scaled:
        return runs
    return let(runs, lambda r: let(F.array_max(field(r, "intensity")), lambda top: F.when(top > 0, F.transform(r, lambda x: F.struct(x["mz"].alias("mz"), (x["intensity"] / top).alias("intensity")))).otherwise(r)))


def bin_of(mz: Column, width: float, bins: int) -> Column:
    return F.least(F.greatest((mz / width).cast("int"), F.lit(0)), F.lit(bins - 1))


def pairs(a: Column, b: Column, tol: float, shift: Column) -> Column:
    """(i, j, product) of peaks that match directly, or shifted by more than tol; best products first."""
    def of(x: Column, i: Column) -> Column:
        lo, hi = x["mz"] - tol, x["mz"] + tol
        near = lambda m: ((m >= lo) & (m <= hi)) | (F.abs(shift) > tol) & (m + shift >= lo) & (m + shift <= hi)
        product = lambda y, j: F.struct((-(x["intensity"] * y["intensity"])).alias("p"), i.alias("i"), j.alias("j"), y["mz"].alias("m"))
        found = F.filter(F.transform(b, product), lambda y: near(y["m"]))
        return F.transform(found, lambda y: F.struct(y["p"].alias("p"), y["i"].alias("i"), y["j"].alias("j")))

    none = F.array().cast("array<struct<p:double,i:int,j:int>>")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_sort(F.flatten(F.transform(a, of)))).otherwise(none)


def modified_cosine(a: Column, b: Column, shift: Column, tol: float = 0.02, weighted: bool = False) -> Column:
    """Greedy one-to-one matches by product (ties: lower i, then j) over the norms of all peaks.

    shift is what is added to b's mz for the second way to match; 0 leaves the plain cosine. weighted: the
    intensities are entropy-weighted already, as where a spectrum takes part in many pairs.
    """

    def greedy(found: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("j"))
        take = lambda acc, p: F.struct((acc["s"] - p["p"]).alias("s"), F.concat(acc["i"], F.array(p["i"])).alias("i"), F.concat(acc["j"], F.array(p["j"])).alias("j"))
        return F.aggregate(found, start, lambda acc, p: F.when(F.array_contains(acc["i"], p["i"]) | F.array_contains(acc["j"], p["j"]), acc).otherwise(take(acc, p)), lambda acc: acc["s"])

    def body(s: Column) -> Column:
        scale = norm(field(s["a"], "intensity")) * norm(field(s["b"], "intensity"))
        return let(scale, lambda n: F.when(n > 0, greedy(pairs(s["a"], s["b"], tol, s["shift"])) / n).otherwise(0.0))

    own = (lambda p: p) if weighted else reweighted
    return let(F.struct(own(a).alias("a"), own(b).alias("b"), shift.alias("shift")), body)


def cosine(a: Column, b: Column, tol: float = 0.02) -> Column:
    return modified_cosine(a, b, F.lit(0.0), tol)


def mode_id(mode: Column) -> Column:
    """1 positive, 2 negative, 0 anything else."""
    clean = F.lower(F.trim(mode))
    return F.when(clean == "positive", 1).when(clean == "negative", 2).otherwise(0)


def featurize(peaks: Column, precursor: Column, mode: Column, width: float = DEFAULT.feature_bin, max_mz: float = DEFAULT.feature_max_mz) -> Column:
    """(col, val) entries: fragment bins, then neutral-loss bins, then three of the precursor and mode."""
    bins = int(max_mz / width) + 1
    entry = lambda col, val: F.struct(col.cast("int").alias("col"), val.cast("double").alias("val"))
    meta = 2 * bins
    share = F.least(precursor / max_mz, F.lit(1.0))
    empty = F.array(entry(F.lit(meta), share))

    def body(p: Column) -> Column:
        scale = norm(field(p, "intensity"))
        fragments = F.transform(p, lambda x: entry(bin_of(x["mz"], width, bins), x["intensity"] / scale))
        losses = F.transform(F.filter(p, lambda x: precursor - x["mz"] > 0), lambda x: entry(bins + bin_of(precursor - x["mz"], width, bins), x["intensity"] / scale))
        extra = F.array(entry(F.lit(meta), share), entry(F.lit(meta + 1), (mode_id(mode) == 1).cast("double")), entry(F.lit(meta + 2), (mode_id(mode) == 2).cast("double")))
        return F.when((F.size(p) == 0) | (total(field(p, "intensity")) <= 0), empty).otherwise(F.concat(fragments, losses, extra))

    return let(reweighted(peaks), body)


def tensor(peaks: Column, k: int = DEFAULT.tensor_peaks) -> Column:
    """struct(mz, intensity, mask), each of k places: weighted on all peaks, then cut to the k strongest."""
    by_weight = lambda p: F.array_sort(F.transform(p, lambda x: F.struct((-x["intensity"]).alias("a"), x["mz"].alias("mz"))))
    pad = lambda a, zero: F.slice(F.concat(a, F.array_repeat(zero, k)), 1, k)

    def body(p: Column) -> Column:
        own = F.transform(p, lambda x: -x["a"])
        scale = norm(own)
        scaled = F.transform(own, lambda v: F.when(scale > 0, v / scale).otherwise(v))
        return F.struct(pad(F.transform(p, lambda x: x["mz"]), F.lit(0.0)).alias("mz"), pad(scaled, F.lit(0.0)).alias("intensity"), pad(F.transform(p, lambda _: F.lit(True)), F.lit(False)).alias("mask"))

    return let(F.slice(by_weight(reweighted(peaks)), 1, k), body)


def mass_embedding(x: Column, dims: int, shortest: float = 0.01, longest: float = 1000.0) -> Column:
    """Sines, then cosines, of x at dims / 2 wavelengths that are evenly spaced on a logarithmic scale."""
    half = dims // 2
    rates = [2 * math.pi / (shortest * (longest / shortest) ** (i / max(half - 1, 1))) for i in range(half)]
    return F.concat(*(F.array(*(f(x * r) for r in rates)) for f in (F.sin, F.cos)))

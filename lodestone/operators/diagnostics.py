"""Diagnostics of rankings: what a better ranker, gate or fingerprint could gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .joins import durable
from .nearest import weighted_best
from .ranking import counts_above
from .sweeps import with_grid


def competition_ranks(scored: DataFrame, by: list[str], rankers: dict[str, str], truth: str = "truth") -> DataFrame:
    """(by, ranker, rank, n): 1 + rows of the group with a greater score than the truth's, for each ranker.

    All rankers are held against the same competitors. Groups without a truth, or with one row, are left out.
    """
    group = Window.partitionBy(*by)
    own = {name: F.max(F.when(F.col(truth), F.col(c))).over(group) for name, c in rankers.items()}
    marked = scored.withColumns({f"__{name}": v for name, v in own.items()})
    counts = [(1 + F.count_if(F.col(c) > F.col(f"__{name}"))).alias(name) for name, c in rankers.items()]
    ranks = marked.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.col(truth).cast("int")).alias("has"), *counts).where("has = 1 and n > 1")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("ranker"), F.col(name).alias("rank")) for name in rankers))).alias("r")
    return ranks.select(*by, "n", each).select(*by, "r.ranker", "r.rank", "n")


#: Bits of a digit of exact_medians: so many values of a group meet in one task at most.
DIGIT = 16


def exact_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median) of whole numbers from 0 to 2^32 - 1: the mean of the two middle ones; nulls are left out.

    By selection: rows are counted by their upper digit, which tells the digits of the two middle places, then those
    rows by their lower one. A group of any size is counts of at most 2^DIGIT digits, made in the tasks that read it,
    where the median of an aggregate keeps all distinct values of a group in one buffer.
    """
    low = (1 << DIGIT) - 1
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("__v"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]

    def placed(counts: DataFrame, groups: list[str], digit: str) -> DataFrame:
        w = Window.partitionBy(*groups).orderBy(digit)
        return counts.withColumn("__upto", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__before", F.col("__upto") - F.col("__c"))

    upper = placed(own.groupBy(*by, F.shiftright("__v", DIGIT).alias("__hi")).agg(F.count("*").alias("__c")), by, "__hi")
    sized = upper.withColumn("__n", F.sum("__c").over(Window.partitionBy(*by)))
    wanted = sized.select(*by, "__hi", "__before", "__upto", F.posexplode(F.array(F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1)).alias("__side", "__k"))
    wanted = wanted.where((F.col("__before") < F.col("__k")) & (F.col("__k") <= F.col("__upto"))).withColumn("__k", F.col("__k") - F.col("__before")).drop("__before", "__upto")
    condition = F.shiftright("o.__v", DIGIT) == F.col("w.__hi")
    for c in same("o", "w"):
        condition = condition & c
    near = own.alias("o").join(wanted.alias("w"), condition).select(*(F.col(f"w.{c}") for c in by), "__side", "__hi", "__k", F.col("__v").bitwiseAND(F.lit(low)).alias("__lo"))
    groups = [*by, "__side", "__hi", "__k"]
    lower = placed(near.groupBy(*groups, "__lo").agg(F.count("*").alias("__c")), groups, "__lo")
    found = lower.where((F.col("__before") < F.col("__k")) & (F.col("__k") <= F.col("__upto")))
    return found.groupBy(*by).agg(F.avg(F.shiftleft("__hi", DIGIT) + F.col("__lo")).alias("median"))


def rank_summary(ranks: DataFrame, by: list[str], k: int = 25) -> DataFrame:
    """MRR@k, top-1 rate, median rank and number, for each of by."""
    rr = F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)
    means = ranks.groupBy(*by).agg(F.avg(rr).alias("mrr"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.count("*").alias("n"))
    middle = exact_medians(ranks, by, "rank").withColumnsRenamed({c: f"__{c}" for c in by})
    condition = F.lit(True)
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return means.join(middle, condition).select(*by, "mrr", "top1", "median", "n")


def nearest_others(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """rows (by, key, fp, popcount) with nearest, the greatest Tanimoto to a row of another key in the group; groups of one key are left out."""
    others = rows.select(*by, F.col("fp").alias("a_fp"), F.col("popcount").alias("a_pop"), F.lit(1.0).alias("weight"), F.col(key).alias("a_key"))
    lone = rows.groupBy(*by).agg(F.min(key).alias("__a"), F.max(key).alias("__b")).where("__a = __b").select(*by)
    return weighted_best(rows.join(lone, by, "left_anti"), others, by, "nearest", apart=(key, "a_key")).drop("has_anchors")


def several_sources(rows: DataFrame, key: list[str], source: str) -> DataFrame:
    """Rows of keys that more than one source has."""
    keys = rows.groupBy(*key).agg(F.count_distinct(source).alias("sources")).where("sources >= 2").select(*key)
    return rows.join(keys, key, "left_semi")


def adjusted(window: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, adjusted, n): how far the best of each window stands out, net of the window's size."""
    s = F.col(score)
    stats = window.groupBy(*by).agg(F.max(s).alias("top"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"), F.count(s).alias("n"))
    return stats.select(*by, S.extreme_adjusted(F.col("top"), F.col("mean"), F.col("sd"), F.col("n")).alias("adjusted"), "n")


def gate(first: DataFrame, second: DataFrame, answers: DataFrame, by: str = "molecule_id") -> DataFrame:
    """How often the larger adjusted score names the pool that holds the answer, beside always guessing the larger class.

    first, second: by, adjusted; answers: by, in_first. A molecule without a window in a pool has minus infinity there.
    """
    low = F.lit(float("-inf"))
    met = answers.join(first.select(by, F.col("adjusted").alias("a")), by, "left").join(second.select(by, F.col("adjusted").alias("b")), by, "left")
    picked = met.withColumn("pick", F.coalesce("a", low) > F.coalesce("b", low))
    share = F.avg(F.col("in_first").cast("double"))
    right = F.avg((F.col("pick") == F.col("in_first")).cast("double"))
    return picked.agg(
        F.count("*").alias("n"), F.greatest(share, 1 - share).alias("base"), right.alias("accuracy"),
        F.count_if(F.col("pick") & F.col("in_first")).alias("kept"), F.count_if(~F.col("pick") & ~F.col("in_first")).alias("passed_on"),
    )


def headroom(window: DataFrame, probs: DataFrame, truth: DataFrame, lambdas: list[float], by: str = "query_id", k: int = 25, eps: float = 1e-4) -> DataFrame:
    """For each lam: ranks and Tanimoto of a prediction that is moved that far from the model to the truth.

    window: by, key, fp; probs: by, p; truth: by, fp. Windows that lack the truth's fingerprint are left out.
    """
    bit = lambda words, i: F.call_function("shiftright", F.get(words, F.floor(i / 32).cast("int")), (i % 32).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    places = F.sequence(F.lit(0), F.size("p") - 1)
    known = probs.join(truth.select(by, F.col("fp").alias("true_fp")), by)
    moved = with_grid(known, [(float(x),) for x in lambdas], "lam double")
    mixed = moved.withColumn("p", F.transform(F.arrays_zip(F.col("p").alias("v"), places.alias("i")), lambda x: (1 - F.col("lam")) * x["v"] + F.col("lam") * bit("true_fp", x["i"])))
    on = F.transform("p", lambda x: (x >= 0.5).cast("int"))
    true_on = F.transform(places, lambda i: bit("true_fp", i).cast("int"))
    both = F.aggregate(F.zip_with(on, true_on, lambda x, y: x * y), F.lit(0), lambda a, x: a + x)
    either = F.aggregate(F.zip_with(on, true_on, lambda x, y: F.greatest(x, y)), F.lit(0), lambda a, x: a + x)
    told = mixed.select(by, "lam", "true_fp", F.when(either > 0, both / either).otherwise(0.0).alias("tanimoto"), F.transform("p", lambda x: S.logit(x, eps)).alias("logits"))
    score = F.aggregate(F.filter(F.sequence(F.lit(0), F.size("logits") - 1), lambda i: bit("fp", i) != 0), F.lit(0.0), lambda a, i: a + F.get("logits", i))
    scored = window.join(told, by).withColumn("score", F.round(score, 9)).withColumn("truth", F.col("fp") == F.col("true_fp"))
    own = F.max(F.when(F.col("truth"), F.col("score"))).over(Window.partitionBy(by, "lam"))
    ranks = scored.withColumn("own", own).where("own is not null").groupBy(by, "lam").agg((1 + F.count_if(F.col("score") > F.col("own"))).alias("rank"), F.first("tanimoto").alias("tanimoto"))
    rr: Column = F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)
    return ranks.groupBy("lam").agg(F.avg("tanimoto").alias("tanimoto"), F.avg(rr).alias("mrr"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.count("*").alias("n"))


def reranked(window: DataFrame, probs: DataFrame, truth: DataFrame, weights: list[tuple[float, float]], by: str = "query_id", eps: float = 1e-4) -> DataFrame:
    """truth (but for fp) with n, base and reranked: its rank in the whole window by the model's logits, and by logits weighted bit by bit.

    window: by, key, fp; probs: by, p; truth: by, fp, anything else that comes along, any number of rows for a window;
    weights: weight and bias of each bit, as a fit gives them. A truth that its window lacks has null ranks; windows
    without probabilities are left out. Scores that agree to nine digits are ties, which count for the truth. A score
    depends on the window and the fingerprint alone: each is made once, and ranks are read off counts of scores.
    """
    w, b = (F.array(*(F.lit(float(x[k])) for x in weights)) for k in (0, 1))
    logits = probs.select(by, F.transform("p", lambda x: S.logit(x, eps)).alias("base"))
    values = logits.withColumn("moved", F.transform("base", lambda l, i: l * F.get(w, i) + F.get(b, i)))
    bit = lambda i: F.call_function("shiftright", F.get("fp", F.floor(i / 32).cast("int")), (i % 32).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    places = F.filter(F.sequence(F.lit(0), F.size("base") - 1), lambda i: bit(i) != 0)
    score = lambda c: F.round(F.aggregate("on", F.lit(0.0), lambda a, i: a + F.get(c, i)), 9)
    distinct = window.groupBy(by, "fp").agg(F.count("*").alias("rows"))
    scored = durable(distinct.join(values, by).withColumn("on", places).select(by, "fp", "rows", score("base").alias("own_base"), score("moved").alias("own_moved")))
    found = truth.join(scored.groupBy(by).agg(F.sum("rows").alias("n")), by).join(scored.drop("rows"), [by, "fp"], "left").drop("fp")
    for own, name in (("own_base", "base"), ("own_moved", "reranked")):
        above = counts_above(scored, [by], own, "rows").select(by, own, (1 + F.col("above")).alias(name))
        found = found.join(above, [by, own], "left")
    return found.drop("own_base", "own_moved")


def reranking_summary(ranks: DataFrame, by: str, k: int = 25) -> DataFrame:
    """(by, n, present, and of either ranking the MRR@k over all, the median rank and the number in the first k of those present)."""
    rr = lambda c: F.avg(F.when(F.col(c) <= k, 1 / F.col(c)).otherwise(0.0))
    ranks = durable(ranks)  # read by each of the medians' passes
    sums = ranks.groupBy(by).agg(F.count("*").alias("n"), F.count("base").alias("present"), *(x for c in ("base", "reranked") for x in (rr(c).alias(f"mrr_{c}"), F.count_if(F.col(c) <= k).alias(f"top_{c}"))))
    for c in ("base", "reranked"):
        sums = sums.join(exact_medians(ranks, [by], c).withColumnRenamed("median", f"median_{c}"), by, "left")
    return sums


def keep_rates(populations: DataFrame, filters: dict[str, Column], by: str = "population") -> DataFrame:
    """(by, filter, n, kept): what share of each population a filter keeps; a filter that is null for a row doesn't keep it.

    A filter is worth its place if it keeps what is looked for and drops what only stands beside it in a window.
    """
    kept = [F.avg(F.coalesce(f.cast("int"), F.lit(0))).alias(name) for name, f in filters.items()]
    rates = populations.groupBy(by).agg(F.count("*").alias("n"), *kept)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("filter"), F.col(name).alias("kept")) for name in filters))).alias("e")
    return rates.select(by, "n", each).select(by, "e.filter", "n", "e.kept")


def around_median(rows: DataFrame, mass: str, width: float, steps: int = 1000) -> DataFrame:
    """Rows within width of the median mass: a population as the windows of a pool see it. Masses are told to 1 / steps."""
    at = exact_medians(rows.withColumn("__v", F.round(F.col(mass) * steps).cast("long")), [], "__v")
    one = F.broadcast(at.select((F.col("median") / steps).alias("__at")))  # one row
    return rows.join(one, (F.col(mass) >= F.col("__at") - width) & (F.col(mass) <= F.col("__at") + width)).drop("__at")


def decoy_lists(candidates: DataFrame, decoys: int = 8, cell: int = 64) -> DataFrame:
    """(key, label, bits, decoys): for each row, the bits of up to ``decoys`` other rows of its label.

    Rows of a label are dealt by the hash of their key into cells of about ``cell`` rows, however many the label has, and
    a row's decoys are those behind it in its cell, the first ones following on the last. A row alone in its cell has none; null
    labels are a label. candidates: key, label, bits; keys are unique.
    """
    sizes = candidates.groupBy("label").agg(F.count("*").alias("of_label"))
    known = candidates.alias("c").join(sizes.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label"))).select("c.key", "c.label", "c.bits", "of_label")
    cells = known.withColumn("cell", F.pmod(F.xxhash64("key"), F.ceil(F.col("of_label") / cell)))
    place = Window.partitionBy("label", "cell").orderBy(F.xxhash64("key", F.lit(7)), "key")
    behind = F.collect_list("bits").over(place.rowsBetween(1, decoys))
    first = F.collect_list("bits").over(place.rowsBetween(Window.unboundedPreceding, -1))
    both = F.concat(behind, F.slice(first, 1, decoys))
    return cells.select("key", "label", "bits", F.slice(both, 1, decoys).alias("decoys"))

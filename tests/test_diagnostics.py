"""Medians by selection, keep rates and full-window ranks against plain versions."""

import random
import statistics

import pytest

from lodestone.operators import diagnostics as G


def test_exact_medians(spark):
    rng = random.Random(1)
    groups = {("a", 1): [rng.randrange(2**32) for _ in range(501)], ("b", 1): [rng.randrange(5) for _ in range(400)], (None, 2): [7], ("c", None): [1, 2**32 - 1], ("d", 0): [65535, 65536, 3, 65536]}
    rows = [(g, h, v) for (g, h), vs in groups.items() for v in vs] + [("a", 1, None), ("e", 1, None)]
    table = spark.createDataFrame(rows, "g string, h int, v long").repartition(7)
    got = {(r.g, r.h): r.median for r in G.exact_medians(table, ["g", "h"], "v").collect()}
    assert got == {k: float(statistics.median(v)) for k, v in groups.items()}
    assert G.exact_medians(table.where("v < 0"), ["g"], "v").collect() == []
    assert G.exact_medians(table, [], "v").first().median == statistics.median([v for vs in groups.values() for v in vs])


def test_reranked(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(32) for _ in range(40)]
    probs = [rng.random() for _ in range(32)]
    weights = [(rng.uniform(0, 2), rng.uniform(-1, 1)) for _ in range(32)]
    window = spark.createDataFrame([(q, k, [f]) for q in (1, 2) for k, f in enumerate(fps)], "query_id int, key int, fp array<bigint>")
    truth = spark.createDataFrame([(1, [fps[3]], "x"), (2, [12345], "y"), (3, [1], "z")], "query_id int, fp array<bigint>, kind string")
    got = {r.query_id: r for r in G.reranked(window, spark.createDataFrame([(1, probs), (2, probs)], "query_id int, p array<double>"), truth, weights).collect()}
    import math

    logit = [math.log(p) - math.log(1 - p) for p in (min(max(p, 1e-4), 1 - 1e-4) for p in probs)]
    base = [sum(l for i, l in enumerate(logit) if f >> i & 1) for f in fps]
    moved = [sum(l * w + b for i, (l, (w, b)) in enumerate(zip(logit, weights, strict=True)) if f >> i & 1) for f in fps]
    assert set(got) == {1, 2} and got[1].kind == "x" and got[1].n == 40
    assert (got[1].base, got[1].reranked) == (1 + sum(s > base[3] for s in base), 1 + sum(s > moved[3] for s in moved))
    assert got[2].base is None and got[2].reranked is None
    both = {r.kind: r for r in G.reranking_summary(spark.createDataFrame(list(got.values())), "kind").collect()}
    assert both["y"].present == 0 and both["y"].mrr_base == 0 and both["y"].median_base is None and both["x"].median_base == got[1].base


def test_keep_rates(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", 1), ("a", None), ("b", 5)], "population string, x int")
    got = {(r.population, r["filter"]): (r.n, r.kept) for r in G.keep_rates(rows, {"low": F.col("x") < 3, "all": F.lit(True)}).collect()}
    assert got == {("a", "low"): (2, 0.5), ("a", "all"): (2, 1.0), ("b", "low"): (1, 0.0), ("b", "all"): (1, 1.0)}
    masses = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 50, 99)], "m double")
    assert sorted(r.m for r in G.around_median(masses, "m", 1.0).collect()) == [2.0, 3.0] and G.around_median(masses.where("m < 0"), "m", 1.0).count() == 0
    assert pytest.approx(0.5) == got["a", "low"][1]


def test_truths_of_one_window_share_its_scores(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(8) for _ in range(300)]
    probs = [rng.random() for _ in range(32)]
    window = spark.createDataFrame([(g, k, [f]) for g in (1, 2) for k, f in enumerate(fps[: 300 // g])], "g int, key int, fp array<bigint>")
    truth = spark.createDataFrame([(g, k, [fps[k]]) for g in (1, 2) for k in range(0, 300 // g, 10)], "g int, query_id int, fp array<bigint>")
    ranks = G.reranked(window, spark.createDataFrame([(1, probs), (2, probs)], "g int, p array<double>"), truth, [(1.0, 0.0)] * 32, "g")
    import math

    logit = [math.log(p) - math.log(1 - p) for p in (min(max(p, 1e-4), 1 - 1e-4) for p in probs)]
    base = [round(sum(l for i, l in enumerate(logit) if f >> i & 1), 9) for f in fps]
    want = {(g, k): (300 // g, 1 + sum(s > base[k] for s in base[: 300 // g])) for g in (1, 2) for k in range(0, 300 // g, 10)}
    assert {(r.g, r.query_id): (r.n, r.base) for r in ranks.collect()} == want and all(r.base == r.reranked for r in ranks.collect())


def test_counts_above_over_ranges(spark):
    from lodestone.operators.ranking import counts_above

    rng = random.Random(6)
    rows = [(g, rng.randrange(40) / 4, rng.randrange(1, 4)) for g in (1, 1, 1, 2) for _ in range(100)]
    got = {(r.g, r.v): r.above for r in counts_above(spark.createDataFrame(rows, "g int, v double, c long"), ["g"], "v", "c", 7).collect()}
    assert got == {(g, v): sum(c for h, u, c in rows if h == g and u > v) for g, v, _ in rows}

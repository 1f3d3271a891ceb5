"""The bounded Tanimoto join against all pairs, and how many pairs it compares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import nearest as N

IN_TILES = N._in_tiles


def tables(spark, rng, groups, rows, anchors, words=2):
    word = lambda: rng.getrandbits(32) & rng.getrandbits(32) if rng.random() < 0.5 else rng.getrandbits(32)
    fp = lambda: [word() for _ in range(words)]
    pop = lambda f: sum(x.bit_count() for x in f)
    own = [(g, k, f, pop(f), "x") for g in range(groups) for k, f in enumerate(fp() for _ in range(rows))]
    of = [(g, f, pop(f), rng.choice([0.1, 0.4, 0.4, 0.8, 1.0]) * rng.random()) for g in range(groups) for f in (fp() for _ in range(anchors))]
    return own, of


def plainly(fp, g, of):
    best = 0.0
    for h, f, _, w in of:
        if g == h and w is not None and w > 0:
            both, either = sum((a & b).bit_count() for a, b in zip(fp, f, strict=True)), sum((a | b).bit_count() for a, b in zip(fp, f, strict=True))
            best = max(best, w * both / either if either else 0.0)
    return best


SCHEMAS = "g int, k int, fp array<bigint>, popcount int, `no.te` string", "g int, a_fp array<bigint>, a_pop int, weight double"


@pytest.mark.parametrize(("most", "groups", "rows", "anchors"), [((1024, 512), 5, 30, 8), ((16, 8), 2, 150, 90), ((4, 300), 2, 40, 20), ((500, 5), 1, 60, 200)])
def test_against_all_pairs(spark, monkeypatch, most, groups, rows, anchors):
    monkeypatch.setattr(N, "ROWS", most[0])
    monkeypatch.setattr(N, "ANCHORS", most[1])
    own, of = tables(spark, random.Random(rows), groups, rows, anchors)
    got = N.weighted_best(spark.createDataFrame([*own, (99, 0, [1, 2], 2, "y"), (None, 1, [1, 2], 2, "z")], SCHEMAS[0]), spark.createDataFrame([*of, (None, [1, 2], 2, 1.0)], SCHEMAS[1]), ["g"], "prop", "pairs")
    assert got.columns == ["g", "k", "fp", "popcount", "no.te", "prop", "has_anchors", "pairs"]
    found = got.collect()
    assert len(found) == len(own) + 2 and {(r.g, r.k) for r in found if not r.has_anchors} == {(99, 0), (None, 1)}
    for r in found:
        assert r.prop == pytest.approx(plainly(r.fp, r.g, of), abs=1e-12)
    assert 0 < sum(r.pairs for r in found) <= groups * rows * anchors + 1e-6


def test_odd_rows(spark):
    own = spark.createDataFrame([(1, 1, None, None, None), (1, 2, [], 0, None), (1, 3, [0, 0], 0, None), (1, 4, [7, 0], 3, None), (1, 4, [7, 0], 3, None)], SCHEMAS[0])
    of = spark.createDataFrame([(1, [7], 3, 0.5), (1, None, 3, 9.0), (1, [7, 7], 6, None), (1, [0, 0], 0, 1.0), (1, [7, 0], 3, -1.0)], SCHEMAS[1])
    got = sorted((r.k, r.best, r.has_anchors) for r in N.weighted_best(own, of, ["g"]).collect())
    assert got == [(1, 0.0, True), (2, 0.0, True), (3, 0.0, True), (4, 0.5, True), (4, 0.5, True)]
    assert N.weighted_best(own.where("k > 9"), of, ["g"]).collect() == []
    assert {(r.best, r.has_anchors) for r in N.weighted_best(own, of.where("g > 9"), ["g"]).collect()} == {(0.0, False)}


def test_pairs_grow_less_than_the_product(spark):
    """Anchors whose weights differ as similarities do: most are ruled out by the first ones."""
    rng = random.Random(5)
    own, of = tables(spark, rng, 1, 2000, 1200, words=8)
    of = [(g, f, p, ((k % 100 + 1) / 100) ** 20) for k, (g, f, p, _) in enumerate(of)]
    pairs = N.weighted_best(spark.createDataFrame(own, SCHEMAS[0]), spark.createDataFrame(of, SCHEMAS[1]), ["g"], counted="n").agg(F.sum("n")).first()[0]
    assert pairs < 2000 * 1200 / 10


def test_a_row_and_itself(spark):
    from lodestone.operators.diagnostics import nearest_others

    own, _ = tables(spark, random.Random(6), 2, 40, 0)
    own = [*own, (7, 1, [3, 3], 4, "lone"), (0, 1000, own[0][2], own[0][3], "same")]
    got = nearest_others(spark.createDataFrame(own, SCHEMAS[0]), ["g"], "k").collect()
    assert len(got) == len(own) - 1
    for r in got:
        of = [(g, f, p, 1.0) for g, k, f, p, _ in own if k != r.k]
        assert r.nearest == pytest.approx(plainly(r.fp, r.g, of))
    assert {r.nearest for r in got if r.g == 0 and r.k in (0, 1000)} == {1.0}


def test_blocks_are_dealt_over_tasks_counted_by_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 16)
    monkeypatch.setattr(N, "ANCHORS", 8)
    own, of = tables(spark, random.Random(3), 1, 300, 90)
    plan = N.weighted_best(spark.createDataFrame(own, SCHEMAS[0]), spark.createDataFrame(of, SCHEMAS[1]), ["g"])._jdf.queryExecution().executedPlan().toString()
    # 300 rows of one group: 37 tasks, which adaptive execution leaves as they are.
    assert plan.count("37), REPARTITION_BY_NUM") >= 3


@pytest.mark.parametrize("wide", [1, 2, 3])
def test_anchors_of_a_weight_are_met_in_tiles(wide, monkeypatch):
    """Row by row and anchor by anchor, pairs took some thirty times as long; values are the same."""
    monkeypatch.setattr(N, "TILE", (16, 20))
    rng = np.random.default_rng(wide)
    bits = lambda n: rng.integers(0, 2**32, (n, wide), dtype=np.uint64) & rng.integers(0, 2**32, (n, wide), dtype=np.uint64)
    words, a_words, a_at = bits(300), bits(700), np.array([0, 400, 420, 420, 700])
    a_words[:5], words[:3], words[3] = 0, 0, a_words[10]
    if wide == 3:
        a_words[7, 0] |= np.uint64(1 << 40)
    block = np.sort(rng.integers(0, 4, 300))
    weights = np.concatenate([np.sort(rng.choice([0.2, 0.7, 1.0], 400))[::-1], np.sort(rng.random(20))[::-1], np.full(280, 0.5)])
    pops, a_pops = (np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (words, a_words))
    for ids, a_ids in ((np.zeros(300, np.int64), np.ones(700, np.int64)), (np.arange(300), np.arange(700) % 350)):
        got, want = np.zeros(300), np.zeros(300)
        met = []
        monkeypatch.setattr(N, "_in_tiles", lambda *a, f=IN_TILES, met=met: (met.append(len(a[0]) * len(a[3])), f(*a))[1])
        compared = N.best_values(words, pops, ids, block, a_words, a_pops, a_ids, weights, a_at, got)
        N._one_by_one(words, pops, ids, block, a_words, a_pops, a_ids, weights, a_at, want)
        assert np.array_equal(got, want) and len(met) == 2
        assert 0 < compared <= sum((block == k).sum() * (a_at[k + 1] - a_at[k]) for k in range(4))
        again = got.copy()
        assert N.best_values(words, pops, ids, block, a_words, a_pops, a_ids, weights, a_at, again) <= compared and np.array_equal(again, got)


def test_a_group_of_one_list_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 16)
    own, of = tables(spark, random.Random(4), 1, 300, 40)
    got = N.weighted_best(spark.createDataFrame(own, SCHEMAS[0]), spark.createDataFrame(of, SCHEMAS[1]), ["g"])
    assert got._jdf.queryExecution().executedPlan().toString().count("37), REPARTITION_BY_NUM") >= 5
    for r in got.collect():
        assert r.best == pytest.approx(plainly(r.fp, r.g, of), abs=1e-12)

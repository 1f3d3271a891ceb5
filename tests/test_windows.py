"""Best rows of windows by blocks against a row for each pair of query and candidate."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.families import block_scorer
from lodestone.operators import predict as V
from lodestone.operators import windows as N
from lodestone.plans import workflows as W

from .conftest import SF_SMALL

LAYOUT = {"first": (0, 32), "second": (32, 48), "third": (48, 70)}


@pytest.fixture(scope="module")
def inputs(spark):
    """sf0.001 with a pool of several rows a mass, words of which some are short, null or 0."""
    pool = W._pool(spark, SF_SMALL)
    more = pool.withColumn("key", F.concat(F.lit("M"), "key")).withColumn("exact_mass", F.col("exact_mass") + 0.0004).withColumn("fp", F.when(F.col("popcount") % 3 == 0, F.slice("fp", 1, 1)).otherwise(F.reverse("fp")))
    odd = spark.createDataFrame([("Z0", "SZ0", 901.0, [0, 0], 0), ("Z1", "SZ1", 901.0, None, None), ("Z2", "SZ2", None, [1, 1], 2)], "key string, smiles string, exact_mass double, fp array<long>, popcount int")
    pool = pool.unionByName(more).unionByName(odd.withColumn("popcount", F.col("popcount"))).localCheckpoint()
    lib, probs = W._library(spark, SF_SMALL).localCheckpoint(), W._probs(spark, SF_SMALL)
    tests = W._test_spectra(spark, SF_SMALL)
    return tests.localCheckpoint(), lib, pool, probs.where("seq % 5 <> 0").localCheckpoint()


def found(rows):
    return sorted((r.query_id, r.molecule_id, r.seq, r.key, r.smiles, round(r.score, 9)) for r in rows.collect())


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("blocks", [False, True])
def test_blocks_give_what_pairs_give(spark, inputs, monkeypatch, alpha, blocks):
    monkeypatch.setattr(N, "SCORES", 20)
    monkeypatch.setattr(N, "PAIRS", 30)
    tests, lib, pool, probs = inputs
    scorer = block_scorer(LAYOUT, 0.2, True) if blocks else V.plain_loglik
    want = found(V.scored_windows(tests, lib, pool, pool, probs, alpha, W.WIDE, lambda *a: scorer(*a)))
    got = found(V.scored_windows(tests, lib, pool, pool, probs, alpha, W.WIDE, scorer if blocks else None))
    assert [r[:5] for r in got] == [r[:5] for r in want] and len(got) > 0
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], abs=2e-9)


def test_families_one_by_one(spark, inputs):
    tests, lib, pool, probs = inputs
    for weight, pooled, of in ((0.4, False, None), (0.4, False, ["third"]), (0.0, True, None), (0.0, False, None), (0.3, True, ["second"])):
        scorer = block_scorer(LAYOUT, weight, pooled, of)
        want = found(V.scored_windows(tests, lib, pool, pool, probs, 0.0, W.WIDE, lambda *a, s=scorer: s(*a)))
        got = found(V.scored_windows(tests, lib, pool, pool, probs, 0.0, W.WIDE, scorer))
        assert [r[:5] for r in got] == [r[:5] for r in want]


def test_no_pair_of_query_and_candidate_is_a_row(spark, inputs, monkeypatch):
    """Pairs were joined, kept on disk and sorted by query; only the best of a window leave a task now."""
    def none(*_, **__):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(V, "widening_join", none)
    tests, lib, pool, probs = inputs
    assert V.predict_v2(tests, lib, pool, None, W.WIDE).count() > 0
    scorer = block_scorer(LAYOUT, 0.2, True)
    for more in (None, scorer):
        assert V.predict_v3(tests, lib, pool, probs, None, W.WIDE, more).count() > 0
    assert V.rank_large_pool(tests, lib, pool, pool, probs, W.WIDE).count() > 0


def test_widens_until_a_candidate_scores(spark):
    pool = spark.createDataFrame([("a", "A", 100.0, [4], 1), ("b", "B", 100.005, [3], 2), ("c", "C", 100.05, [1], 1), ("d", "D", 100.06, [2], 1), ("e", "E", 100.5, [3], 2)], "key string, smiles string, exact_mass double, fp array<long>, popcount int")
    asked = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0), (4, float("nan")), (5, 100.0)], "query_id int, mass double")
    own = spark.createDataFrame([(1, [(1.0, [3], 2)]), (2, [(1.0, [8], 1)]), (3, [(0.5, [4], 1), (0.9, [4, 1], 2)]), (4, [(1.0, [3], 2)])], "query_id int, anchors array<struct<weight: double, fp: array<long>, pop: int>>")
    got = sorted((r.query_id, r.key, round(r.score, 6)) for r in N.best_until_scored(asked, own, pool, (0.001, 0.01, 0.1, 1.0), 50).collect())
    assert got == [(1, "b", 1.0), (3, "a", 0.5)]
    near = N.best_until_scored(asked.where("query_id = 1"), own, pool.where("key <> 'b'"), (0.001, 0.01, 0.1, 1.0), 50)
    assert sorted((r.key, r.score) for r in near.collect()) == [("c", 0.5), ("d", 0.5)]


def test_a_hot_cell_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "SCORES", 1000)
    monkeypatch.setattr(N, "PAIRS", 2000)
    pool = spark.range(100).select(F.format_string("k%03d", "id").alias("key"), F.lit("s").alias("smiles"), F.lit(100.0).alias("exact_mass"), F.array("id").alias("fp"), F.bit_count("id").alias("popcount"))
    asked = spark.range(400).select(F.col("id").alias("query_id"), F.lit(100.0).alias("mass"))
    own = asked.select("query_id", F.array(*[F.lit(0.9)] * 8).alias("p"))
    blocks = N.met(N.levels_of(asked, pool, (0.001,)), own, pool, (0.001,)).select(F.size("queries").alias("q"), F.size("candidates").alias("c"), F.spark_partition_id().alias("task")).collect()
    assert sum(r.q for r in blocks) == 400 and {r.c for r in blocks} == {100}
    assert max(r.q for r in blocks) <= 30 and len({r.task for r in blocks}) > 4
    best = N.best_of_windows(N.levels_of(asked, pool, (0.001,)), own, pool, (0.001,), 3, 0.0).groupBy("query_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    assert {tuple(r.keys) for r in best.collect()} == {("k031", "k063", "k095")}

"""Joins by distinct values: the same rows as plain joins, with no work for rows of equal values but putting them in."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import joins as J
from lodestone.operators import values as U
from lodestone.plans.catalog import ORACLES, QUERIES

from .conftest import SF
from .test_catalog import rows, same, views


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """sf0.01 with each part, and each row of the pool, twice under other keys."""
    folder = tmp_path_factory.mktemp("copies")
    for name in os.listdir(SF):
        if name not in ("part.parquet", "embeddings.parquet"):
            os.symlink(f"{SF}/{name}", folder / name)
    for name, key, by in (("part", "p_partkey", 2000), ("embeddings", "vec_id", 1000)):
        t = f"SELECT * FROM '{SF}/{name}.parquet'"
        duckdb.execute(f"COPY ({t} UNION ALL SELECT * REPLACE ({key} + {by} AS {key}) FROM ({t})) TO '{folder}/{name}.parquet'")
    return str(folder)


BY_VALUES = ("c14_hard_decoys", "q_band_top25", "q5_propagate", "j1_band", "j2_widen", "j2_widen_tagged", "j3_widen_until_scored", "p7_ppm_bonus", "q8_stored_pool", "q18_streamed_band")


@pytest.mark.parametrize("name", BY_VALUES)
def test_copies_meet_once(spark, copies, monkeypatch, name):
    """Queries of equal centers enter a band join once, and the rows are those of the SQL."""
    joined = J.band_join

    def once(queries, pool, center, *rest, **more):
        assert queries.count() == queries.select(center).distinct().count()
        return joined(queries, pool, center, *rest, **more)

    for module in (J, U):
        monkeypatch.setattr(module, "band_join", once)
    monkeypatch.setattr(U, "PAIRS", 5_000)
    got = QUERIES[name](spark, copies)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "(abs((p_retailprice" not in plan  # p7 compares distinct values, and not the rows that it makes
    want = views(copies).execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(columns, want.fetchall())
    assert len(a) == len(b) > 0
    bad = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not bad, bad[:3]


def test_hot_values_and_nulls(spark, monkeypatch):
    """A value of many rows is divided into lists and pieces; null columns stay, null values meet nothing."""
    monkeypatch.setattr(U, "PAIRS", 1000)
    queries = spark.range(300).select(F.when(F.col("id") > 2, F.col("id")).alias("q"), F.when(F.col("id") > 5, 10.0).alias("c"))
    pool = spark.range(3000).select(F.when(F.col("id") > 2, F.col("id")).alias("k"), (10.0 + (F.col("id") % 2) * 5).alias("m"))
    got = U.band_pairs(queries, pool, "c", "m", 1.0)
    assert got.count() == 294 * 1500 and got.where("k is null").count() == 294 * 2
    assert got.rdd.getNumPartitions() > 8
    assert got.distinct().count() == 294 * 1499


def test_a_hot_value_is_copied_by_the_root_of_its_pairs(spark, monkeypatch):
    """Both sides of a value are divided: before, its right side went whole to every part of the left."""
    monkeypatch.setattr(U, "PAIRS", 1000)
    sizes = spark.createDataFrame([(2000, 2000), (100_000, 10), (10, 100_000), (3, 1)], "l long, r long")
    lefts, rights = U.grid(F.col("l") * F.col("r"), F.col("l"), F.col("r"))
    for x in sizes.select("l", "r", lefts.alias("a"), rights.alias("b")).collect():
        pairs = x.l * x.r
        assert 1 <= x.a * x.b <= 2 * (pairs // 1000 + 1) and x.l / x.a * x.r / x.b <= 1000
        assert x.l * x.b + x.r * x.a <= 4 * (pairs / 1000**0.5 + x.l + x.r)


def test_pairs_are_made_apart_from_the_join(spark, monkeypatch):
    """Fused with the join, all pairs of a list are kept in memory before the first one leaves the task."""
    monkeypatch.setattr(U, "PAIRS", 1000)
    queries, pool = spark.range(300).select(F.col("id").alias("q"), F.lit(1.0).alias("c")), spark.range(700).select(F.col("id").alias("k"), F.lit(1.0).alias("m"))
    got = U.band_pairs(queries, pool, "c", "m", 1.0)
    assert got.distinct().count() == got.count() == 300 * 700
    lines = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Generate" in x or "Coalesce" in x or "ShuffledHashJoin" in x]
    kinds = [next(k for k in ("Generate", "Coalesce", "ShuffledHashJoin") if k in x) for x in lines]
    assert kinds[: kinds.index("ShuffledHashJoin") + 1] == ["Generate", "Generate", "Coalesce", "ShuffledHashJoin"]


def test_slices_hold_each_row_once(spark):
    lists = spark.createDataFrame([(1, list(range(10))), (2, list(range(4))), (3, [None] * 5)], "k int, xs array<int>")
    got = U._sliced(lists, "xs", 4).collect()
    assert sorted((r.k, len(r.xs)) for r in got) == [(1, 2), (1, 4), (1, 4), (2, 4), (3, 1), (3, 4)]
    assert sorted(x for r in got if r.k == 1 for x in r.xs) == list(range(10))


def test_spans(spark):
    """As many windows as their contents differ, whatever the number of queries."""
    queries = spark.range(5000).select((F.col("id") / 500.0).alias("c"))
    pool = spark.range(10).select(F.col("id").cast("double").alias("m"))
    of, held = U.spans(queries, pool, "c", "m", 1.0)
    assert of.count() == 5000 and held.select("span").distinct().count() <= 21
    assert held.join(of, "span").select("c", "m").exceptAll(J.band_join(queries, pool, "c", "m", 1.0)).count() == 0


def test_large_windows_keep_their_decoys(spark, tmp_path):
    """A window of more rows than the engine's default bound (20,000) is not left out."""
    from lodestone.config import DEFAULT

    n = DEFAULT.max_window + 10
    spark.range(n).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit(1).alias("p_size"), F.lit(900.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when((F.xxhash64("id", i) % 2) == 0, 1.0).otherwise(-1.0).cast("float"))
    spark.range(n).select(F.col("id").alias("vec_id"), bits.alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["c14_hard_decoys"](spark, str(tmp_path))
    asked = n - (n + 4) // 5  # the others' centers lie beyond the pool
    assert got.count() == 8 * asked


def test_rows_of_equal_content_are_worked_on_once(spark):
    rows = spark.createDataFrame([(5, "a", [1.0]), (3, "a", [1.0]), (4, None, None), (2, None, None), (1, "a", [2.0])], "i int, x string, y array<double>")
    one, every = U.alike(rows, "i", ["x", "y"], ["i"])
    assert sorted(r.i for r in one.collect()) == [1, 2, 3]
    assert sorted((r.of, r.i) for r in every.collect()) == [(1, 1), (2, 2), (2, 4), (3, 3), (3, 5)]


def test_copies_of_spectra_are_searched_and_predicted_once(spark, monkeypatch):
    from lodestone.operators import library as L
    from lodestone.operators import predict as V
    from lodestone.plans import workflows as W

    from .conftest import SF_SMALL

    asked = []
    core = L.searched
    monkeypatch.setattr(L, "searched", lambda q, *a: (asked.append(q.count()), core(q, *a))[1])
    lib, pool, probs = W._library(spark, SF_SMALL).localCheckpoint(), W._pool(spark, SF_SMALL).localCheckpoint(), W._probs(spark, SF_SMALL)
    tests = W._test_spectra(spark, SF_SMALL).localCheckpoint()
    moved = lambda df: df.withColumn("seq", F.col("seq") + 10**6)
    twice = tests.unionByName(moved(tests).withColumn("molecule_id", F.col("molecule_id") + 10**6))
    want = sorted(map(tuple, V.predict_v3(tests, lib, pool, probs, None, W.WIDE).collect()))
    got = sorted(map(tuple, V.predict_v3(twice, lib, pool, probs.unionByName(moved(probs)), None, W.WIDE).collect()))
    assert got == sorted([*want, *((m + 10**6, *rest) for m, *rest in want)])
    assert len(set(asked)) == 1

"""Stored pools: what a band finds, and which files are opened for it."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import joins as J
from lodestone.sources import pools


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    pool = spark.createDataFrame([*((k, rng.uniform(100, 900), f"s{k}") for k in range(5000)), (-1, None, "null"), (-2, float("nan"), "nan"), (-3, 500.0, None)], "key int, mass double, smiles string")
    path = pools.write_pool(pool, str(tmp_path_factory.mktemp("pool")), "mass", 20)
    return pool, path


def test_index(spark, stored):
    index = pools.index_of(spark, stored[1]).orderBy("least").collect()
    assert len(index) == 20 and sum(r.rows for r in index) == 5001
    assert all(a.greatest < b.least for a, b in zip(index, index[1:], strict=False))


@pytest.mark.parametrize("width", [0.001, 0.5, 30.0])
def test_only_files_that_a_band_meets(spark, stored, width):
    pool, path = stored
    queries = spark.createDataFrame([(1, 150.0), (2, 150.3), (3, 777.7), (4, None), (5, 5000.0), (6, float("nan"))], "query_id int, center double")
    index = pools.index_of(spark, path).collect()
    files = {r.file for r in pools.files_in_bands(spark, path, queries, "center", width).collect()}
    meets = {r.file for r in index for c in (150.0, 150.3, 777.7) if r.greatest >= c - width and r.least <= c + width}
    assert meets <= files and len(files) < len(index) and (width == 30.0 or files == meets)
    read = pools.in_bands(spark, path, queries, "center", width)
    assert {f.rsplit("/", 1)[1] for f in read.inputFiles()} == files
    got, want = (sorted((r.query_id, r.key) for r in J.band_join(queries, p, "center", "mass", width).collect()) for p in (read, pool.where("key <> -2")))
    assert got == want


def test_every_row_that_any_width_finds(spark, stored):
    pool, path = stored
    queries = spark.createDataFrame([(k, 100.0 + k * 0.37) for k in range(60)], "query_id int, center double")
    read = pools.in_bands(spark, path, queries, "center", 1.0)
    got, want = (sorted((r.query_id, r.key, r.level) for r in J.widening_join(queries, p, "query_id", "center", "mass").collect()) for p in (read, pool))
    assert got == want and got


def test_nothing_to_open(spark, stored, tmp_path):
    none = spark.createDataFrame([], "query_id int, center double")
    read = pools.in_bands(spark, stored[1], none, "center", 1.0)
    assert read.collect() == [] and read.columns == ["key", "mass", "smiles"]
    empty = pools.write_pool(stored[0].where("key < -9"), str(tmp_path / "p"), "mass", 3)
    assert pools.in_bands(spark, empty, none.select("query_id", F.lit(1.0).alias("center")), "center", 1.0).collect() == []

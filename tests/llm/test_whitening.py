"""Whitening against whole-number and plain numpy versions, and what it does with unusual rows."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import whitening as W

SF = "/root/testdata/sf0.01"


def exactly(x):
    """The covariance of whole numbers as fractions."""
    n = len(x)
    rows = [[int(v) for v in r] for r in x]
    mean = [Fraction(sum(r[i] for r in rows), n) for i in range(len(rows[0]))]
    return [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in rows) / n for j in range(i, len(mean))] for i in range(len(mean))]


@pytest.mark.parametrize(("parts", "spread"), [(1, 5), (7, 5), (7, 2**44)])
def test_covariance_is_that_of_whole_numbers(spark, parts, spread):
    rng = np.random.default_rng(parts)
    x = rng.integers(-spread, spread, (61, 5)) + W.SHIFT
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<bigint>").repartition(parts)
    n, sums = W._sums(table, 5)
    assert (n, sums) == (61, [int(s) for s in x.astype(object).sum(axis=0)])
    rows, columns = np.triu_indices(5)
    high, low = W._accumulated(table, lambda b: W.outer(*W.centred(b, n, sums), rows, columns), len(rows))
    want = [v * n for r in exactly(x) for v in r]
    most = max(abs(v) for v in want)
    assert all(abs(Fraction(h) + Fraction(l) - v) <= most / 2**95 for h, l, v in zip(high.tolist(), low.tolist(), want, strict=True))


def test_error_free_steps():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=50) * 1e9, rng.normal(size=50)
    for f, op in ((W.two_sum, lambda x, y: x + y), (W.two_product, lambda x, y: x * y)):
        s, e = f(a, b)
        assert all(Fraction(x) + Fraction(y) == op(Fraction(p), Fraction(q)) for x, y, p, q in zip(s.tolist(), e.tolist(), a.tolist(), b.tolist(), strict=True))


def test_against_numpy(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = W.whitened(rows).toPandas().sort_values(["vec_id", "component"])
    raw = rows.toPandas().sort_values("vec_id")
    x = np.floor(64 * np.array(raw.embedding.tolist()).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    cov = np.cov((fit - 1_000_000).T.astype(float), bias=True)
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values)[:16]
    want = ((x - 1_000_000) - (fit - 1_000_000).mean(axis=0)) @ basis[:, order] / np.sqrt(values[order])
    have = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-9
    assert (got.component.to_numpy().reshape(-1, 16) == np.arange(1, 17)).all() and set(got.n) == {len(fit)}
    n, sums = len(fit), fit.sum(axis=0)
    assert (got.deviation.to_numpy()[::16] == ((n * x - sums) ** 2).sum(axis=1)).all()
    assert np.allclose(got.explained.to_numpy()[:16], values[order] / np.trace(cov), rtol=1e-9) and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_unusual_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.5]), (3, [0.0, 2.0, 0.5]), (3, [0.0, 2.0, 0.5]), (None, [1.0, 1.0, 1.0]), (5, [1.001, 0.0, 0.5]), (6, [-1.0, 0.25, 0.5])]
    bad = [(10, None), (11, [0.0, None, 1.0]), (12, [nan, 0.0, 0.0]), (13, [0.0, inf, 0.0]), (14, [-inf, 0.0, 0.0]), (15, []), (16, [1.0, 2.0]), (17, [1e30, 0.0, 0.0])]
    rows = spark.createDataFrame([(i, v, i, "k") for i, v in [*good, *bad]], "vec_id long, embedding array<double>, component long, key string")
    got = W.whitened(rows).collect()
    kept = sorted((r.vec_id is None, r.vec_id) for r in got if r.component == 1)
    assert kept == sorted((i is None, i) for i, _ in good)
    # Vectors of equal x count once: [1, 0, .5] and [1.001, 0, .5] do, as do both rows of id 3.
    assert {r.n for r in got} == {5} and {r.component for r in got} == {1, 2, 3}
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64)
    fit = np.unique(x, axis=0)
    by = {(r.vec_id, r.component): r.whitened for r in got}
    z = np.array([[by[i, c] for c in (1, 2, 3)] for i in (1, 2, 3, 6)])
    assert len(fit) == 5 and np.isfinite(z).all() and by[2, 1] == by[5, 1]


def test_constant_entries_have_no_component(spark):
    rows = spark.createDataFrame([(k, [float(k), 7.0, float(k * k % 5)]) for k in range(20)], "vec_id int, embedding array<float>")
    got = W.whitened(rows)
    assert got.schema["vec_id"].dataType.simpleString() == "int" and {r.component for r in got.collect()} == {1, 2}


def test_nothing_to_fit(spark):
    kind = "vec_id long, embedding array<float>"
    assert W.whitened(spark.createDataFrame([], kind)).collect() == []
    assert W.whitened(spark.createDataFrame([(1, None)], kind)).collect() == []
    assert W.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).collect() == []


def test_deviations_beyond_a_long_are_null(spark):
    rows = spark.createDataFrame([(k, [float(k * 2**44 // 64), float(k)]) for k in range(8)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in W.whitened(rows).where("component = 1").collect()}
    x = [[k * 2**44 // 64 * 64 + W.SHIFT, k * 64 + W.SHIFT] for k in range(8)]
    want = [sum((8 * v - s) ** 2 for v, s in zip(r, map(sum, zip(*x, strict=True)), strict=True)) for r in x]
    assert [got[k] for k in range(8)] == [w if w < 2**63 else None for w in want] and None in got.values()


def test_repeated_vectors_count_once_however_often(spark):
    one = spark.read.parquet(f"{SF}/embeddings.parquet")
    hot = one.limit(1).crossJoin(spark.range(3000)).drop("id").withColumn("vec_id", F.lit(None).cast("long"))
    a = W.whitened(one).where("component = 1 and vec_id = 7").first()
    b = W.whitened(one.unionByName(hot)).where("component = 1 and vec_id = 7").first()
    assert a.n == b.n and a.deviation == b.deviation and abs(abs(a.whitened) - abs(b.whitened)) < 1e-12

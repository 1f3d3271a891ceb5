"""Engine operators against plain Python on small rows, and the properties that predictions keep."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, EngineConfig
from lodestone.functions import bits as B
from lodestone.functions import models as M
from lodestone.functions import peaks as P
from lodestone.operators import evaluate as E
from lodestone.operators import joins as J
from lodestone.operators import predict as V
from lodestone.plans import workflows as W

from .conftest import SF_SMALL


def weigh(v):
    v = np.maximum(np.array(v, float), 0)
    t = v.sum()
    if t <= 0:
        return v
    p = v[v > 0] / t
    s = -(p * np.log(p)).sum()
    return v if s >= 3 else v ** (0.25 + 0.25 * s)


def cosine(a, b, shift, tol):
    wa, wb = weigh([i for _, i in a]), weigh([i for _, i in b])
    n = np.linalg.norm(wa) * np.linalg.norm(wb)
    found = sorted((-wa[i] * wb[j], i, j) for i, (x, _) in enumerate(a) for j, (y, _) in enumerate(b) if x - tol <= y <= x + tol or (abs(shift) > tol and x - tol <= y + shift <= x + tol))
    ui, uj, s = set(), set(), 0.0
    for p, i, j in found:
        if i not in ui and j not in uj:
            ui.add(i), uj.add(j)
            s -= p
    return s / n if n > 0 else 0.0


def lists(spark, rows):
    return spark.createDataFrame(rows, "id int, a array<struct<mz:double,intensity:double>>, b array<struct<mz:double,intensity:double>>, shift double")


def test_modified_cosine_against_numpy(spark):
    rng = random.Random(1)
    some = lambda: sorted((round(rng.uniform(0, 20), 2), round(rng.random(), 3)) for _ in range(rng.randint(0, 15)))
    rows = [(i, some(), some(), rng.choice([0.0, 0.3, 5.0, -5.0])) for i in range(120)]
    rows += [(900, [], some(), 1.0), (901, [(1.0, 0.0)], [(1.0, 0.0)], 0.0), (902, [(1.0, 1.0)], [(1.0, 1.0)], 0.0)]
    df = lists(spark, rows)
    got = {r.id: r.s for r in df.select("id", P.modified_cosine(F.col("a"), F.col("b"), F.col("shift"), 0.5).alias("s")).collect()}
    for i, a, b, shift in rows:
        assert got[i] == pytest.approx(cosine(a, b, shift, 0.5), abs=1e-9)
    same = {r.id: r.s for r in df.select("id", P.cosine(F.col("a"), F.col("a"), 0.001).alias("s")).collect()}
    assert same[902] == pytest.approx(1.0) and same[900] == 0.0


def test_edges_of_peak_functions(spark):
    row = lambda a: lists(spark, [(1, a, [], 0.0)])
    one = lambda a, e: row(a).select(e.alias("x")).first().x
    flat = [(float(i), 1.0) for i in range(25)]
    assert one(flat, P.entropy_weight(P.field(F.col("a"), "intensity"))) == [1.0] * 25  # entropy of 3 and more
    assert one([(1.0, 0.0), (2.0, 0.0)], P.entropy_weight(P.field(F.col("a"), "intensity"))) == [0.0, 0.0]
    forty = [(float(i), 1.0 + i % 7) for i in range(40)]
    assert len(one(forty, P.top_peaks(F.col("a"), 40))) == 40
    kept = one([*forty, (40.0, 0.5)], P.top_peaks(F.col("a"), 40))
    assert len(kept) == 40 and [p.mz for p in kept] == sorted(p.mz for p in kept) and 40.0 not in [p.mz for p in kept]
    merged = one([(1.0, 1.0), (1.015, 1.0), (1.03, 2.0)], P.merge_anchored(F.col("a"), 0.02))
    assert [(round(p.mz, 6), p.intensity) for p in merged] == [(1.0075, 1.0), (1.03, 1.0)]  # anchored: two clusters
    assert one([], P.merge_anchored(F.col("a"), 0.02)) == []
    assert one([], P.featurize(F.col("a"), F.lit(600.0), F.lit("positive"))) == [(12002, 0.5)]


def test_tanimoto_properties(spark):
    rng = random.Random(2)
    rows = [([rng.getrandbits(32) & rng.getrandbits(32) for _ in range(3)], [rng.getrandbits(32) for _ in range(3)]) for _ in range(50)] + [([0, 0, 0], [0, 0, 0])]
    for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", B.tanimoto(F.col("a"), F.col("b")).alias("x"), B.tanimoto(F.col("b"), F.col("a")).alias("y"), B.unpack(B.pack(F.col("a"))).alias("back")).collect():
        both, either = (sum(bin(f(p, q)).count("1") for p, q in zip(r.a, r.b, strict=True)) for f in (int.__and__, int.__or__))
        assert r.x == r.y == (both / either if either else 0.0) and r.back == r.a


def test_band_and_widening_joins(spark):
    rng = random.Random(3)
    pool = [(i, round(rng.uniform(100, 110), 3), rng.random()) for i in range(300)] + [(900, 105.0, 0.0)]
    queries = [(i, round(rng.uniform(99, 112), 3)) for i in range(80)] + [(800, 104.0), (801, None)]
    p, q = spark.createDataFrame(pool, "key int, mass double, s double"), spark.createDataFrame(queries, "qid int, center double")
    inside = lambda c, m, w: m >= c - w and m <= c + w
    got = {(r.qid, r.key) for r in J.band_join(q, p, "center", "mass", 0.25).collect()}
    assert got == {(a, k) for a, c in queries if c is not None for k, m, _ in pool if inside(c, m, 0.25)}
    for accept, holds in ((None, lambda s: True), (F.col("s") > 0.5, lambda s: s > 0.5)):
        want = set()
        for a, c in queries:
            for level, w in enumerate(DEFAULT.widths, 1):
                hits = {(a, k, level) for k, m, s in pool if c is not None and inside(c, m, w) and holds(s)}
                if hits:
                    want |= hits
                    break
        for join in (J.widening_join, J.widening_join_tagged):
            assert {(r.qid, r.key, r.level) for r in join(q, p, "qid", "center", "mass", accept=accept).collect()} == want


def test_neutral_mass_and_adduct_tables(spark):
    rows = spark.createDataFrame([(1, 301.0, "[M+H]+"), (2, 301.0, "[M+2H]2+"), (3, 301.0, "[2M+Na]+"), (4, 301.0, "nothing"), (5, 0.5, "[M+H]+"), (6, 301.0, "[M+Cl]-")], "i int, precursor_mz double, adduct string")
    masses = lambda cfg: {r.i: r.mass for r in V.neutral_mass(rows, cfg).collect()}
    got, compat = masses(DEFAULT), masses(EngineConfig(compat_adducts=True))
    assert got[1] == pytest.approx(299.992724) and got[2] == pytest.approx(599.985448) and got[4] is None and got[5] is None
    assert got[6] == pytest.approx(301 - 34.969402) and compat[6] == pytest.approx(301 + 34.969402)
    assert {k: v for k, v in got.items() if k != 6} == {k: v for k, v in compat.items() if k != 6}


def test_search_against_numpy(spark):
    cfg = W.WIDE
    lib = [r.asDict(True) for r in W._library(spark, SF_SMALL).collect()]
    tests = [r.asDict(True) for r in W._test_spectra(spark, SF_SMALL).collect()]
    got = {}
    for r in W.q2_search(spark, SF_SMALL).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.spec_id, r.sim))

    def bins(peaks):
        v = np.zeros(cfg.bins)
        np.add.at(v, [min(max(int(p["mz"] / cfg.bin_width), 0), cfg.bins - 1) for p in peaks], weigh([p["intensity"] for p in peaks]))
        return v / (np.linalg.norm(v) or 1)

    pairs = lambda ps: [(p["mz"], p["intensity"]) for p in ps]
    for t in tests:
        peaks = [{"mz": m, "intensity": i} for m, i in sorted(zip(t["mzs"], t["intensities"], strict=True))]
        mode = t["mode"].strip().lower()
        dots = sorted((-float(bins(peaks) @ bins(s["peaks"])), s["spec_id"], s) for s in lib if s["mode"] == mode)
        want = []
        for dot, spec, s in [d for d in dots if d[0] < 0][: cfg.coarse_top]:
            sim = cosine(pairs(peaks), pairs(s["peaks"]), t["precursor_mz"] - s["precursor_mz"], cfg.match_tol)
            sim += cfg.ppm_bonus * (abs(s["precursor_mz"] - t["precursor_mz"]) <= t["precursor_mz"] * cfg.ppm / 1e6)
            if sim > 0:
                want.append((spec, round(sim, 6)))
        mine = {spec: sim for _, spec, sim in got.get(t["seq"], [])}
        best = sorted(want, key=lambda x: -x[1])[: cfg.fine_top]
        assert len(mine) == len(best)
        assert sorted(mine.values()) == pytest.approx(sorted(s for _, s in best), abs=2e-6)


def test_tiers_and_invariants(spark):
    v3, v4 = ({} for _ in range(2))
    for out, query in ((v3, W.q7_predict_v3), (v4, W.q9_predict_v4)):
        for r in query(spark, SF_SMALL).collect():
            out.setdefault(r.molecule_id, []).append((r.rank, r.smiles))
    assert set(v3) == set(v4)
    for m in v3:
        a, b = [s for _, s in sorted(v3[m])], [s for _, s in sorted(v4[m])]
        assert b[: len(a)] == a and len(b) <= 25 and [r for r, _ in sorted(v4[m])] == list(range(1, len(b) + 1))


def test_fallback_for_molecules_without_a_mass(spark):
    lib = W._library(spark, SF_SMALL)
    odd = W._test_spectra(spark, SF_SMALL).limit(2).withColumn("adduct", F.lit("unheard of")).withColumn("mode", F.lit("neither"))
    rows = V.predict_v2(odd, lib, W._pool(spark, SF_SMALL), None, W.WIDE).collect()
    assert {r.molecule_id for r in rows} == {r.molecule_id for r in odd.collect()} and max(r.rank for r in rows) <= 25


def test_submission_rules(spark):
    pred = spark.createDataFrame([("a", 1, "X"), ("a", 2, None), ("a", 3, "Y"), ("b", 1, "")], "molecule_id string, rank int, smiles string")
    want = spark.createDataFrame([("a",), ("c",)], "molecule_id string")
    assert {tuple(r) for r in E.submission(pred, want, ["F", "", "G"]).collect()} == {("a", "X;Y"), ("b", "F;G"), ("c", "F;G")}
    with pytest.raises(Exception, match="no guess"):
        E.submission(pred, want, []).collect()
    with pytest.raises(Exception, match="duplicate id"):
        E.submission(pred.union(pred), want, ["F"]).collect()


def test_reciprocal_ranks(spark):
    ans = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z")], "molecule_id int, ckey string")
    pred = spark.createDataFrame([(1, 2, "x"), (1, 1, "q"), (2, 26, "y"), (3, 1, None)], "molecule_id int, rank int, ckey string")
    assert {r.molecule_id: r.rr for r in E.reciprocal_ranks(ans, pred).collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 0.0}


def test_models():
    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(5, 3)), rng.normal(size=3)), (rng.normal(size=(3, 2)), rng.normal(size=2))]
    x = rng.normal(size=(7, 5))
    want = 1 / (1 + np.exp(-(np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1])))
    one = M.Registry().load({"layers": layers})
    assert np.allclose(one(x), want) and np.allclose(M.Registry().load([{"layers": layers}] * 2)(x), want)
    with pytest.raises(ValueError):
        M.Registry().load({"weights": 1})


def test_stream_replays_nothing_twice(spark, tmp_path):
    from lodestone.streaming import ingest

    folder, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).repartition(2).write.mode("append").parquet(folder)
        stream = ingest.spectra_stream(spark, folder, "id long", 1)
        ingest.each_batch(stream, lambda b: b.select((F.col("id") * 2).alias("x")), out, at).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [2 * i for i in range(20)]


def test_widths_by_counting_are_those_of_the_cascade(spark):
    import random

    from lodestone.operators import joins as J

    rng, widths = random.Random(9), (0.001, 0.01, 0.1, 1.0)
    masses = [round(rng.uniform(100, 140), rng.choice([0, 2, 4, 6])) for _ in range(400)]
    pool = spark.createDataFrame([*((k, m) for k, m in enumerate(masses)), (-1, None), (-2, -3.0)], "key int, mass double")
    exact = [m + s * w for m, w, s in zip(masses, widths * 40, [-1, 1, 1.0000001] * 60, strict=False)]
    queries = spark.createDataFrame([*enumerate([*exact, *(rng.uniform(90, 150) for _ in range(300))]), (-1, None), (-2, -2.5), (0, 120.0)], "query_id int, center double")
    got = J.widening_join(queries, pool, "query_id", "center", "mass", widths)
    assert got.columns == ["query_id", "center", "key", "mass", "level"]
    want = {}
    for q in queries.collect():
        for level, w in enumerate(widths, 1):
            hits = [(p.key, p.mass) for p in pool.collect() if None not in (q.center, p.mass) and q.center - w <= p.mass <= q.center + w] if q.center is not None else []
            if hits:
                want[q.query_id, q.center] = sorted((*h, level) for h in hits)
                break
    have = {}
    for r in got.collect():
        have.setdefault((r.query_id, r.center), []).append((r.key, r.mass, r.level))
    assert {k: sorted(v) for k, v in have.items()} == want
    assert J.widening_join(queries, pool.where("key > 999"), "query_id", "center", "mass", widths).count() == 0

"""The engine as one object and from a shell, the peak encoder against loops, and checkpoints."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import run
from lodestone.config import DEFAULT
from lodestone.engine import Engine
from lodestone.functions import families as B
from lodestone.functions import models as M
from lodestone.functions import transformer as T
from lodestone.operators import ranking as R
from lodestone.plans import workflows as W
from lodestone.sources import checkpoints, readers, writers

from .conftest import SF_SMALL


def parse(smiles):
    """``key:mass:elements``; anything else doesn't parse."""
    out = []
    for s in smiles:
        parts = s.split(":")
        out.append((s, parts[0], float(parts[1]), list(parts[2]), parts[0].encode()) if len(parts) == 3 else None)
    return out


def test_commands_from_lines_to_ranks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    lines = ["1\tA:150:CH", "2\tA:149:CH", "3\tB:151:CX", "4\tshort.B:200:CHO", "bad line", "5\tC:5000:C", "6\tD:120:C", "7\tnothing"]
    with gzip.open(at("raw.txt.gz"), "wt") as f:
        f.write("\n".join(lines))
    run(spark, ["ingest-pool", "--input", at("raw.txt.gz"), "--out", at("pool"), "--parser", f"{__name__}:parse", "--shards", "2"])
    got = {(r.id, r.key, r.exact_mass) for r in spark.read.parquet(at("pool")).collect()}
    assert got == {("2", "A", 149.0), ("4", "B", 200.0), ("6", "D", 120.0)}
    run(spark, ["reshard", "--src", at("pool"), "--out", at("sharded"), "--rows", "1", "--shards", "1"])
    assert len(list((tmp_path / "sharded").glob("*.parquet"))) == 3
    W.spectra_rows(spark, SF_SMALL).where("molecule_id % 3 <> 0").write.parquet(at("train"))
    W._test_spectra(spark, SF_SMALL).write.parquet(at("test"))
    wide = '{"match_tol": 2.0, "merge_tol": 2.0, "bin_width": 4.0, "max_mz": 500.0}'
    run(spark, ["--config", wide, "library", "--spectra", at("train"), "--out", at("library")])
    run(spark, ["--config", wide, "predict", "--version", "1", "--spectra", at("test"), "--library", at("library"), "--out", at("ranks")])
    want = {tuple(r) for r in W.q3_predict_v1(spark, SF_SMALL).collect()}
    ranks = spark.read.parquet(at("ranks"))
    assert {(r.molecule_id, r.rank, r.smiles) for r in ranks.collect()} == want
    ranks.where("rank = 2").select("molecule_id", "ckey").write.parquet(at("answers"))
    (row,) = run(spark, ["evaluate", "--predictions", at("ranks"), "--answers", at("answers")])
    assert row["mrr"] == 0.5
    ranks.select("molecule_id").distinct().write.parquet(at("expected"))
    run(spark, ["submit", "--predictions", at("ranks"), "--expected", at("expected"), "--out", at("submission")])
    assert readers.csv(spark, at("submission"), "molecule_id long, smiles string").count() == len({m for m, *_ in want})
    with pytest.raises(SystemExit):
        run(spark, ["unheard-of"])


def test_sweeps_and_decoys(spark):
    engine = Engine(spark, W.WIDE)
    spectra, library, pool = W._test_spectra(spark, SF_SMALL), W._library(spark, SF_SMALL), W._pool(spark, SF_SMALL)
    go = lambda e: e.predict(2, spectra, library, pool)
    answers = go(engine).where("rank = 1").select("molecule_id", "ckey")
    swept = {r.config: r for r in engine.paired_sweep(go, answers, {"now": {}, "same": {}, "none": {"guesses": 1}}, "now").collect()}
    assert swept["same"].same == swept["same"].n and swept["same"].verdict == "not significant" and swept["none"].better == 0
    truths = pool.select("key", (F.col("exact_mass") + 0.3).alias("mass"), "fp")
    a, b = ({tuple(r[:3]) for r in engine.decoys(truths, pool, 25, 4, seed=s).collect()} for s in (1, 1))
    assert a and a == b and len({q for q, *_ in a}) <= 25 and max(r for _, r, _ in a) <= 4 and all(q != k for q, _, k in a)
    with pytest.raises(ValueError):
        engine.predict(5, spectra, library)


def loops(weights, heads, mz, own, mask, precursor, mode):
    """One spectrum through the encoder, token by token."""
    dims = len(weights["class"])
    dense = lambda name, x: [sum(x[i] * weights[name][0][i][j] for i in range(len(x))) + weights[name][1][j] for j in range(len(weights[name][1]))]
    half = dims // 2
    rates = [math.exp(math.log(2 * math.pi / 2000) + k * (math.log(2 * math.pi / 0.001) - math.log(2 * math.pi / 2000)) / (half - 1)) for k in range(half)]
    waves = lambda x: [math.sin(x * r) for r in rates] + [math.cos(x * r) for r in rates]

    def norm(name, x):
        mean = sum(x) / len(x)
        var = sum((v - mean) ** 2 for v in x) / len(x)
        return [(v - mean) / math.sqrt(var + 1e-5) * s + b for v, s, b in zip(x, *weights[name], strict=True)]

    ion = [a + b for a, b in zip(dense("precursor", waves(precursor)), weights["mode"][mode], strict=True)]
    tokens = [list(weights["class"]), ion]
    tokens += [dense("peak", waves(m) + waves(max(precursor - m, 0)) + dense("intensity", [v])) for m, v, here in zip(mz, own, mask, strict=True) if here]
    size = dims // heads
    for layer in range(2):
        x = [norm(f"{layer}.norm1", t) for t in tokens]
        q, k, v = ([dense(f"{layer}.{p}", t) for t in x] for p in ("query", "key", "value"))
        out = []
        for i in range(len(x)):
            row = []
            for h in range(heads):
                part = slice(h * size, (h + 1) * size)
                scores = [sum(a * b for a, b in zip(q[i][part], k[j][part], strict=True)) / math.sqrt(size) for j in range(len(x))]
                shares = [math.exp(s - max(scores)) for s in scores]
                row += [sum(s * v[j][h * size + c] for j, s in enumerate(shares)) / sum(shares) for c in range(size)]
            out.append(dense(f"{layer}.out", row))
        tokens = [[a + b for a, b in zip(t, o, strict=True)] for t, o in zip(tokens, out, strict=True)]
        inner = [dense(f"{layer}.down", [max(u, 0) for u in dense(f"{layer}.up", norm(f"{layer}.norm2", t))]) for t in tokens]
        tokens = [[a + b for a, b in zip(t, o, strict=True)] for t, o in zip(tokens, inner, strict=True)]
    top = [0.5 * u * (1 + math.erf(u / math.sqrt(2))) for u in dense("head1", norm("norm", tokens[0]))]
    return [1 / (1 + math.exp(-u)) for u in dense("head2", top)]


def test_peak_transformer_against_loops():
    rng = np.random.default_rng(3)
    weights = T.random_weights(16, 2, 8, seed=7)
    mz, own = rng.uniform(50, 400, (3, 5)), rng.random((3, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [0, 0, 0, 0, 0]], dtype=bool)
    precursor, mode = np.array([420.5, 99.0, 700.0]), np.array([0, 1, 2])
    got = T.PeakTransformer(weights, 4)(mz, own, mask, precursor, mode)
    for i in range(3):
        assert got[i] == pytest.approx(loops(weights, 4, mz[i], own[i], mask[i], precursor[i], mode[i]), abs=1e-9)


def test_checkpoints(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    layers = {"0": (rng.normal(size=(5, 3)), rng.normal(size=3)), "1": (rng.normal(size=(3, 2)), rng.normal(size=2))}
    path = checkpoints.save(spark, str(tmp_path / "a"), "layers", layers)
    x = rng.normal(size=(7, 5))
    want = M.Registry().load({"layers": [layers["0"], layers["1"]]})(x)
    assert np.allclose(M.Registry().load_file(spark, path)(x), want) and np.allclose(M.Registry().load_file(spark, [path, path])(x), want)
    monkeypatch.setattr(checkpoints, "MOST_VALUES", 5)
    with pytest.raises(ValueError):
        checkpoints.load(spark, path)


def test_families_in_a_row_of_words(spark):
    layout = DEFAULT.blocks_v1
    structures = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "key int, smiles string")
    makers = {"morgan2": lambda s: [[0, 31, 32, 2047] if t else None for t in s], "morgan3": lambda s: [[5] for _ in s], "maccs": lambda s: [[0, 166] if t == "x" else [] for t in s]}
    got = B.stacked(structures, makers, layout)
    rows = {r.key: r for r in got.select("key", "popcount", *(B.on_bits(F.col("fp"), *layout[n]).alias(n) for n in layout)).collect()}
    assert rows[1].popcount == 7 and rows[1].morgan2 == [0, 31, 32, 2047] and rows[1].morgan3 == [2053] and rows[1].maccs == [3072, 3238]
    assert rows[3].maccs == [] and set(rows) == {1, 3}
    with pytest.raises(Exception, match="is not in family"):
        B.stacked(structures, makers | {"maccs": lambda s: [[167] for _ in s]}, layout).collect()


def test_readers_and_writers(spark, tmp_path):
    """The engine's own schemas, and an output that is there before the real one is."""
    at = lambda name: str(tmp_path / name)
    rows = [(1, "K-1", "CC", 100.5, "[M+H]+", " Positive", [1.0, 2.0], [0.5, 1.0], "lib", 7)]
    schema = "seq long, inchikey14 string, normalized_smiles string, precursor_mz double, adduct string, ionization_mode string, ms2_mzs array<double>, ms2_normalized_intensities array<double>, ingest_lib string, other int"
    spark.createDataFrame(rows, schema).write.parquet(at("spectra"))
    got = readers.spectra(spark, at("spectra"))
    assert got.columns == ["seq", "key", "smiles", "precursor_mz", "adduct", "mode", "mzs", "intensities", "ingest_lib"]
    assert Engine(spark).build_library(got).first().mode == "positive"
    spark.createDataFrame([("m1", *rows[0])], f"molecule_id string, {schema}").drop("inchikey14", "normalized_smiles").write.parquet(at("test"))
    assert readers.spectra(spark, at("test"), test=True).first().molecule_id == "m1"
    spark.createDataFrame([("AAA-BBB-N", "CC", 30.1, "C2H6")], "inchikey string, canonical_smiles string, exact_mass double, formula string").write.parquet(at("np"))
    first = readers.structures(spark, at("np")).first()
    assert first.key == "AAA" and first.smiles == "CC"
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        writers.replaced(broken, spark.createDataFrame([("fallback",)], "id string"), at("out"))
    assert spark.read.parquet(at("out")).first().id == "fallback"
    writers.replaced(spark.range(3), spark.range(1), at("out2"))
    assert spark.read.parquet(at("out2")).count() == 3
    pool = [spark.createDataFrame(r, "key string, smiles string") for r in ([("A", "1"), ("B", "2")], [("B", "3"), ("C", "4")])]
    assert {tuple(r) for r in Engine(spark).build_pool(*pool).collect()} == {("A", "1"), ("B", "2"), ("C", "4")}


def test_dense_codes_over_ranges(spark):
    rows = spark.range(1000).selectExpr("cast(id * 7 % 311 as string) as v").union(spark.sql("SELECT cast(null as string)"))
    got = sorted((r.v, r.code) for r in R.dense_code(rows, "v", "code").collect())
    assert got == [(v, i) for i, v in enumerate(sorted({str(i * 7 % 311) for i in range(1000)}))]

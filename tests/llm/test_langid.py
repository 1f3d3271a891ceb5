"""Held-out accuracy of language identification, and what it does with unusual rows."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return langid.learn(docs.where(~langid.held_out()))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    told = langid.predict(docs, model, ["doc_id", "lang", langid.held_out().alias("held_out")]).where("held_out")
    n, right, lo, hi = told.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert n > 100 and right >= 0.98 and 0 <= lo <= hi <= 1


def test_family_comes_first(model):
    assert model.families == ["germanic", "romance"]
    assert [m for m in model.machines if m[0] == "family"] == [("family", "germanic"), ("family", "romance")]
    assert ("germanic", "de", "en") in model.machines and ("romance", "es", "fr") in model.machines


def test_unusual_rows(spark, model):
    rows = [(1, None, "a"), (2, "", "b"), (3, "123 !? \n", "c"), (4, "The and of that with. " * 20000, None), (None, "漢字かな", "d"), (6, "É", "e"), (6, "É", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in langid.predict(docs.drop("score"), model, ["doc_id"]).collect())
    assert [g[1] for g in got if g[0] in (1, 2, 3)] == ["und"] * 3 and all(g[2] == 0 for g in got if g[0] in (1, 2, 3))
    assert dict((g[0], g[1]) for g in got)[4] == "en" and len(got) == 7
    assert all(g[1] != "und" for g in got if g[0] in (0, 6))


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(empty) is None
    one = spark.createDataFrame([(1, "hello there", "en"), (2, "12", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.predict(one, None, ["doc_id"]).orderBy("doc_id").collect()] == ["und", "und"]
    assert [r.lang_pred for r in langid.predict(one, langid.learn(one), ["doc_id"]).orderBy("doc_id").collect()] == ["en", "und"]
    assert langid.predict(empty, None, ["doc_id"]).count() == 0


def test_blocks_make_no_difference(model, monkeypatch):
    import numpy as np
    import pyarrow as pa

    column = pa.array(["The quick, brown fox", None, "", "ÉTÉ à la plage", "x", "word " * 300])
    whole = langid._sums(*langid._texts(column), model.weights)
    monkeypatch.setattr(langid, "BLOCK", 7)
    cut = langid._sums(*langid._texts(column), model.weights)
    assert np.allclose(whole[0], cut[0], atol=1e-3) and np.allclose(whole[1], cut[1])


def plainly(model, text):
    """The language of a text by counting runs in Python and adding up one machine after the other."""
    import re

    if not re.search(r"[^\W\d_]", text or ""):
        return "und"
    raw = text.lower().encode()
    letters = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in raw)
    half, sums, n = langid.BINS // 2, [0.0] * len(model.machines), 0
    for size, factor, shift, first in ((2, 2654435761, 19, 0), (3, 2246822519, 18, half)):
        for i in range(len(letters) - size + 1):
            run = letters[i : i + size]
            if run.strip():
                code = 0
                for c in run:
                    code = (code * 251 + c) & 0xFFFFFFFF
                at = (((code * factor) & 0xFFFFFFFF) >> shift) % half + first
                n += 1
                for k in range(len(sums)):
                    sums[k] += float(model.weights[at, k])
    margins = [s / max(n, 1) + float(b) for s, b in zip(sums, model.biases, strict=True)]
    sure = [1 / (1 + 2.718281828459045 ** -(m * float(c))) for m, c in zip(margins, model.scales, strict=True)]
    of = {m[1]: s for m, s in zip(model.machines, sure, strict=True) if m[0] == "family"}
    family = max(model.families, key=lambda f: of.get(f, 1.0))
    votes = dict.fromkeys(model.langs[family], 0.0)
    for m, s in zip(model.machines, sure, strict=True):
        if m[0] == family and len(m) == 3:
            votes[m[1]] += s
            votes[m[2]] += 1 - s
    return max(votes, key=votes.get)


def test_against_a_plain_predictor(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    rows = docs.collect()
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert [got[r.doc_id] for r in rows] == [plainly(model, r.text) for r in rows]


def test_names_that_clash_and_dirty_labels(spark):
    rows = [(i, f"the words of text {i}", f"l{i % 7}", "x", 1.0) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.learn(docs, most_langs=3)
    assert sum(map(len, model.langs.values())) == 3
    out = langid.predict(docs, model, docs.columns, names=("__l", "__s"))
    assert out.columns == [*docs.columns, "__l", "__s"] and out.count() == 70


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """One row, repeated very often, and rows without an id: never more than the bound is learned from."""
    held = []
    monkeypatch.setattr(langid, "fit", lambda rows: held.append(rows.count()))
    same = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'same text again' as text", "'en' as lang")
    langid.learn(same.union(spark.range(50).selectExpr("id", "concat('text ', id)", "'de'")), per_lang=40)
    assert held[0] <= 80


def many_languages(rng, langs, each):
    """Texts in invented languages: of shared syllables, each language prefers its own few."""
    syllables = [a + b for a in "bdfgklmnprstv" for b in "aeiou"]
    for k in range(langs):
        own = rng.sample(syllables, 12)
        for i in range(each):
            words = ["".join(rng.choices(own, k=rng.randint(1, 3))) for _ in range(25)]
            yield k * each + i, " ".join(words), f"x{k}"


def test_a_hundred_languages(spark):
    """A machine is a task: a hundred families, each told from a bounded part of all others."""
    import random

    rows = list(many_languages(random.Random(3), 100, 24))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where("doc_id % 4 > 0"))
    assert len(model.machines) == 100
    told = langid.predict(docs.where("doc_id % 4 = 0"), model, ["lang"])
    assert told.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_machines_against_a_plain_fit(spark, monkeypatch):
    """What tasks fit is what the same descent, written out over dense rows, gives; the rest of a family is cut evenly."""
    import random

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(langid, "MOST_REST", 12)
    langs = ["de", "en", "fr", "xx"]
    rows = [(i, t, langs[int(lang[1:])]) for i, t, lang in many_languages(random.Random(4), 4, 10)]
    sample = [(lang, i % 10 + 1, b.astype("<i4").tobytes(), (s * 100).astype("<f4").tobytes()) for (i, _, lang), (b, s) in zip(rows, langid.features(pa.array([t for _, t, _ in rows])), strict=True)]
    model = langid.fit(spark.createDataFrame(sample, "lang string, place long, bins binary, shares binary"))
    assert model.machines == [("family", "germanic"), ("family", "romance"), ("family", "xx"), ("germanic", "de", "en")]
    for k, (positive, negative, upto) in enumerate([(("de", "en"), ("fr", "xx"), 6), (("fr",), ("de", "en", "xx"), 4), (("xx",), ("de", "en", "fr"), 4), (("de",), ("en",), 10)]):
        chosen = sorted((r for r in sample if r[0] in positive or (r[0] in negative and r[1] <= upto)), key=lambda r: (r[0], r[2], r[3]))
        x = np.zeros((len(chosen), langid.BINS + 1))
        x[:, -1] = 1
        for i, r in enumerate(chosen):
            x[i, np.frombuffer(r[2], "<i4")] = np.frombuffer(r[3], "<f4")
        sign = np.array([1.0 if r[0] in positive else -1.0 for r in chosen])
        weight = 15 / np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum())
        rate = 1 / (1 + 2 * (weight * (x**2).sum(axis=1)).sum())
        w = v = np.zeros(langid.BINS + 1)
        decay = np.append(np.full(langid.BINS, 0.1 / 30), 0)
        for step in range(150):
            slope = decay * v - 2 * x.T @ (weight * sign * np.maximum(0, 1 - sign * (x @ v)))
            new = v - rate * slope
            v, w = new + step / (step + 3) * (new - w), new
        assert np.allclose(model.weights[:-1, k], w[:-1] * 100, rtol=1e-4, atol=1e-6) and np.isclose(model.biases[k], w[-1])

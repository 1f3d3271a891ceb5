"""The pipeline's stages on a small table, against what each should do to it."""

import random

import corpus_pipeline as cp
from lodestone.llm import decontaminate
from pyspark.sql import functions as F


def rows():
    rng = random.Random(2)
    english, german = "the and of that with from which this have".split(), "der und die nicht ein mit sich auf für".split()
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 8)))
    prose = lambda lang, n: " ".join(rng.choice(lang) if rng.random() < 0.5 else word() for _ in range(n))
    docs = [(i, prose(*((english, 90) if i % 2 else (german, 90))), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    items = [(k, prose(english, 40)) for k in range(4)]
    docs.append((100, docs[1][1], "en", "s", 0))  # a copy
    docs.append((101, docs[2][1] + " noch etwas", "de", "s", 0))  # a near copy
    docs.append((102, prose(english, 50) + " " + items[2][1] + " " + prose(english, 30), "en", "s", 0))
    docs.append((103, prose(english, 60) + " write to ann@mail.example.com now", None, None, None))
    docs += [(104, None, "en", "s", 0), (105, "12 34 !!", "en", "s", 8), (106, "", None, "s", 0)]
    return docs, items


def test_stages(spark, tmp_path):
    docs, items = rows()
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == table.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in at.collect()} if name != "packing" else at.collect()
    everything = {d[0] for d in docs}
    assert set(kept["language"]) == everything - {104, 105, 106}
    assert kept["language"][103].lang == "en"
    assert set(kept["near duplicates"]) == set(kept["language"]) - {100, 101}
    assert set(kept["decontamination"]) == set(kept["near duplicates"]) - {102}
    assert "<EMAIL>" in kept["personal data"][103].text and "@" not in kept["personal data"][103].text
    assert all(kept["personal data"][d].text == kept["decontamination"][d].text for d in kept["decontamination"] if d != 103)
    assert {r.doc_id for r in kept["packing"]} == set(kept["decontamination"])
    assert len(cp.run(spark, str(tmp_path)).collect()) == len(kept["packing"])


def test_stages_of_nothing_and_repeated_rows(spark, tmp_path):
    docs, items = rows()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    same = spark.createDataFrame([docs[0], docs[0], docs[1]], empty.schema)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, same, str(tmp_path)).collect()) == [0, 1]


def test_contamination(spark):
    docs, items = rows()
    table = spark.createDataFrame([*docs, (None, items[0][1], None, None, None), (200, " ".join(w if k % 6 else "changed" for k, w in enumerate(items[1][1].split())), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([*items, (8, None), (9, ""), (10, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == {(102, 2), (None, 0), (200, 1)}
    assert decontaminate.contaminated(table, bench.limit(0)).count() == decontaminate.contaminated(table.limit(0), bench).count() == 0


def test_retrieval_recall_against_all_pairs(spark):
    """Candidates by TF-IDF cosine among those of plain vectors, pair by pair."""
    import numpy as np

    docs, items = rows()
    rng = random.Random(4)
    texts = [t for _, t, *_ in docs if t] + [" ".join(rng.sample(t.split(), 30)) for _, t in items]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    (space,) = decontaminate._spaces(table, bench, items, 40, 0.33, 0.5)
    found = {(t, i) for t, i, *_ in decontaminate._search(texts, space, 2.0, 0.65)}
    size = len(space.idf)
    vector = lambda words: np.bincount(space.places.of(decontaminate._hashed(words)), minlength=size) * space.idf
    want = set()
    for t, text in enumerate(texts):
        w = decontaminate.words_of(text)
        for at in range(0, len(w), decontaminate.STEP):
            v = vector(w[at : at + decontaminate.WINDOW])
            for i, (_, item) in enumerate(items):
                q = vector(decontaminate.words_of(item))
                if v @ q >= 0.4 * np.linalg.norm(v) * np.linalg.norm(q):
                    want.add((t, i))
    assert len(want & found) >= 0.9 * len(want) > 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices([b"x", b"y", b"z", b"w"], k=rng.randint(0, 12)) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == t[-1][-1]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_are_judged_one_by_one(spark, tmp_path):
    """Rows of one id with unlike texts, a copy among them, and contaminated rows without an id."""
    docs, items = rows()
    a, b, c = docs[1][1], docs[3][1], docs[5][1]
    table = spark.createDataFrame([(3, a, "en", "s", 0), (7, a, "en", "s", 0), (7, b, "en", "s", 0), (None, c, None, None, None), (None, c + " more", None, None, None)], DOCS)
    kept = sorted((r.doc_id or 0, r.text) for r in cp.near_duplicates(spark, table, str(tmp_path)).collect())
    assert len(kept) == 3 and (3, a) in kept and (7, b) in kept
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = a + " " + items[0][1]
    table = spark.createDataFrame([(None, bad, None, None, None), (None, b, None, None, None), (5, bad, "en", "s", 0), (5, c, "en", "s", 0), (6, None, None, None, None)], DOCS)
    kept = [(r.doc_id, r.text) for r in cp.decontaminated(spark, table, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(None, b), (5, c), (6, None)], key=str)


def test_clashing_columns_of_any_type(spark, tmp_path):
    docs, items = rows()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    more = "score string, lang_pred string, none int, row string, doc string, text_hash long, count int, m map<string,int>, `a.b` int"
    table = spark.createDataFrame([(*d, "x", "y", 1, "r", "d", 5, 6, {"k": 1}, 2) for d in [*docs, docs[0], docs[7], docs[7]]], f"{DOCS}, {more}")
    at, sizes = table, []
    for name, stage in cp.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == table.columns and at.schema == table.schema, name
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        sizes.append(at.count())
    assert sizes == [len(docs), len(docs) - 5, len(docs) - 6, len(docs) - 6]
    assert all(r.m == {"k": 1} and r["a.b"] == 2 for r in at.collect())


def test_labels_follow_sure_predictions(spark, tmp_path):
    """A few wrong labels among the given documents are set right, and hardly any right one is touched."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    right = {r.doc_id: r.lang for r in docs.where("lang is not null and length(text) > 300").limit(300).collect()}
    wrong = sorted(right)[:20]
    other = F.when(F.col("lang") == "en", "de").otherwise("en")
    table = docs.withColumn("lang", F.when(F.col("doc_id").isin(wrong), other).otherwise(F.col("lang")))
    got = {r.doc_id: r.lang for r in cp.languages(spark, table, str(tmp_path)).collect()}
    mended = sum(got[i] == right[i] for i in wrong)
    kept = sum(got[i] == lang for i, lang in right.items() if i not in wrong)
    assert mended >= 16 and kept >= 0.99 * (len(right) - len(wrong)), (mended, kept)

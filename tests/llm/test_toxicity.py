"""The grammar against a plain reading of its rules, held-out results, and unusual rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity as T

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return T.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def plainly(symbols, weight=2.0):
    """The weight of a sentence of symbols, rule by rule: what each word is, then what stands in each clause."""
    total, reported, since = 0.0, False, 99
    clause, clauses = [], []
    for s in symbols:
        if s == T.NEGATION:
            since = 0
            clause.append(("o", 1.0))
            continue
        negated = since < T.REACH
        since += 1
        if s in T.COMMA + T.END:
            since = 99
            reported = reported and s == T.COMMA
            clauses.append(clause)
            clause = []
        elif s == T.REPORT:
            reported = True
            clause.append(("o", 1.0))
        else:
            share = T.NEGATED if negated else T.REPORTED if reported else 1.0
            clause.append((s, share if s in T.INSULT + T.THREAT else 1.0))
    for c in [*clauses, clause]:
        targets = [k for k, (s, _) in enumerate(c) if s == T.TARGET]
        last = -1
        for t in [*targets, None]:
            before = c[last + 1 : t]
            for s, share in before:
                total += share * weight if s == T.INSULT else 0.0
            if last < 0:
                if t is not None:
                    total += T.TARGETED * max((x for s, x in before if s == T.INSULT), default=0.0)
                    total += T.THREATENING * max((x for s, x in before if s == T.THREAT), default=0.0)
            else:
                total += sum(T.TARGETED * x if s == T.INSULT else T.THREATENING * x for s, x in before if s in T.INSULT + T.THREAT)
            last = t if t is not None else last
    return total


def weighed(symbols, weight=2.0):
    g = T.grammar()
    state, total = g.start, 0.0
    for s in symbols:
        state, (share, more) = g.step[state, s]
        total += share * weight + more
    return total


def test_composition_follows_the_rules():
    alphabet = T.OTHER + T.INSULT + T.THREAT + T.TARGET + T.NEGATION + T.REPORT + T.COMMA + T.END
    few = ["".join(s) for n in range(5) for s in itertools.product(T.INSULT + T.TARGET + T.NEGATION + T.COMMA, repeat=n)]
    rng = random.Random(4)
    for s in [*few, *("".join(rng.choices(alphabet, k=rng.randint(1, 14))) for _ in range(3000))]:
        assert weighed(s) == pytest.approx(plainly(s)), s


def test_clauses_and_not_words():
    score = lambda text: T.score_of(T.Scorer(T.listed()).clauses(text), len(text.split()), T.listed())
    assert score("You are an idiot.") > 0.5 > score("An idiot.")
    assert score("You are not an idiot.") < 0.2 and score("She said that you are an idiot.") < 0.35
    assert score("I will kill you.") > 0.5 > score("Kill the process.")
    assert score("You, an idiot") == score("An idiot") and score("An IDIOT### you!!") > 0.5
    assert score("nothing here") == score("") == T.score_of([], 0, T.listed())
    assert T.Scorer(T.listed()).clauses("superidiotic") == [] and len(T.Scorer(T.listed()).clauses("you moron, you loser; fine. trash")) == 3


def test_held_out(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    told = T.predict(docs, model, [F.col("doc_id"), T.held_out().alias("held_out")]).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r.n for r in told.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    # What is missed is junk whose marked words were overwritten.
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.9 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) >= 0.99
    lo, hi, same = told.agg(F.min("score"), F.max("score"), F.min(((F.col("score") >= 0.5).cast("int") == F.col("predicted")).cast("int"))).first()
    assert 0 <= lo <= hi <= 1 and same == 1


def test_learns_nothing_from_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.learn(docs, labels), T.learn(docs.withColumn("lang", F.lit("xx")), turned)
    assert (a.words, a.prefixes, a.expected) == (b.words, b.prefixes, b.expected)


def test_stems_and_copies(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("bdgklmnprst", k=1) + rng.choices("aeiou", k=1) + rng.choices("bdgklmnprst", k=1) + rng.choices("aeiou", k=2)) for _ in range(300)]
    text = lambda: " ".join(rng.choices(words, k=60))
    docs, labels = [], []
    for k in range(1500):
        toxic = k % 6 == 0
        docs.append((k, text() + (" vrokul" + rng.choice(["ab", "eb", "ib", "ob", "ub"]) if toxic else "")))
        labels.append((k, int(toxic)))
    seen = text() + " zzyzx quuxes"  # one toxic text with 200 copies proves nothing about its words
    docs += [(k, seen + f" {k}") for k in range(2000, 2200)]
    labels += [(k, 1) for k in range(2000, 2200)]
    m = T.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("vrokul".startswith(p) for p in m.prefixes) and "zzyzx" not in m.words and not any("quuxes".startswith(p) for p in m.prefixes)


def test_unusual_rows(spark, model):
    long = "fine words here. " * 200_000 + "you idiot"
    rows = [(1, None, 0.1), (2, "", 0.2), (3, long, 0.3), (None, "You are a worthless idiot", 0.4), (5, "ok", 0.5), (5, "ok", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `sco.re` double")
    got = T.predict(docs, model)
    assert got.columns == ["doc_id", "text", "sco.re", "score", "predicted", "n_clauses"] and got.count() == 6
    by = {r.doc_id: r for r in got.drop("text").collect()}
    assert by[1].score == by[2].score == T.score_of([], 0, model) and by[1].predicted == 0 and by[None].predicted == 1 and by[3].n_clauses == 1
    assert T.predict(docs.withColumnRenamed("sco.re", "score"), model, names=("toxicity", "is_toxic", "clauses")).columns[-3:] == ["toxicity", "is_toxic", "clauses"]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.learn(docs, labels) == T.listed() and T.predict(docs, T.listed()).collect() == []
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0), (3, 0), (4, 7)], "doc_id long, toxic int")
    assert T.learn(docs, some) == T.listed()
    both = spark.createDataFrame([(1, "you idiot"), (3, "hello"), (3, None), (6, "hello"), (7, "hello")], "doc_id long, text string")
    assert T.learn(both, some).prefixes == {}

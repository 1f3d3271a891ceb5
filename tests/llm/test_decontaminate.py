"""Contamination with the defaults of production, against the LCS and answer rule applied to every passage."""

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from lodestone.llm import decontaminate as D

SF = "/root/testdata/sf0.1"


def column(name, n=None):
    return [t for t in pq.read_table(f"{SF}/{name}.parquet", columns=["text"]).column(0).to_pylist() if t][:n]


def accepted(item, words, part=0.5, whole=0.75, answer=0.6):
    """Whether any passage's neighbourhood in words holds the item by the rule alone; no cosine is asked for."""
    own, closing, need = D.words_of(item), D._answer(item), Counter(D.words_of(item))
    for start in range(0, len(words), D.STEP):
        near = words[max(start - len(own), 0) : start + D.WINDOW + len(own)]
        # No subsequence is longer than the words in common.
        if sum((Counter(w for w in near if w in need) & need).values()) < part * len(own):
            continue
        lcs = D.common_subsequence(own, near) / len(own)
        if lcs >= whole or lcs >= part and len(closing.intersection(near)) >= answer * len(closing):
            return True
    return False


def paraphrase(item, rng, keep):
    """The item with only so many of its words, others in place of the rest; its answer stays more often."""
    words, closing = item.split(), D._answer(item)
    return " ".join(w if rng.random() < (0.85 if closing.issuperset(D.words_of(w)) else keep) else "".join(rng.choices("aeiourstlnm", k=6)) for w in words)


def planted(items, docs, rng, change):
    """Documents with one item each in their midst, by change."""
    out = []
    for k, item in enumerate(items):
        words = docs[k % len(docs)].split()
        at = rng.randint(0, len(words))
        out.append(" ".join([*words[:at], change(item), *words[at:]]))
    return out


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}


def long_docs():
    return [t for t in column("documents", 3000) if len(t.split()) > 150][:600]


def test_paraphrases_in_long_documents(spark):
    rng = random.Random(5)
    items = column("benchmark")
    texts = planted(items, long_docs(), rng, lambda item: paraphrase(item, rng, 0.5))
    want = {(k, k) for k, item in enumerate(items) if accepted(item, D.words_of(texts[k]))}
    got = found(spark, texts, items)
    print(f"recall of {len(want)} paraphrases, {len(items)} items: {len(want & got) / len(want):.3f}")
    assert len(want) >= 100 and len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("n", [200, 1000, 2000, 4000])
def test_copies_whatever_the_size_of_the_benchmark(spark, n):
    """The given items, filled up with passages of 15 to 59 words cut from documents."""
    rng = random.Random(6)
    items, texts = column("benchmark"), [t.split() for t in column("documents")]
    while len(items) < n:
        words = rng.choice(texts)
        at, size = rng.randrange(len(words)), rng.randint(15, 59)
        if len(words) - at >= size:
            items.append(" ".join(words[at : at + size]))
    some = rng.sample(range(n), 200)
    got = found(spark, planted([items[k] for k in some], long_docs(), rng, lambda item: item), items)
    recall = sum((d, k) in got for d, k in enumerate(some)) / len(some)
    print(f"recall of verbatim copies, {n} items: {recall:.3f}")
    assert recall >= 0.99


@pytest.mark.parametrize(("n", "change"), [(500, "replaced"), (2000, "replaced"), (4000, "replaced"), (2000, "dropped")])
def test_changed_copies_whatever_the_size_of_the_benchmark(spark, n, change):
    """A sixth of the words replaced, or a fifth dropped; recall of what the rule accepts."""
    rng = random.Random(9)
    items, texts = column("benchmark"), [t.split() for t in column("documents")]
    while len(items) < n:
        words = rng.choice(texts)
        at, size = rng.randrange(len(words)), rng.randint(15, 59)
        if len(words) - at >= size:
            items.append(" ".join(words[at : at + size]))
    some = rng.sample(range(n), 200)
    altered = {
        "replaced": lambda item: " ".join(w if rng.random() > 1 / 6 else "".join(rng.choices("aeiourstlnm", k=6)) for w in item.split()),
        "dropped": lambda item: " ".join(w for w in item.split() if rng.random() > 1 / 5),
    }[change]
    planted_texts = planted([items[k] for k in some], long_docs(), rng, altered)
    want = {(d, k) for d, k in enumerate(some) if accepted(items[k], D.words_of(planted_texts[d]))}
    got = found(spark, planted_texts, items)
    print(f"recall of {len(want)} copies with words {change}, {n} items: {len(want & got) / len(want):.3f}")
    assert len(want) >= 150 and len(want & got) >= 0.9 * len(want)


def test_short_items_in_long_documents(spark):
    """Items of one to seven words, common ones too: each document that has the run of words, and no other."""
    rng = random.Random(7)
    texts = long_docs()[:200]
    items = [" ".join(words[at : at + n]) for n in range(1, 8) for words in (rng.choice(texts).split(),) for at in (rng.randrange(len(words) - n),)]
    items = [t for t in items if D.words_of(t)]
    words = [D.words_of(t) for t in texts]
    want = {(d, k) for k, own in enumerate(map(D.words_of, items)) for d, w in enumerate(words) if any(w[i : i + len(own)] == own for i in range(len(w) - len(own) + 1))}
    assert len(want) >= len(items) and found(spark, texts, items) == want


def test_short_item_of_the_commonest_words(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    texts = [" ".join("of the" if k % 20 == 7 else word() for k in range(200)) for _ in range(40)]
    assert found(spark, texts, ["Of the", "the of"]) == {(d, 0) for d in range(40)}


def test_blocks_and_parts_make_no_difference(spark, monkeypatch):
    """A benchmark that is taken in parts and searched in blocks, against one piece."""
    rng = random.Random(12)
    items = column("benchmark", 30)
    texts = planted(items, long_docs(), rng, lambda item: paraphrase(item, rng, 0.7))
    whole = found(spark, texts, items)
    monkeypatch.setattr(D, "BLOCK_ITEMS", 4)
    assert found(spark, texts, items) == whole and len(whole) > 10
    monkeypatch.setattr(D, "MOST_ITEMS", 9)
    assert len(found(spark, texts, items) ^ whole) <= 1  # weights of words outside a part are shared ones


def topical(rng, topics=10, concepts=100):
    """Of each topic, its concepts, each with two words for it; and common words."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    return [[(word(), word()) for _ in range(concepts)] for _ in range(topics)], [word()[:3] for _ in range(30)]


def spoken(rng, topic, common, n, share=0.65):
    """n words: common ones, or a concept of the topic by either of its words."""
    return [rng.choice(common) if rng.random() < share else rng.choice(rng.choice(topic)) for _ in range(n)]


def test_synonyms_that_only_the_latent_space_finds(spark):
    """Paraphrases that keep common words and the answer, and say each rarer word by its synonym."""
    rng = random.Random(21)
    topics, common = topical(rng)
    other = {w: v for topic in topics for a, b in topic for w, v in ((a, b), (b, a))}
    corpus = [" ".join(spoken(rng, topics[k % len(topics)], common, 96)) for k in range(3000)]
    items, changed = [], []
    for k in range(60):
        body, answer = spoken(rng, topics[k % len(topics)], common, 40), rng.choices(common, k=6)
        items.append(" ".join(body) + ". " + " ".join(answer) + ".")
        changed.append(" ".join(other.get(w, w) for w in body) + ". " + " ".join(answer) + ".")
    docs = corpus + [corpus[7 * k].split(" ", 48)[-1] + " " + t for k, t in enumerate(changed)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rule = {(len(corpus) + k, k) for k, item in enumerate(items) if accepted(item, D.words_of(docs[len(corpus) + k]), part=0.65)}
    lexical = {(r.doc_id, r.item_id) for r in D.contaminated(table, bench, rank=0).collect()}
    both = {(r.doc_id, r.item_id) for r in D.contaminated(table, bench).collect()}
    print(f"of {len(rule)} paraphrases: lexical {len(rule & lexical)}, latent too {len(rule & both)}, others {len(both - rule)}")
    assert lexical <= both and len(rule) >= 25
    assert len(rule & lexical) <= 0.1 * len(rule) and len(rule & both) >= 0.9 * len(rule)


def test_directions_against_a_full_decomposition():
    """The sketch's leading directions span those of the matrix, with its singular values."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((60, 5)) @ rng.standard_normal((5, D.HASHED))
    vectors, values, floor = D._directions(a.T @ (a @ D._drawn(12)), 4)
    want = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(values, want[:4]) and np.isclose(floor, want[4]) and vectors.shape == (D.HASHED, 4)
    assert np.allclose(np.linalg.norm(a @ vectors, axis=0), values)


def test_sketch_is_the_product(spark):
    """The summed sketch against one dense matrix of all passages, empty and null texts among them."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=rng.randrange(150))) for _ in range(40)] + [None, "", "?!"]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    places = D.Places([b"alpha", b"beta"])
    idf = np.linspace(0.5, 2, places.size)
    rows = []
    for t in texts:
        words = D.words_of(t)
        for at in range(0, len(words), D.WINDOW):
            own = places.of(D._hashed(words[at : at + D.WINDOW]))
            rows.append(np.bincount(places.folded()[own], weights=idf[own], minlength=D.HASHED) / np.sqrt((idf[own] ** 2).sum()))
    a = np.stack(rows)
    assert np.allclose(D._sketch(table, places, idf, 6), a.T @ (a @ D._drawn(6)), rtol=1e-4, atol=1e-4)


def test_bounds_lose_no_candidate(spark):
    """Candidates behind bounds against every passage multiplied with every item."""
    items, texts = column("benchmark", 40), long_docs()[:120]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    (space,) = D._spaces(table, bench, list(enumerate(items)), 0, 0.28, 0.5)
    got = {(t, i, s): c for t, i, c, _, s, _ in D._search(texts, space, 2.0, 0.65)}
    want = {}
    for t, text in enumerate(texts):
        words = space.places.of(D._hashed(D.words_of(text)))
        for i, item in enumerate(items):
            told = space.places.of(D._hashed(D.words_of(item)))
            for k in range(0, len(told), D.WINDOW):
                own = np.bincount(told[k : k + D.WINDOW], minlength=len(space.idf)) * space.idf
                own *= space.idf / np.linalg.norm(own)
                for at in range(0, len(words), D.STEP):
                    near = words[at : at + D.WINDOW]
                    cosine = own[near].sum() / np.sqrt((space.idf[near] ** 2).sum())
                    if cosine >= space.least[i] + 1e-5:
                        want[t, i, at] = min(max(cosine, want.get((t, i, at), 0)), 1.0)
    assert want and set(want) <= set(got) and all(abs(got[k] - c) < 1e-4 for k, c in want.items())


def test_nulls_clashing_columns_and_a_very_long_text(spark):
    item = column("benchmark", 1)[0]
    long = " ".join(t for t in column("documents", 400))
    docs = spark.createDataFrame([(1, long + " " + item, "x", 0.5), (None, item, None, None), (2, None, "y", None), (3, "", "z", 1.0)], "doc_id long, text string, item_id string, cosine double")
    bench = spark.createDataFrame([(7, item, "a"), (None, None, "b"), (8, "", "c")], "item_id long, text string, doc_id string")
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()} == {(1, 7), (None, 7)}

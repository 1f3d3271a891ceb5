"""Components against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                x, y = root(i), root(j)
                least[max(x, y)] = min(x, y)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted((d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 or not texts:
            words = rng.choices(vocabulary, k=int(rng.lognormvariate(3.2, 1)) + 1)
            if rng.random() < 0.3:
                words[1:1] = common
        else:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[at], rng.choice(vocabulary)]])
            words = words or ["w0"]
        texts.append(" ".join(words))
    return [(i * 3 + 1, t.upper() if rng.random() < 0.1 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 1, 90)])
def test_against_all_pairs(spark, seed, words, percent):
    rows = [*corpus(seed), (2, None), (5, ""), (8, " \t\n"), (11, "one"), (14, "ONE"), (17, "one two"), (20, "one\xa0two"), (23, "x " * 5000)]
    got = jaccard.components_by_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Rule(words, percent)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, words, percent)


@pytest.mark.parametrize("block", [4096, 37])
def test_a_large_group_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(9)
    root = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(root)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"u{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = jaccard.components_by_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Rule(4, 85)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 85)


def test_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f", "x"), (4, "a b c d e f", None), (4, "a b c d e f", "y"), (9, "q", "z"), (None, None, None)]
    got = jaccard.components_by_jaccard(spark.createDataFrame(rows, "doc_id long, text string, node string"), jaccard.Rule(4, 85)).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in got if r.n_shingles) == [(0, 3, 4), (4, 3, 4), (4, 3, 4), (9, 1, 9)]
    assert jaccard.components_by_jaccard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_never_lose_a_link():
    # What two sets within the bound offer always meets, whatever their sizes.
    rng = random.Random(3)
    import numpy as np

    rule = jaccard.Rule(4, 85)
    for _ in range(1500):
        n = rng.choice([1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 17, 18, 26, 27, 40, 41, 60, 90, 150, 400])
        base = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        add, drop = rng.randint(0, n // 5 + 1), rng.randint(0, n // 6 + 1)
        other = np.unique(np.concatenate([rng.sample(list(base), max(n - drop, 1)), [np.uint64(rng.getrandbits(64)) for _ in range(add)]]).astype(np.uint64))
        both = len(np.intersect1d(base, other))
        if 100 * both >= 85 * (len(base) + len(other) - both):
            assert set(jaccard.offered(base, rule, {})) & set(jaccard.offered(other, rule, {}))


@pytest.mark.parametrize("task_links", [1_000_000, 3])
def test_components_of_paths_stars_and_loops(spark, task_links):
    """In one task, and by turns of stars where there are more links than one task takes."""
    from lodestone.llm.components import components, least_labels

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(201, 240)] + [(300, 300), (None, 4), (5, None), (-7, 12), (401, 400), (400, 401)]
    edges += [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)]
    rng.shuffle(edges)
    least = {}

    def root(i):
        while least.setdefault(i, i) != i:
            i = least[i]
        return i

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root(u), root(v)
            least[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(5), task_links=task_links)
    assert {r.node: r.component for r in got.collect()} == {i: root(i) for i in least}
    empty = spark.createDataFrame([], "u long, v long")
    assert components(empty, task_links=task_links).count() == 0
    import numpy as np

    assert [x.tolist() for x in least_labels(np.array([3, 9]), np.array([9, 1]))] == [[1, 3, 9], [1, 1, 1]]


def near_copies(n, seed=11):
    """One text with a word changed here and there, many times over, and some strangers."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = list(base)
        words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    return rows + [(n + i, " ".join(f"s{i}_{k}" for k in range(30))) for i in range(20)]


def test_large_groups_are_split(spark, monkeypatch):
    """Hot keys, and buckets of several blocks: the same components as in one piece."""
    monkeypatch.setattr(jaccard, "HOT_NODES", 64)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = near_copies(300)
    got = jaccard.components_by_jaccard(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Rule(4, 85)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 4, 85)


def test_later_copies_against_components(spark):
    rows = [*corpus(5, 120), (1, "same id other text entirely here"), (None, "no id " * 9), (None, "no id " * 9 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = docs.selectExpr("doc_id as d", "text", "xxhash64(text) as h")
    later = {(r.doc_id, r.text) for r in jaccard.later_copies(docs, jaccard.Rule(5, 80)).join(told, F.expr("text_hash <=> h and doc_id <=> d")).collect()}
    ids = [(i, t) for i, (_, t) in enumerate(rows)]
    least = {i: c for i, _, c in brute(ids, 5, 80)}
    first = {}
    for i, (doc, text) in enumerate(rows):
        if least[i] != i or any(c == i and j != i for j, c in least.items()):
            first.setdefault(least[i], []).append((doc is None, doc or 0, doc, text))
    for members in first.values():
        kept = {(d, t) for _, _, d, t in members} - later
        assert len(kept) == 1 and min(m[:2] for m in members) == (next(iter(kept))[0] is None, next(iter(kept))[0] or 0)
    assert len(later) == sum(len({m[2:] for m in g}) - 1 for g in first.values())

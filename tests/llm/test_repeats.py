"""Removal of repeats against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import blocks, repeats, suffix_family, suffixes


def brute_words(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def gone_of(texts, length):
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    for _, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield gone


def brute_bytes(rows, length, short=None):
    """The last column is the bytes in repeats of at least short bytes."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (d, t), gone, brief in zip(texts, gone_of(texts, length), gone_of(texts, short or min(256, length)), strict=True):
        spans = int((np.diff(gone[:-1].astype(int), prepend=0) > 0).sum())
        kept = hashlib.sha256(bytes(b for i, b in enumerate(t) if not gone[i])).hexdigest()
        out.append((d, len(t), int(gone.sum()), spans, kept, int(brief.sum())))
    return out


def corpus(seed, n, alphabet):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(alphabet, k=rng.randint(5, 90))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(alphabet, k=rng.randint(1, 60)))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            s = rng.choice(shared).split()
            a = rng.randrange(len(s))
            parts.append(" ".join(s[a : a + rng.randint(1, 80)]))
            parts.append(" ".join(rng.choices(alphabet, k=rng.randint(0, 20))))
        if rows and rng.random() < 0.15:
            parts = [rng.choice(rows)[1]]
        rows.append((i * 2, " ".join(parts)))
    same = "la " * 300
    return [*rows, (1, None), (3, ""), (5, "  \n "), (7, same), (None, rows[0][1]), (9, "x"), (9, "x"), (11, rows[3][1]), (11, rows[3][1])]


def order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("seed", "window", "hot"), [(1, 35, 20_000), (2, 8, 20_000), (3, 5, 20_000), (4, 1, 20_000), (5, 35, 1), (6, 8, 2)])
def test_words_against_all_windows(spark, seed, window, hot):
    """hot: the number of surroundings of a block beyond which windows are met by fingerprint."""
    rows = corpus(seed, 150, [f"w{i}é" for i in range(40)])
    got = blocks.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window, hot).collect()
    assert order(got) == order(brute_words(rows, window))


@pytest.mark.parametrize(("seed", "length", "short", "hot"), [(1, 400, None, 20_000), (2, 60, None, 20_000), (3, 17, None, 20_000), (4, 90, 40, 20_000), (5, 90, 40, 2), (6, 400, 100, 1)])
def test_bytes_against_all_windows(spark, seed, length, short, hot):
    """hot: the number of contexts of a gram beyond which windows are met by fingerprint."""
    rows = corpus(seed, 120, [f"w{i}é" for i in range(30)])
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, short, hot).collect()
    assert order(got) == order(brute_bytes(rows, length, short))


@pytest.mark.parametrize(("seed", "batches"), [(7, 2), (8, 5)])
def test_growing_index_against_all_windows(spark, tmp_path, seed, batches):
    """Batches that are added one by one, the index being opened anew for each, give what one batch of all gives."""
    rows = corpus(seed, 100, [f"w{i}é" for i in range(30)])
    rng = random.Random(seed)
    rng.shuffle(rows)
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), batches - 1)), len(rows)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        index = suffixes.SuffixIndex(spark, str(tmp_path / "index"), 90, 40)
        index.add(spark.createDataFrame(rows[lo:hi], "doc_id long, text string"))
        assert order(index.results().collect()) == order(brute_bytes(rows[:hi], 90, 40))
    index.add(spark.createDataFrame([], "doc_id long, text string"))
    assert order(index.results().collect()) == order(brute_bytes(rows, 90, 40))


def common_prefix(a, i, b, j):
    k = 0
    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("each", [1, 3, 50])
def test_family_against_all_pairs(each):
    """Longest matches of starts at equal places from the anchor, whatever the batches."""
    rng = random.Random(each)
    for _ in range(60):
        rows = []
        for i in range(rng.randint(1, 25)):
            n = rng.randint(1, 14)
            rows.append((rng.randint(0, 3), rng.randrange(n), [rng.randint(1, 3) for _ in range(n)], i, rng.randint(1, n)))
        want, got = {}, {}
        for group, left, text, i, starts in rows:
            got[i] = np.zeros(starts, dtype=int)
            want[i] = [max([common_prefix(text, s, t, s - left + m) for g, m, t, j, _ in rows if g == group and j != i and 0 <= s - left + m < len(t)], default=0) for s in range(starts)]
        family = suffix_family.Family()
        for at in range(0, len(rows), each):
            part = sorted(rows[at : at + each])
            sizes = np.array([len(r[2]) for r in part], np.int64)
            column = lambda k, kind: np.array([r[k] for r in part], kind)  # noqa: B023, E731
            family.add(suffix_family.Segments(column(0, np.uint64), column(3, np.int64), column(3, np.int64), column(1, np.int32), sizes.astype(np.int32), column(4, np.int32), np.cumsum(sizes) - sizes, np.concatenate([np.array(r[2], "u1") for r in part])))
        for segments, best in family.found:
            ends = np.cumsum(segments.starts)
            for i, end, n in zip(segments.place.tolist(), ends.tolist(), segments.starts.tolist(), strict=True):
                got[i] = np.maximum(got[i], best[end - n : end])
        assert {i: b.tolist() for i, b in got.items()} == want
        assert sum(map(len, family.levels)) == len(rows) and len(family.levels) <= len(rows).bit_length()


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert blocks.remove_repeats(empty).count() == suffixes.remove_repeats(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, batch int, k int")
    assert blocks.remove_repeats(docs).count() == suffixes.remove_repeats(docs).count() == 1


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [2**64 - 1], np.sort(rng.integers(0, 2**63, 500).astype(np.uint64))):
        values = np.array(values, dtype=np.uint64)
        assert np.array_equal(repeats.unpacked(repeats.packed(values)), values)


def test_fingerprints_that_meet():
    """Both halves have to be equal; few different values make many halves agree alone."""
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(40):
        own = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (rng.integers(0, 60), 2))})
        rows.append(own)
    halves = [(np.array([a for a, _ in own], np.uint64), np.array([b for _, b in own], np.uint64)) for own in rows]
    seen = Counter(x for own in rows for x in own)
    assert [m.tolist() for m in repeats.meet_prints(halves)] == [[seen[x] > 1 for x in own] for own in rows]
    assert repeats.meet_prints([]) == []


@pytest.mark.parametrize("piece", [100_000, 7])
def test_equal_rows_are_worked_on_once(spark, monkeypatch, piece):
    """Of very many equal rows (ids null, given, and texts null), two meet in a batch; all are given back."""
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(5)
    text = " ".join(rng.choices([f"w{i}é" for i in range(30)], k=60))
    few = [(i, " ".join(rng.choices([f"w{i}é" for i in range(30)], k=30)) + (text if i % 3 == 0 else "")) for i in range(12)]
    rows = [*few, *[(None, text)] * 5000, *[(4, text + " x")] * 40, *[(None, None)] * 30, *[(None, "")] * 3, (5, few[3][1]), (5, few[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    keyed, _, _, several = repeats.dealt(docs)
    kept = keyed.groupBy("doc_id", "text").agg(F.count("*").alias("rows"), F.sum("times").alias("times")).collect()
    assert several and max(r.rows for r in kept) == 2 and sum(r.times for r in kept) == len(rows)
    assert {(r.doc_id, r.text): r.times for r in kept} == dict(Counter(rows))
    once = [r for r, n in Counter(rows).items() for _ in range(min(n, 2))]
    for got, brute in ((suffixes.remove_repeats(docs, 90, 40), brute_bytes(once, 90, 40)), (blocks.remove_repeats(docs, 8), brute_words(once, 8))):
        want = Counter()
        result = {}
        for row, found in zip(once, brute, strict=True):
            result[row] = found
        for row, n in Counter(rows).items():
            want[result[row]] += n
        assert Counter(tuple(r) for r in got.collect()) == want

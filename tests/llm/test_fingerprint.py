"""Fingerprints against what is computed one text at a time."""

import hashlib
import random

import pytest

from lodestone.llm import fingerprint as fp


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        a, b, c = fp.of_text(text), fp.of_text(changed), fp.of_text(following)
        out.append((doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), a.text(), b.text(), a.likeness(b), a.likeness(c)))
    return out


def check(spark, rows):
    got = [tuple(r) for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3])
    assert sorted(got, key=key) == sorted(brute([r[:2] for r in rows]), key=key)
    return got


def test_against_one_at_a_time(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "漢字", "x"]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(rng.randint(1, 7))) for _ in range(90)]
    rows = [(i * 7, t, "s") for i, t in enumerate(texts)]
    check(spark, [*rows, (None, "no id", "s"), (None, None, None), (21, texts[0], "s"), (21, texts[1], "s"), (9999, None, "s"), (10000, "", "s"), (10001, "word " * 40000, "s")])
    check(spark, [(1, "only one\nrow of text", "s")])
    check(spark, [(5, "same", "s"), (5, "same", "s"), (5, "other", "s")])


def test_empty_table(spark):
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_of_paragraphs_and_increments():
    a, b, c = "one two", "three four five", "six"
    assert fp.of_paragraphs([a, b, c]).text() == fp.of_paragraphs([c, a, b]).text()
    assert (fp.of_paragraphs([a, b]) + fp.of_paragraphs([c])).text() == fp.of_paragraphs([a, b, c]).text()
    assert (fp.of_paragraphs([a, b, c]) - fp.of_paragraphs([b])).text() == fp.of_paragraphs([a, c]).text()
    assert fp.Print.parse(fp.of_text(b).text()).text() == fp.of_text(b).text()
    assert fp.of_text("a b").text() != fp.of_text("b a").text() != fp.of_text("a b\n").text()


def test_edits_are_nearer_than_strangers(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=200)), "s") for i in range(60)]
    got = check(spark, rows)
    assert min(r[5] for r in got) > 0.5 > 0.4 > max(r[6] for r in got)


def exact_likeness(a, b):
    """The cosine of the multisets of pairs of neighbouring words, paragraph by paragraph."""
    from collections import Counter

    def pairs(text):
        found = Counter()
        for paragraph in text.split("\n"):
            words = paragraph.split()
            found.update(zip([None, *words], words, strict=False))
        return found

    p, q = pairs(a), pairs(b)
    dot = sum(n * q[k] for k, n in p.items())
    return dot / (sum(n * n for n in p.values()) * sum(n * n for n in q.values())) ** 0.5


@pytest.mark.parametrize("times", [16_000, 20_000, 80_000, 400_000])
def test_long_repetitive_texts(times):
    text, following = "a b " * times, "c d " * times
    changed = fp.edited(text, following)
    got = fp.of_text(text).likeness(fp.of_text(changed))
    assert abs(got - exact_likeness(text, changed)) < 0.15
    assert fp.of_text(text).likeness(fp.of_text(following)) < 0.4


def test_likeness_against_multisets():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(40):
        a = " ".join(rng.choices(vocabulary, k=rng.randint(20, 400)))
        b = fp.edited(a, " ".join(rng.choices(vocabulary, k=400)))
        assert abs(fp.of_text(a).likeness(fp.of_text(b)) - exact_likeness(a, b)) < 0.3


def test_rows_of_one_id_and_clashing_columns(spark):
    rows = [(4, f"text {i % 7} of many", "s") for i in range(300)] + [(None, f"other {i}", "s") for i in range(100)]
    check(spark, rows)
    docs = spark.createDataFrame([(1, "a", 1, 2, 3)], "doc_id long, text string, k int, range int, before int")
    assert fp.fingerprints(docs).count() == 1

"""Ids, packing, the store and unigram counts against the tokenizers library."""

import random
import zlib

import numpy as np
import pytest

from lodestone.llm import packing, token_store, tokens, unigram

ALPHABET = [" ", "\n", "\t", "a", "B", "é", "1", ",", ".", "'s", "\xa0", "　", "***", "-", "_", "²", "漢", "\x00", "\r", "😀", "don't", "it's", " ", "<|endoftext|>", "▁", "the"]


def texts(n, seed=1, longest=14):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(1, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_running_text(library):
    encoder = tokens.PieceEncoder(tokens.default_vocabulary(), keep=200)
    for text in texts(4000):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(library, text), repr(text)
    assert encoder.encode(None) == encoder.encode("") == b""


ROWS = [(7, "one two three", "x"), (3, None, None), (5, "", "y"), (5, "again", "y"), (5, "again", "y"), (None, "no id", "z"), (9, "word " * 9000, "z"), *((100 + i, t, "t") for i, t in enumerate(texts(120, 2, 40)))]


def in_order():
    return sorted(((d, t or "") for d, t, _ in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_store_round_trip(spark, library, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start string")
    path = token_store.write_store(docs, str(tmp_path / "store"), end_id=0)
    want, start = [], 0
    for doc, text in in_order():
        raw = np.array([*plain(library, text), 0], dtype="<u4").tobytes()
        want.append((doc, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    got = sorted((tuple(r) for r in token_store.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    assert token_store.read_document(spark, path, 9) == [[*plain(library, "word " * 9000), 0]]
    assert token_store.read_document(spark, path, 5) == [[0], [*plain(library, "again"), 0], [*plain(library, "again"), 0]]
    assert token_store.read_document(spark, path, 4) == []


def test_store_of_nothing(spark, tmp_path):
    path = token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "store"))
    assert token_store.read_digests(spark, path).count() == 0


def test_packing_covers_every_id_once(spark, library):
    rows = packing.pack_documents(spark.createDataFrame(ROWS, "doc_id long, text string, offset string").repartition(2)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {r[0] for r in ROWS}
    for doc, text in in_order():
        if doc == 5:
            continue
        ids = [*plain(library, text), 1]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_best_fit_takes_the_tightest_window():
    tree = packing.CapacityTree(10)
    for room, window in ((9, 0), (4, 1), (6, 2)):
        tree.add(room, window)
    assert [tree.take(5), tree.take(3), tree.take(7), tree.take(1)] == [(6, 2), (4, 1), (9, 0), None]


@pytest.mark.parametrize("seed", range(5))
def test_packing_pads_little(seed):
    rng = random.Random(seed)
    lengths = [int(rng.lognormvariate(6, 1.3)) + 1 for _ in range(800)]
    pieces = packing.pack(lengths, 2048)
    used = {}
    for doc, start, length, sequence, offset in pieces:
        assert used.get(sequence, 0) == offset
        used[sequence] = offset + length
    assert sum(p[2] for p in pieces) == sum(lengths)
    padding = sum(2048 - n for n in used.values() if n & (n - 1))
    assert padding <= 0.002 * sum(lengths)


def test_unigram_counts_equal_the_library():
    from tokenizers import Tokenizer, models

    pieces, _ = unigram.vocabulary(unigram.default_model())
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces], 0, True))
    counter = unigram.Counter.of(unigram.default_model())
    for text in texts(3000, 4):
        want = len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids)
        assert counter.count(text) == want, repr(text)


def test_unigram_ties_take_the_earlier_start():
    # ab|c and a|bc both score -2: the piece that starts first stays.
    from tokenizers import Tokenizer, models

    pieces = [("▁", -1.0), ("a", -1.0), ("bc", -1.0), ("ab", -1.0), ("c", -1.0), ("abc", -2.0), ("d", -1.0), ("cd", -2.0), ("▁a", -2.0)]
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    counter = unigram.Counter(pieces, bytes_known=False)
    for text in ("abc", "abcd", "abcabcd", "xyabc", "a xy bcd", "xxabxx"):
        assert counter.count(text) == len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids), text


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "the word", "c"), (3, "the word", "c"), (None, "x", "d")], "doc_id long, text string, n_tokens string")
    rows = unigram.token_counts(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars, r.n_tokens > 0) for r in rows) == [(0, 1, True), (1, 0, False), (2, 0, False), (3, 8, True), (3, 8, True)]


def test_counts_and_pieces_among_clashing_columns(spark):
    """Columns of the results' names, repeated rows and null ids."""
    rows = [(1, "some words here", 1, 2, "x"), (1, "some words here", 1, 2, "x"), (None, None, 3, 4, None), (2, "", 5, 6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, start int, sequence_id string")
    counts = unigram.token_counts(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in counts) == [(0, 0), (1, 15), (1, 15), (2, 0)]
    assert sorted(r.doc_id or 0 for r in packing.pack_documents(docs).collect()) == [0, 1, 1, 2]

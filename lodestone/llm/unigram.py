"""Token counts under a unigram vocabulary, by a Viterbi search that carries scores and piece counts only.

The vocabulary is that of a sentencepiece model: its ordinary pieces with their scores, and its byte pieces.
A text's spaces become U+2581 and one is put before it. Among all ways to cut the text into pieces, the
tokenizer takes the one of the highest total score; a character that is no piece itself may also stand
alone as unknown, 10 below the least score, and counts as its UTF-8 bytes. Where two ways to reach a place
have equal scores, the one whose last piece starts first stays (the rule of the tokenizers library's
Unigram model, which this equals).

An Aho-Corasick automaton lists, at each character, the pieces that end there, longest first; the dynamic
programme keeps the best score and the number of pieces up to each place. No piece runs from another
character into U+2581 or across a line feed, so words are searched on their own and each distinct word
once; a vocabulary for which that does not hold is searched text by text.

Null and empty texts have no tokens. Rows are kept as they are, repeated ones and null ids too; an empty table gives
no rows. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps, ship, working

SPACE = "▁"
#: What an unknown character costs below the least score (a fixed value of the tokenizer).
UNKNOWN_BELOW = 10.0
#: Words kept per Python worker; beyond it, new ones are searched each time.
KEPT_WORDS = 1_000_000

_open: dict[str, "Counter"] = {}
keeps("unigram", _open.clear)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """The ordinary pieces of a model with their scores, and whether it has a piece for every byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return pieces, sum(map(model.is_byte, ids)) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], bytes_known: bool = True, keep: int = KEPT_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.pieces = dict(pieces)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_BELOW
        self.bytes_known = bytes_known
        self.apart = not any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.words: dict[str, int] = {}
        self.keep = keep

    @classmethod
    def of(cls, path: str) -> "Counter":
        """One counter for each vocabulary and worker, kept between tasks."""
        working("unigram")
        if path not in _open:
            _open[path] = cls(*vocabulary(path))
        return _open[path]

    def search(self, text: str) -> int:
        """The number of pieces in the best way to cut text, in which spaces are U+2581 already."""
        n = len(text)
        if not n:
            return 0
        if text in self.pieces and n == 1:
            return 1
        best, count, alone = [0.0] + [None] * n, [0] * (n + 1), [True] * (n + 1)
        ends = iter(self.automaton.iter(text)) if self.pieces else iter(())
        match = next(ends, None)
        for end in range(1, n + 1):
            top, pieces, single, fused = None, 0, False, False
            while match is not None and match[0] == end - 1:
                length, score = match[1]
                single = single or length == 1
                reached = best[end - length] + score
                if top is None or reached > top:
                    top, pieces, fused = reached, count[end - length] + 1, False
                match = next(ends, None)
            if not single:
                reached = best[end - 1] + self.unknown
                if top is None or reached > top:
                    # Unknown neighbours are one token without byte pieces, and their bytes with them.
                    own = len(text[end - 1].encode("utf-8", "surrogatepass")) if self.bytes_known else int(end == 1 or not alone[end - 1])
                    top, pieces, fused = reached, count[end - 1] + own, True
            best[end], count[end], alone[end] = top, pieces, fused
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if not (self.apart and self.bytes_known) or SPACE in text or "\x00" in text:
            return self.search(SPACE + text.replace(" ", SPACE))
        # "w" stands for a space and w, "\0w" for w behind a line feed.
        words = text.replace("\n", " \x00\n \x00").split(" ")
        if "" in words:  # neighbouring spaces may be one piece
            found = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+", SPACE + text.replace(" ", SPACE))
            words = [w[1:] if len(w) > 1 and w[1] != SPACE and w[0] == SPACE else "\x00" + w for w in found]
        counts = list(map(self.words.get, words))
        if None in counts:
            for k, known in enumerate(counts):
                if known is None:
                    word = words[k]
                    counts[k] = self.words.get(word)
                    if counts[k] is None:
                        counts[k] = self.search(word[1:] if word[:1] == "\x00" else SPACE + word)
                        if len(self.words) < self.keep:
                            self.words[word] = counts[k]
        return sum(counts)


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, counts = ([f(t) for t in texts] for f in (lambda t: len(t or ""), counter.count))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long")

"""Removal of repeated word windows, by anchors on fixed blocks.

Every document's words are cut into blocks of half a window, one behind the other: the reference index.
Every rolling window of that many words probes the index. A repeated window of full length holds a whole
block in either of its places, so each of its copies has a hit. A hit is extended to the left and to the right, over
the words that windows around its block can hold: hits of one block are swept word by word (suffix_family), which
gives the longest exact match with any other hit from each word on. Windows inside a match are repeated, and
what they cover together are the maximal repeats. Hits whose surroundings are equal as a
whole stand for each other and are not swept one by one. ``repeats`` tells of the steps and of blocks that very many
documents share.

Words are maximal runs without ASCII white space, unchanged, and compared by 64 bits each. A null or wordless text has
no words and keeps the empty string. Rows with equal id and text are repeats of each other and give a row each, though
two at most are worked on; rows with null ids take part. An empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import working
from .repeats import HOT_KINDS, MET, PLACES, Sorted, repeats
from .suffix_family import Segments, spread
from .wordhash import hashes_in, mixed, run_hashes, words_in

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    window: int = 35
    #: Bits of the blocks' hashes that meet references; chance meetings are sorted out when hits are extended.
    bits: int = 64
    references = True
    schema = RESULT

    def for_corpus(self, size_bits: int) -> "Rule":
        return Rule(self.window, min(64, size_bits + 10))

    def state(self, table: pa.Table, told: dict | None) -> "State":
        return State(table, self, told)

    @property
    def length(self) -> int:
        return self.window

    @property
    def short(self) -> int:
        return self.window

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


class State:
    """A batch's words, and, once it is told, the blocks that hit a reference or are one that was hit."""

    def __init__(self, table: pa.Table, rule: Rule, told: dict | None):
        working()
        self.table = table.sort_by([("k", "ascending")])
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in self.table.column("text").to_pylist()]
        raw = np.frombuffer(b" ".join(self.texts), dtype=np.uint8)
        starts, ends = words_in(raw)
        bounds = np.cumsum([0] + [len(t) + 1 for t in self.texts])
        self.offsets = np.searchsorted(starts, bounds)
        self.hashes = hashes_in(raw, starts, ends)
        self.size, self.rule = len(self.hashes), rule
        self.blocks = run_hashes(self.hashes, rule.block)
        if told is None or PLACES not in told:
            self._references_and_rest()
        if told is not None:
            self.at = told[PLACES] if PLACES in told else self._hits(told.get(MET, np.zeros(0, np.int64)))
            self.kept = self.at
            self.entries = Sorted.of(self.blocks[self.at], 64, self._surroundings())

    def _references_and_rest(self) -> None:
        """The blocks of documents that have a full window, at reference places and at all others."""
        sizes, block = np.diff(self.offsets), self.rule.block
        long_enough = np.flatnonzero(sizes >= self.rule.window)
        lows, counts = self.offsets[:-1][long_enough], sizes[long_enough] - block + 1
        at = spread(lows, counts)
        aligned = (at - np.repeat(lows, counts)) % block == 0
        self.references, self.rest = at[aligned], at[~aligned]
        self.of_references = Sorted.of(self.blocks[self.references], self.rule.bits)
        self.of_rest = Sorted.of(self.blocks[self.rest], self.rule.bits)

    def probes(self) -> tuple[Sorted, Sorted]:
        return self.of_references, self.of_rest

    def _hits(self, met: np.ndarray) -> np.ndarray:
        """Places of the blocks that met, the entries of references coming first; a reference that occurs twice has too."""
        first = len(self.of_references.distinct)
        own = np.union1d(met[met < first], np.flatnonzero(self.of_references.counts > 1))
        rolling = self.rest[self.of_rest.all_of(met[met >= first] - first)]
        return np.sort(np.concatenate([self.references[self.of_references.all_of(own)], rolling]))

    def _surroundings(self) -> np.ndarray:
        """Hashes of the words that windows around each hit can hold, and of the block's place among them."""
        low, _, end = self.spans(np.arange(len(self.at)))
        if not self.size:
            return np.zeros(0, np.uint64)
        up = np.full(self.size, _FACTOR, dtype=np.uint64)
        back = np.full(self.size, pow(int(_FACTOR), -1, 1 << 64), dtype=np.uint64)
        up[0] = back[0] = 1
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.hashes) * np.cumprod(up), dtype=np.uint64)])
        shape = ((self.at - low) * (1 << 20) + end - low).astype(np.uint64)
        return mixed((sums[end] - sums[low]) * np.cumprod(back)[low] + mixed(shape + _FACTOR))

    def spans(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, window, block = self.at[runs], self.rule.window, self.rule.block
        doc = np.searchsorted(self.offsets, at, "right") - 1
        low = np.maximum(at + block - window, self.offsets[doc])
        high = np.minimum(at, self.offsets[doc + 1] - window)
        return low, high - low + 1, high + window

    def segments(self, runs: np.ndarray, batch: int) -> Segments:
        low, starts, end = self.spans(runs)
        sizes = end - low
        flat = np.maximum(self.hashes[spread(low, sizes)], np.uint64(1))
        whose, left = np.full(len(runs), batch, dtype=np.int64), self.at[runs] - low
        return Segments(self.blocks[self.at[runs]], whose, runs, left.astype(np.int32), sizes.astype(np.int32), starts.astype(np.int32), np.cumsum(sizes) - sizes, flat)

    def prints(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return run_hashes(self.hashes, size)[starts], run_hashes(mixed(self.hashes + _FACTOR), size)[starts]

    def finished(self, over: dict[int, np.ndarray]) -> pa.Table:
        gone = over[self.rule.window]
        total, removed, kept = [], [], []
        for k, own in enumerate(t.split() for t in self.texts):
            mask = gone[self.offsets[k] : self.offsets[k + 1]]
            total.append(len(own))
            removed.append(int(mask.sum()))
            left = own if not removed[-1] else [own[i] for i in np.flatnonzero(~mask)]
            kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
        columns = (pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()))
        return pa.Table.from_arrays([self.table.column("doc_id").combine_chunks(), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = 35, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs (doc_id, text)."""
    return repeats(docs, Rule(window), hot_kinds)

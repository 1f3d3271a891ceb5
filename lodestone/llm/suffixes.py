"""Removal of repeated byte strings, by a logarithmic family of suffix arrays.

Matches of at least ``short`` bytes are looked for; bytes of those of at least ``length`` are removed, and what
the shorter ones cover is counted. Of the grams in a window of ``short`` bytes, one has the least hash, and equal
windows have it at the same place: the anchor. Windows in a row that share it are a run, and the run's segment is all
that its windows can see, ``length`` bytes from each start. ``repeats`` tells how grams of a batch meet, how segments
that share one are swept into suffix arrays with LCPs, and how large groups are spread.

``remove_repeats`` does this for a table as one batch. ``SuffixIndex`` keeps texts, grams and suffix levels in a
folder: a new batch of documents gets its own arrays, which are merge-scanned against the levels that are there, tells
of repeats between all batches so far, and becomes a level; levels of equal size class merge.

Texts are UTF-8; matches stay within documents, and every byte that a repeated window covers is removed. A
null text is empty. Rows with equal id and text are repeats of each other and give a row each, though two at most are worked on; rows with
null ids take part. An empty table gives no rows; columns other than id and text are ignored. Segments are
compared byte by byte; that two runs have equal grams and equal segments is told by 128 bits of hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, working
from .repeats import HOT_KINDS, LEVEL, MATCHED, ROW, SENT, WHOLE, Sorted, alone, covered, dealt, first_step, given_back, last_step, meet_grams, meet_suffixes, repeats, second_step
from .suffix_family import Segments, spread
from .wordhash import BYTES, CHUNK, mixed, powers, run_hashes

#: Bytes of the shorter matches, half of which are a gram; bits of a gram's place among the CHUNK starts worked on at once.
SHORT, PLACE = 256, 21
#: Buckets of a growing index, which stay as they are.
INDEX_BUCKETS = 64
TEXTS = "doc_id long, text string, k long, times long, batch long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
_BASE = np.uint64(0x9E3779B97F4A7C15)


_kept_powers: list = []


def _least(keys: np.ndarray, width: int, count: int) -> np.ndarray:
    """The least of each window of width keys, by running minima from both sides of blocks."""
    padded = np.full(-(-(len(keys)) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


@dataclass
class Runs:
    """Runs of windows: first and last start, the gram's place, where what they see ends; hashes of gram and segment."""

    low: np.ndarray
    high: np.ndarray
    anchor: np.ndarray
    end: np.ndarray
    gram: np.ndarray
    whole: np.ndarray


def _runs(raw: np.ndarray, offsets: np.ndarray, length: int, short: int, gram: int) -> Runs:
    found: list[tuple[np.ndarray, ...]] = []
    if not _kept_powers:
        _kept_powers.extend(powers(CHUNK + 4 * length))
    up, down = _kept_powers
    if len(up) < CHUNK + length:
        up, down = powers(CHUNK + length)
    place = np.uint64((1 << PLACE) - 1)
    ends = offsets[1:]
    for at in range(0, max(len(raw) - short + 1, 0), CHUNK):
        n = min(CHUNK, len(raw) - short + 1 - at)
        part = raw[at : at + n + length - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTES[part] * up[: len(part)], out=sums[1:])
        hashes = mixed((sums[gram : n + short] - sums[: n + short - gram]) * down[: n + short - gram])
        least = _least((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), short - gram + 1, n)
        places = (least & place).astype(np.int64)
        # A window stays in its document if the document's end is not before its own.
        end = ends[np.searchsorted(ends, np.arange(at, at + n), "right")] - at
        starts = np.flatnonzero(np.arange(n) + short <= end)
        if not len(starts):
            continue
        new = np.concatenate([[True], (places[starts[1:]] != places[starts[:-1]]) | (starts[1:] != starts[:-1] + 1) | (end[starts[1:]] != end[starts[:-1]])])
        low = starts[new]
        high = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
        seen = np.minimum(high + length, end[low])
        # The hash of a segment is of its bytes, its windows and the place of the gram.
        sizes = mixed(((seen - low) * (1 << 40) + (high - low) * (1 << 20) + places[low] - low).astype(np.uint64) + _BASE)
        whole = mixed((sums[seen] - sums[low]) * down[low] + sizes)
        # The least of many hashes is small; mixed anew, grams fall into all buckets alike.
        found.append((low + at, high + at, places[low] + at, seen + at, mixed(hashes[places[low]] + _BASE), whole))
    if not found:
        return Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)))
    return Runs(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _prints(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each of the windows at ascending starts; bytes outside them are not looked at."""
    found = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + CHUNK, "left"))
        first = starts[lo]
        own = starts[lo:hi] - first
        wanted = covered(own, length, int(own[-1]) + length)
        moved = np.cumsum(wanted) - 1
        seen = BYTES[raw[first : first + len(wanted)][wanted]]
        for half, values in zip(found, (seen, mixed(seen + _BASE)), strict=True):
            half[lo:hi] = run_hashes(values, length)[moved[own]]
        lo = hi
    return found


@dataclass(frozen=True)
class Rule:
    length: int = 400
    short: int = SHORT
    references = False
    schema = RESULT

    @classmethod
    def of(cls, length: int, short: int | None = None) -> "Rule":
        return cls(length, min(SHORT, length) if short is None else short)

    def for_corpus(self, size_bits: int) -> "Rule":
        return self

    def state(self, table: pa.Table, told: dict | None) -> "State":
        return State(table, self)

    @property
    def gram(self) -> int:
        return max(1, self.short // 2)


class State:
    """A batch's texts, their runs, and the runs' grams and segments as sorted entries."""

    def __init__(self, table: pa.Table, rule: Rule):
        working()
        self.table = table.sort_by([("k", "ascending")])
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in self.table.column("text").to_pylist()]
        self.raw = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.size, self.rule = len(self.raw), rule
        self.offsets = np.cumsum([0] + [len(t) for t in self.texts])
        self.runs = _runs(self.raw, self.offsets, rule.length, rule.short, rule.gram)
        self.entries, self.kept = Sorted.of(self.runs.gram, 64, self.runs.whole), None

    def spans(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low = self.runs.low[runs]
        return low, self.runs.high[runs] - low + 1, self.runs.end[runs]

    def segments(self, runs: np.ndarray, batch: int) -> Segments:
        low, starts, end = self.spans(runs)
        sizes = end - low
        flat = self.raw[spread(low, sizes)] + np.uint8(1)  # no byte of UTF-8 is 255
        whose, left = np.full(len(runs), batch, dtype=np.int64), self.runs.anchor[runs] - low
        return Segments(self.runs.gram[runs], whose, runs, left.astype(np.int32), sizes.astype(np.int32), starts.astype(np.int32), np.cumsum(sizes) - sizes, flat)

    def prints(self, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        return _prints(self.raw, starts, size)

    def finished(self, over: dict[int, np.ndarray]) -> pa.Table:
        gone, repeated = over[self.rule.length], over[self.rule.short]
        raw, offsets, begins = self.raw, self.offsets, self.offsets[:-1][np.diff(self.offsets) > 0]
        edges = np.diff(gone.astype(np.int8), prepend=0)
        edges[begins] = gone[begins]
        total, removed, spans, kept, brief = [], [], [], [], []
        for k, text in enumerate(self.texts):
            lo, hi = offsets[k], offsets[k + 1]
            mask = gone[lo:hi]
            total.append(len(text))
            removed.append(int(mask.sum()))
            spans.append(int((edges[lo:hi] > 0).sum()))
            kept.append(hashlib.sha256(raw[lo:hi][~mask].tobytes() if removed[-1] else text).hexdigest())
            brief.append(int(repeated[lo:hi].sum()))
        columns = (total, removed, spans, kept, brief)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.Table.from_arrays([self.table.column("doc_id").combine_chunks(), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)


def remove_repeats(docs: DataFrame, length: int = 400, short: int | None = None, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs (doc_id, text); n_repeated: the bytes
    that repeats of at least ``short`` bytes cover.
    """
    return repeats(docs, Rule.of(length, short), hot_kinds)


class SuffixIndex:
    """An index of repeats in a folder that all executors see, which grows by batches of documents.

    ``texts/add=N`` holds the documents of each batch, ``grams/add=N`` and ``suffixes/add=N`` what they added: levels,
    and what batches were told. Nothing that is written is changed; levels that were merged into a later one
    are passed over. A batch whose writing failed is written again under its number.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = 400, short: int | None = None):
        self.spark, self.path, self.rule = spark, path.rstrip("/"), Rule.of(length, short)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/suffixes")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in files.listStatus(at)] if files.exists(at) else []
        self.adds = sum(files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")) for p in done)
        ship(spark)

    def _read(self, name: str, schema: str, upto: int) -> DataFrame:
        paths = [f"{self.path}/{name}/add={k}" for k in range(upto)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, docs: DataFrame) -> None:
        """Adds docs (doc_id, text) as one batch of the index."""
        k, rule = self.adds, self.rule
        keyed, _, _, _ = dealt(docs)
        keyed.withColumn("batch", F.col("batch") + (k << 40)).write.mode("overwrite").parquet(f"{self.path}/texts/add={k}")
        new, every = self._read_one("texts", TEXTS, k), self._read("texts", TEXTS, k + 1)
        entries = new.groupBy("batch").applyInArrow(alone(first_step(rule, INDEX_BUCKETS)), ROW)
        grams = self._read("grams", ROW, k).where(F.col("kind") == LEVEL)
        met = entries.groupBy("bucket").cogroup(grams.groupBy("bucket")).applyInArrow(meet_grams(None, k), ROW)
        met.write.mode("overwrite").parquet(f"{self.path}/grams/add={k}")
        told = self._read_one("grams", ROW, k).where(F.col("kind").isin(WHOLE, SENT))
        asked = told.select("batch").distinct()
        some = every.join(asked, "batch", "left_semi")
        sent = some.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(second_step(rule, INDEX_BUCKETS), ROW)
        levels = self._read("suffixes", ROW, k).where(F.col("kind") == LEVEL)
        matched = sent.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(meet_suffixes(rule, k), ROW)
        matched.write.mode("overwrite").parquet(f"{self.path}/suffixes/add={k}")
        self.adds = k + 1

    def _read_one(self, name: str, schema: str, k: int) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/add={k}")

    def results(self) -> DataFrame:
        """remove_repeats of all documents that were added."""
        told = self._read("suffixes", ROW, self.adds).where(F.col("kind").isin(WHOLE, MATCHED))
        texts = self._read("texts", TEXTS, self.adds)
        found = texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(last_step(self.rule), f"{RESULT}, times long")
        return given_back(found)

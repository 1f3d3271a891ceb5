"""Document fingerprints that are homomorphic over the multiset of a text's paragraphs.

A paragraph is a piece between line feeds. Its vector has two blocks, and a document's is their sum:

``digest``  8 lanes modulo 2**64, hashed from the whole paragraph. Sums are equal exactly when the
            multisets of paragraphs are (up to collisions of 512 bits), in whatever order.
``sketch``  128 lanes modulo 2**32: each pair of neighbouring words of a paragraph adds +1 or -1 to every
            lane by a bit of its hash. Products of two sketches estimate products of the multisets of
            pairs, so the cosine of two sketches is the likeness of two documents. A lane is read as a signed
            number; it would take 2**31 pairs in one text to leave its range.

Inserting or deleting a paragraph adds or subtracts its vector; an edited text is fingerprinted by its
changed paragraphs alone.

A null text is empty: one empty paragraph. The likeness of two texts without a word is 1 if their
fingerprints are equal and 0 if not. Rows keep their ids; for the neighbour of a row, rows with equal ids
are taken in the order of their texts, and null ids come first. An empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, working
from .wordhash import mixed, word_hashes

DIGEST_LANES, SKETCH_LANES = 8, 128
#: Pairs of words worked on at once.
BLOCK = 1 << 16
_EDGE = np.uint64(0x9E3779B97F4A7C15)
_LANES = _EDGE * np.arange(1, DIGEST_LANES + 1, dtype=np.uint64)


@dataclass
class Print:
    digest: np.ndarray
    sketch: np.ndarray

    def __add__(self, other: "Print") -> "Print":
        return Print(self.digest + other.digest, self.sketch + other.sketch)

    def __sub__(self, other: "Print") -> "Print":
        return Print(self.digest - other.digest, self.sketch - other.sketch)

    def text(self) -> str:
        return base64.b64encode(self.digest.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> "Print":
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw[: 8 * DIGEST_LANES], "<u8").copy(), np.frombuffer(raw[8 * DIGEST_LANES :], "<u4").copy())

    def likeness(self, other: "Print") -> float:
        if np.array_equal(self.digest, other.digest):
            return 1.0
        a, b = (x.sketch.astype(np.int32).astype(np.float64) for x in (self, other))
        scale = np.sqrt((a @ a) * (b @ b))
        return float(min(max(a @ b / scale, 0.0), 1.0)) if scale else 0.0


def of_paragraphs(paragraphs: list[str]) -> Print:
    """The sum of the vectors of paragraphs."""
    sketch = np.zeros(SKETCH_LANES, dtype=np.int64)
    raws = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
    firsts = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raws)), dtype="<u8").reshape(-1, 2)
    digest = mixed(firsts[:, :1] + mixed(firsts[:, 1:] + _LANES)).sum(axis=0, dtype=np.uint64)
    words = [r.split() for r in raws]
    hashes = word_hashes([w for ws in words for w in ws])
    if len(hashes):
        starts = np.cumsum([0] + [len(w) for w in words[:-1]])[[bool(w) for w in words]]
        before = np.empty_like(hashes)
        before[1:] = hashes[:-1]
        before[starts] = _EDGE
        pairs = mixed(hashes * np.uint64(3) + before)
        for at in range(0, len(pairs), BLOCK):
            part = pairs[at : at + BLOCK]
            for half, seed in ((0, 0), (1, 0x5851F42D4C957F2D)):
                bits = np.unpackbits((mixed(part + np.uint64(seed)) if half else part).view(np.uint8).reshape(len(part), 8), axis=1)
                sketch[64 * half : 64 * half + 64] += 2 * bits.sum(axis=0, dtype=np.int64) - len(part)
    return Print(digest, (sketch & 0xFFFFFFFF).astype(np.uint32))


def of_text(text: str | None) -> Print:
    return of_paragraphs((text or "").split("\n"))


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by as many of the first ones of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def of_edited(own: Print, text: str, changed: str) -> Print:
    """The fingerprint of changed from that of text, by the paragraphs after those at the start of both."""
    keep = len(text) - len(text) // 4
    # Paragraphs that end before the cut are in both.
    same = text.rfind("\n", 0, keep) + 1
    return own - of_paragraphs(text[same:].split("\n")) + of_paragraphs(changed[same:].split("\n"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Rows of the sample that cuts the table into ranges, for each range; code points of a text that tell rows of one id apart.
PER_RANGE, START = 100, 32


def fingerprints(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): its fingerprint, that of the edited text, and likenesses.

    The edited text ends in the start of the next row's. Rows are dealt into ranges of (id, start of text), as
    many as shuffle partitions; the first rows of a range also go to the range before it, and those of
    the first range to the last one, so that every row meets its follower in one task.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.withColumn("k", F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.substring("text", 1, START).alias("h")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    # Cuts from a bounded sample of the keys: they deal rows out and have no part in any result.
    share = min(1.0, PER_RANGE * parts / total)
    sample = keyed.select("k").where(F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 24)) < int(share * (1 << 24)))
    keys = sorted((r.k.id, r.k.h) for r in sample.limit(2 * PER_RANGE * parts).collect())
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    ranged = keyed.withColumn("range", _range(cuts))
    firsts = ranged.groupBy("range").agg(F.min("k").alias("k")).collect()  # a row for each range
    order = sorted((r.range, r.k.id, r.k.h) for r in firsts)
    before = [(id_, h, order[i - 1][0]) for i, (_, id_, h) in enumerate(order)]
    ahead = F.broadcast(spark.createDataFrame(before, "id long, h string, before int"))
    met = ranged.join(ahead, (F.col("k.id") == F.col("id")) & (F.col("k.h") == F.col("h")), "left")
    own, also = F.struct("range", F.lit(0).alias("ahead")), F.struct(F.col("before").alias("range"), F.lit(1).alias("ahead"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))
    dealt = met.select("doc_id", "text", "k", F.explode(places).alias("to")).select("doc_id", "text", "k", "to.range", "to.ahead")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "ahead", "k", "text")
    return dealt.select("doc_id", "text", "range", "ahead").mapInArrow(_paired, SCHEMA)


def _range(cuts: list[tuple[int, str]]) -> Column:
    """The number of cuts at or below k, by a binary search in an array."""
    if not cuts:
        return F.lit(0)
    listed = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(h).alias("h")) for i, h in cuts))
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))))
    goes = lambda at, step: (at + step <= len(cuts)) & (F.get(listed, at + step - 1) <= F.col("k"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(goes(at, step), at + step).otherwise(at))


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working("words")
    held = None  # the row before, which waits for its follower: (doc_id, text, fingerprint, range, ahead)
    for batch in batches:
        rows = []
        for doc, text, place, ahead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[3] == place and held[4]:
                continue  # only the first row behind a range is its follower
            own = of_text(text)
            if held and held[3] == place:
                rows.append(_row(held, text, own))
            held = (doc, text, own, place, ahead)
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]


def _row(held: tuple, following: str, next_print: Print) -> tuple:
    doc, text, own, _, _ = held
    changed = edited(text, following)
    other = of_edited(own, text, changed)
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.text(), other.text(), own.likeness(other), own.likeness(next_print)

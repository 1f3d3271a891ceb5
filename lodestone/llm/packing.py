"""Packing documents into sequences of fixed length by best-fit decreasing.

A segment tree over remaining capacities finds, for each piece, the open window with the least room that
still takes it. Documents longer than a window are first cut into full windows and a rest. Packing runs
within bounded units of a scan task, without any shuffle: a unit holds thousands of windows, so what stays
open at its end is a small share, and that rest is cut to powers of two, which need no padding.

Null texts are empty documents (just the end id), equal ids and texts are packed as separate documents, an
empty table gives no pieces, and columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied
from .tokens import KEPT_PIECES, PieceEncoder, default_vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Ids held at once by a task; a unit ends with the document that reaches it.
UNIT_TOKENS = 8 << 20


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity of at least some length."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.leaves
        while at:
            self.counts[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) of the tightest window that has room for length."""
        at, counts = length + self.leaves, self.counts
        while not counts[at]:
            while at & 1:  # a right child: nothing further right below its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        while at:
            counts[at] -= 1
            at >>= 1
        return room, self.open[room].pop()


def pack(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that cover every document.

    Sequences number from 0. Each is full, or padded, or has a power of two as its length.
    """
    pieces, rests, used = [], [], 0
    for doc, n in enumerate(lengths):
        full = n // window
        for k in range(full):
            pieces.append((doc, k * window, window, used, 0))
            used += 1
        if n % window:
            rests.append((n % window, doc, full * window))
    tree, fill, holds = CapacityTree(window), [], []
    for length, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        room, at = tree.take(length) or (window, len(fill))
        if at == len(fill):
            fill.append(0)
            holds.append([])
        holds[at].append((doc, start, length))
        fill[at] += length
        if room > length:
            tree.add(room - length, at)
    # Windows with room left: the emptiest ones are cut up to fill the fullest; then there is one at most.
    rooms = sorted((i for i, n in enumerate(fill) if n < window and n & (n - 1)), key=lambda i: fill[i])
    low, high = 0, len(rooms) - 1
    while low < high:
        give, take = rooms[low], rooms[high]
        room = window - fill[take]
        while room and holds[give]:
            doc, start, length = holds[give].pop()
            cut = min(room, length)
            holds[take].append((doc, start, cut))
            if cut < length:
                holds[give].append((doc, start + cut, length - cut))
            room -= cut
            fill[take] += cut
            fill[give] -= cut
        high -= not room
        low += not holds[give]
    for i in range(len(fill)):
        left = fill[i]
        if left and left < window and left & (left - 1):
            queue = holds[i][::-1]
            holds[i] = []
            while left:
                size = 1 << (left.bit_length() - 1)
                left -= size
                part = []
                while size:
                    doc, start, length = queue.pop()
                    cut = min(size, length)
                    part.append((doc, start, cut))
                    if cut < length:
                        queue.append((doc, start + cut, length - cut))
                    size -= cut
                holds.append(part)
    for part in holds:
        offset = 0
        for doc, start, length in part:
            pieces.append((doc, start, length, used, offset))
            offset += length
        used += bool(part)
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, window: int = 2048, keep: int = KEPT_PIECES) -> DataFrame:
    """One row for each piece of each document of docs (doc_id, text).

    keep: words whose ids a worker keeps, at some 200 bytes each; fewer cost time and no results.
    """
    ship(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = PieceEncoder.of(vocabulary, keep), end_id.to_bytes(4, "little")
        # Sequence ids: the task in the high bits, then a running number.
        base = TaskContext.get().partitionId() << 36
        ids: list = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base
            found = pack([len(h) // 4 for h in held], window)
            for k in range(0, len(found), 50_000):
                part = found[k : k + 50_000]
                doc, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*part, strict=True))
                sums = [zlib.crc32(memoryview(held[d])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in part]
                whose, sizes = [ids[d] for d in doc], [len(held[d]) // 4 for d in doc]
                columns = (whose, start, length, sums, sizes, sequence + base, offset)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])
            base += max((p[3] for p in found), default=-1) + 1

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                held.append(encoder.encode(text) + end)
                tokens += len(held[-1]) // 4
                if tokens >= UNIT_TOKENS:
                    yield from flush()
                    ids, held, tokens = [], [], 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), PIECES)

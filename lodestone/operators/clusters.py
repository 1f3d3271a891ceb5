"""Anchored runs over sorted values, for groups of any size.

A run starts at an anchor and takes in what is within a width of it; the next value beyond is the next anchor. Where a
run starts depends on all before it, so a group looks like one task's work. Here values are sorted into ranges, which
split a large group; each range sums up what it does to any anchor that comes into it, those summaries are put
together range by range, and a second pass marks every value with the anchor of its run.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .joins import durable


class Passage:
    """What a stretch of ascending values does to the anchor that comes into it.

    An anchor a goes on until the first value more than width above it, one of ``entries``; from there on the stretch
    decides, and chains that meet stay together. An anchor that no entry is beyond comes out as it came in.
    """

    def __init__(self, width: float) -> None:
        self.width, self.entries, self.waiting = width, [], True
        #: [anchor, entries that lead to it]: chains in the order of their anchors.
        self.chains: deque = deque()

    def add(self, x: float) -> None:
        moved: list[int] = []
        while self.chains and x - self.chains[0][0] > self.width:
            own = self.chains.popleft()[1]
            moved, own = (moved, own) if len(moved) >= len(own) else (own, moved)
            moved.extend(own)
        if self.waiting and (not self.entries or x > self.entries[-1]):
            self.entries.append(x)
            moved.append(len(self.entries) - 1)
            # What comes in is at most the first value: none of it can wait any longer.
            self.waiting = not x - self.entries[0] > self.width
        if moved:
            if self.chains and self.chains[-1][0] == x:
                self.chains[-1][1].extend(moved)
            else:
                self.chains.append([x, moved])

    def ends(self) -> list[float]:
        """For each entry, the anchor at the stretch's end."""
        out = [0.0] * len(self.entries)
        for anchor, own in self.chains:
            for k in own:
                out[k] = anchor
        return out


def through(anchor: float, entries: list[float], ends: list[float], width: float) -> float:
    """The anchor that comes out of a stretch for the one that comes in."""
    lo, hi = 0, len(entries)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if entries[mid] - anchor > width else (mid + 1, hi)
    return ends[lo] if lo < len(entries) else anchor


def _changes(columns: list[pa.Array], before: list | None) -> list[int]:
    """Rows of a batch that start another group; before: the last row's group of the batch before, None at the start."""
    n = len(columns[0])
    changed = [False] * n
    for i, c in enumerate(columns):
        null = c.is_null()
        differ = pc.or_(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False), pc.xor(null[1:], null[:-1])).to_pylist()
        changed[1:] = [a or b for a, b in zip(changed[1:], differ, strict=True)]
        changed[0] = changed[0] or before is None or c[0].as_py() != before[i]
    return [k for k, x in enumerate(changed) if x]


def anchored(rows: DataFrame, by: list[str], value: str, width: float, name: str = "anchor", ranges: int | None = None) -> DataFrame:
    """rows with the anchor of each value's run within its group (equal columns ``by``; nulls are equal).

    Rows without a value are dropped; a difference of width exactly stays in the run. A group of any size is dealt
    over ranges; the driver sees a row for each range, which holds as many values as differ within width at most.
    """
    spark = rows.sparkSession
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where(F.col(value).isNotNull()).repartitionByRange(parts, *by, value).sortWithinPartitions(*by, value)
    placed = durable(dealt.withColumn("__range", F.spark_partition_id()))
    kind = placed.schema[value].dataType
    keys = [placed.schema[c] for c in by]
    ends = [StructField(f"{side}{i}", f.dataType) for side in ("first", "last") for i, f in enumerate(keys)]
    number = kind.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage, whole, own = Passage(width), True, None
        first = last = place = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, values = batch.columns[: len(by)], batch.column(len(by)).to_pylist()
            starts = _changes(columns, last)
            if first is None:
                first, place, starts = [c[0].as_py() for c in columns], batch.column(len(by) + 1)[0].as_py(), starts[1:]
            if whole:
                for x in values[: starts[0] if starts else None]:
                    passage.add(x)
                whole = not starts
            # Only the last group's anchor goes on into the next range.
            if starts:
                own, values = values[starts[-1]], values[starts[-1] :]
            if not whole:
                for x in values:
                    own = x if x - own > width else own
            last = [c[-1].as_py() for c in columns]
        if first is not None:
            arrays = [pa.array([v], f.type) for v, f in zip([*first, *last], [*batch.schema][: len(by)] * 2, strict=True)]
            like = batch.schema.field(len(by)).type
            more = [pa.array([place], pa.int32()), pa.array([whole]), pa.array([passage.entries], pa.list_(like)), pa.array([passage.ends()], pa.list_(like)), pa.array([own], like)]
            yield pa.RecordBatch.from_arrays([*arrays, *more], [*(f.name for f in ends), "place", "whole", "entries", "ends", "own"])

    slim = placed.select(*by, value, "__range")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ends), f"place int, whole boolean, entries array<{number}>, ends array<{number}>, own {number}"])
    comes, state, before = {}, None, None
    for r in sorted(slim.mapInArrow(summed, schema).collect(), key=lambda r: r.place):
        first, last = ([r[f"{side}{i}"] for i in range(len(by))] for side in ("first", "last"))
        goes_on = before is not None and first == before
        if goes_on:
            comes[r.place] = state
        state = r.own if not r.whole else through(state, r.entries, r.ends, width) if goes_on else r.ends[0]
        before = last

    at_value, at_range = placed.columns.index(value), placed.columns.index("__range")
    at_keys = [placed.columns.index(c) for c in by]
    schema = StructType([*(f for f in placed.schema.fields if f.name != "__range"), StructField(name, kind)])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = anchor = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in at_keys]
            starts = set(_changes(columns, last))
            if last is None:
                anchor = comes.get(batch.column(at_range)[0].as_py())
                if anchor is not None:
                    starts.discard(0)
            out = []
            for k, x in enumerate(batch.column(at_value).to_pylist()):
                anchor = x if k in starts or x - anchor > width else anchor
                out.append(anchor)
            last = [c[-1].as_py() for c in columns]
            kept = [c for k, c in enumerate(batch.columns) if k != at_range]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, batch.column(at_value).type)], schema.names)

    # Under plain names: others may have any character.
    return placed.toDF(*(f"c{k}" for k in range(len(placed.columns)))).mapInArrow(marked, schema)

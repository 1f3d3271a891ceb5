"""Connected components of an edge table; nothing gathers on the driver.

Every partition first reduces its edges to a spanning forest. What is left is labelled in one task if its
number, which is counted, is at most TASK_LINKS; a larger rest takes turns of large and small stars, each of
which shrinks it, until it is small enough or at rest. Both ways give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized

#: Links that one task labels at once (16 bytes each, some 100 while at work).
TASK_LINKS = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes, ascending, and the least node of each one's component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[label]


def _forest(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("u", "v")) -> Iterator[pa.RecordBatch]:
    """Each node of a chunk of edges, and the least one of its component in the chunk."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        nodes, least = least_labels(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        return pa.record_batch([pa.array(nodes), pa.array(least)], list(names))

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_LINKS:
            yield flush()
            held = []
    if held:
        yield flush()


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Links each node's (larger, or smaller and own) neighbours to the least of all."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    kept = joined.where(F.col("v") > F.col("u")) if large else joined
    linked = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.union(least.select("u", F.col("m").alias("v")))
    return sized(sized(linked.where(F.col("u") != F.col("v")), rows).distinct(), rows)


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return row.n, row.s


def components(edges: DataFrame, u: str = "u", v: str = "v", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, component) for every node that an edge touches; component is the least node reachable.

    Null ends and loops are left out. The number of turns of stars, where there are any, grows with the
    logarithm of the longest path.
    """
    edges = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    # Every node of a chunk stands in its forest, if only beside itself.
    edges = cut(edges.mapInArrow(_forest, "u long, v long").where("u <> v"))
    seen = _sum(edges)
    while seen[0] > task_links:
        edges = cut(_star(_star(edges, True, seen[0]), False, seen[0]))
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    if seen[0] <= task_links:
        named = partial(_forest, names=("node", "component"))
        return edges.coalesce(1).mapInArrow(named, "node long, component long")
    # At rest, each edge leads from a node to its component.
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return sized(both.groupBy("node").agg(F.min("component").alias("component")), seen[0])

"""Anchored runs against a loop over each group, however groups are dealt."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import clusters as K


def plainly(values, width):
    out, anchor = [], None
    for x in sorted(values):
        anchor = x if anchor is None or x - anchor > width else anchor
        out.append(anchor)
    return out


def test_passages_put_together():
    rng = random.Random(2)
    for _ in range(3000):
        width = rng.choice([1, 3, 0.3])
        values = sorted(rng.choice([rng.randint(0, 12), rng.random() * 4]) for _ in range(rng.randint(1, 20)))
        cut = rng.randint(0, len(values))
        want = plainly(values, width)
        head, tail = values[:cut], values[cut:]
        if not head or not tail:
            continue
        p = K.Passage(width)
        for x in tail:
            p.add(x)
        assert K.through(want[cut - 1], p.entries, p.ends(), width) == want[-1]
        assert p.ends()[0] == plainly(tail, width)[-1]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_against_a_loop(spark, ranges):
    rng = random.Random(ranges)
    groups = {(g, h): [rng.choice([rng.randint(0, 60), 7, rng.random() * 90]) for _ in range(n)] for (g, h), n in {("a", 1): 1500, ("a", None): 3, (None, 1): 200, ("", 2): 1, ("b", 2): 40}.items()}
    rows = [(g, h, float(x), k) for (g, h), v in groups.items() for k, x in enumerate(v)]
    table = spark.createDataFrame([*rows, ("a", 1, None, -1)], "g string, h int, x double, `k.` int").repartition(5)
    got = K.anchored(table, ["g", "h"], "x", 1.5, ranges=ranges)
    assert got.columns == ["g", "h", "x", "k.", "anchor"]
    have = {}
    for r in got.collect():
        have.setdefault((r.g, r.h), []).append((r.x, r.anchor))
    for key, values in groups.items():
        assert sorted(have[key]) == list(zip(sorted(values), plainly(values, 1.5), strict=True))
    assert len(have) == len(groups)


def test_a_group_of_a_million(spark):
    rows = spark.range(1_000_000).select(F.lit("one").alias("g"), (F.col("id") * 7).alias("x"))
    got = K.anchored(rows, ["g"], "x", 20, ranges=16)
    # Runs of three: 0, 7 and 14, then 21.
    assert got.where("anchor != floor(x / 21) * 21").count() == 0 and got.select(F.spark_partition_id()).distinct().count() == 16


def test_empty(spark):
    assert K.anchored(spark.createDataFrame([], "g long, x long"), ["g"], "x", 1).collect() == []

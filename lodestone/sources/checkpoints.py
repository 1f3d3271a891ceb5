"""Checkpoints as small Parquet tables on any Hadoop path: a row for each array, so that no pickled code is read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "kind string, name string, part int, shape array<long>, data array<double>"
#: Values that a checkpoint may hold; it goes through the driver and to every worker.
MOST_VALUES = 200_000_000


def save(spark: SparkSession, path: str, kind: str, arrays: dict) -> str:
    """arrays: a name's array, or a tuple of them (a weight and its bias)."""
    rows = []
    for name, value in arrays.items():
        for part, one in enumerate(value if isinstance(value, tuple) else (value,)):
            a = np.asarray(one, dtype=float)
            rows.append((kind, name, part if isinstance(value, tuple) else -1, list(a.shape), a.ravel().tolist()))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load(spark: SparkSession, path: str) -> tuple[str, dict]:
    """(kind, arrays) of what save wrote; too large a checkpoint is refused before anything is collected."""
    table: DataFrame = spark.read.schema(SCHEMA).parquet(path)
    held = table.selectExpr("coalesce(sum(size(data)), 0) AS n").first().n
    if held > MOST_VALUES:
        raise ValueError(f"{path} holds {held} values; {MOST_VALUES} at most")
    found: dict[str, dict[int, np.ndarray]] = {}
    kind = ""
    for r in table.collect():
        kind = r.kind
        found.setdefault(r.name, {})[r.part] = np.array(r.data).reshape(r.shape)
    return kind, {name: parts[-1] if -1 in parts else tuple(parts[k] for k in sorted(parts)) for name, parts in found.items()}

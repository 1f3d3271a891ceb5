"""Whitening of embeddings from a compensated covariance.

Entries become integers x = floor(64 * c) + 1000000. The fit list, each distinct x once, is written as a table in the
shared folder. One pass sums its columns exactly (integers); the next centres every vector on the mean, as a double and
its rest, and accumulates outer products in double-double arithmetic with error-free sums and products. Tasks hand on
high and low parts, which tasks of a second step merge without loss; the driver merges at most MERGED of those.

The covariance (dimensions x dimensions, whatever the number of rows) is reduced to a tridiagonal matrix and solved by
divide and conquer on the driver: that is what LAPACK's syevd does, which numpy's eigh calls. A last pass over the fit
list measures how far the whitened covariance is from the identity.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are those with an entry beyond 2^51 in
size, whose x no double tells from the next, and those whose length is not the most frequent one (of several, the
greatest), for they have no place in one covariance. All others are kept, repeated ones and those without an id too; columns
other than id and vector are ignored. Components without variance (a value within rounding of 0) can't be scaled to
1 and are left out, so one distinct vector gives no rows, and neither does an empty table. A deviation that no long
can hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped_at_end, new_folder, ship, tidied, working

#: Steps of a unit, and what is added to them (fixed by the contract); components; tasks that merge sums.
STEPS, SHIFT, COMPONENTS, MERGED = 64, 1_000_000, 16, 32
#: Vectors worked on at once: their outer products are what a worker holds.
BLOCK = 16
_SPLIT = 134217729.0  # 2^27 + 1


def two_sum(a, b):
    """a + b as the nearest double and what that leaves out, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b as the nearest double and what that leaves out, exactly."""
    p = a * b
    t = _SPLIT * a
    ah = t - (t - a)
    al = a - ah
    t = _SPLIT * b
    bh = t - (t - b)
    bl = b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(high, low, more_high, more_low):
    """The sum of two double-doubles."""
    s, e = two_sum(high, more_high)
    t, f = two_sum(low, more_low)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def summed(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-doubles summed along the first axis, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        h, l = add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = np.concatenate([h, high[2 * half :]]), np.concatenate([l, low[2 * half :]])
    return high[0], low[0]


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - sums / n as double-doubles: a whole number is taken off first, without rounding, then the rest of the mean."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s % n for s in sums]
    high = np.array([r / n for r in rest])
    low = np.array([float(_left(r, n, h)) for r, h in zip(rest, high, strict=True)])
    h, l = two_sum((x - whole).astype(np.float64), -high[None, :])
    return two_sum(h, l - low)


def _left(r: int, n: int, h: float) -> float:
    """r / n - h, from whole numbers."""
    top, bottom = h.as_integer_ratio()
    return (r * bottom - top * n) / (n * bottom)


def outer(high: np.ndarray, low: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed products of entries rows and columns of each vector, as double-doubles."""
    a, b = high[:, rows], high[:, columns]
    p, e = two_product(a, b)
    p, e = two_sum(p, e + (a * low[:, columns] + low[:, rows] * b))
    return summed(p, e)


@dataclass
class Whitening:
    """What whitening needs, at most dimensions x dimensions of anything."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        high, low = centred(x, self.n, self.sums)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sums)^2; in doubles' range of whole numbers at once, else in Python's."""
        if not len(x):
            return []
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([s % self.n for s in self.sums], dtype=np.int64)
        if (int(np.abs(x - whole).max()) + 1) * self.n < 2**31 // max(1, len(self.sums)):
            d = (x - whole) * self.n - rest
            return (d * d).sum(axis=1).tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x)
        return [d if d < 2**63 else None for d in exact]


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows that remain."""
    steps = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS))
    good = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float(1 << 45)), F.lit(False)))
    return rows.where(good & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.transform(steps, lambda s: s.cast("long") + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of their entries, less SHIFT so that a task's sums fit a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                n, total = n + len(x), total + (x - SHIFT).astype(object).sum(axis=0) if np.abs(x).max() > 2**40 else total + (x - SHIFT).sum(axis=0)
        yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([str(t) for t in total], pa.string())], ["i", "n", "s"])

    parts = fit.mapInArrow(run, "i int, n long, s string")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (got[0].n, [int(r.s) + SHIFT * r.n for r in got]) if got else (0, [])


def _accumulated(fit: DataFrame, products, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums over all vectors of what products(x) gives for a block; a step of tasks merges the tasks' sums."""

    def packed(high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([high.tobytes()], pa.binary()), pa.array([low.tobytes()], pa.binary())], ["high", "low"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        high, low, any_ = np.zeros(size), np.zeros(size), False
        for batch in batches:
            x = _matrix(batch.column(0))
            for k in range(0, len(x), BLOCK):
                high, low = add(high, low, *products(x[k : k + BLOCK]))
                any_ = True
        if any_:
            yield packed(high, low)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, any_ = np.zeros(size), np.zeros(size), False
        for batch in batches:
            for h, l in zip(batch.column(0), batch.column(1), strict=True):
                high, low = add(high, low, np.frombuffer(h.as_py()), np.frombuffer(l.as_py()))
                any_ = True
        if any_:
            yield packed(high, low)

    schema = "high binary, low binary"
    parts = fit.mapInArrow(tidied(sums), schema).repartition(MERGED).mapInArrow(merge, schema).collect()
    high, low = np.zeros(size), np.zeros(size)
    for p in sorted((bytes(p.high), bytes(p.low)) for p in parts):
        high, low = add(high, low, np.frombuffer(p[0]), np.frombuffer(p[1]))
    return high, low


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """A whitening from distinct vectors (column x, all of dims entries); None without a component of any variance."""
    n, sums = _sums(vectors, dims)
    if n < 2:
        return None
    rows, columns = np.triu_indices(dims)

    def products(x: np.ndarray):
        return outer(*centred(x, n, sums), rows, columns)

    high, low = _accumulated(vectors, products, len(rows))
    cov = np.zeros((dims, dims))
    cov[rows, columns] = cov[columns, rows] = high / n + low / n
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = [k for k in order if values[k] > max(values.max(), 0) * dims * 2.0**-50]
    if not order:
        return None
    found = Whitening(n, sums, values[order], np.ascontiguousarray(basis[:, order]), float(np.trace(cov)))
    k = len(order)

    def whitened_products(x: np.ndarray):
        z = found.scores(x)
        p, e = two_product(z[:, :, None], z[:, None, :])
        return summed(p.reshape(len(z), -1), e.reshape(len(z), -1))

    high, low = _accumulated(vectors, whitened_products, k * k)
    found.identity_error = float(np.abs(((high + low) / n).reshape(k, k) - np.eye(k)).max())
    return found


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each remaining row and component."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = quantised(rows, key, vector).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths.d
    own = quantised(rows, key, vector).where(F.size("x") == dims)
    path = dropped_at_end(spark, new_folder(spark, "vectors"))
    own.select("x").distinct().write.mode("overwrite").parquet(path)
    model = fit(spark.read.schema("x array<bigint>").parquet(path), dims, components)
    if model is None:
        return spark.createDataFrame([], schema)
    k, names = len(model.values), [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1))
                n, deviations = len(x), np.repeat(np.array(model.deviations(x), dtype=object), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, model.n), pa.int64()), pa.array(deviations.tolist(), pa.int64()), pa.array(model.scores(x).ravel()),
                    pa.array(np.tile(explained, n)), pa.array(np.full(n * k, model.identity_error)),
                ], names)

    return own.mapInArrow(tidied(run), schema)

"""Modified cosines of very many pairs of spectra, a batch of pairs at once.

The column function of the same name (peaks.modified_cosine) folds over arrays inside the row, which Spark interprets
step by step; a search rescores hundreds of pairs a query, for which numpy on Arrow batches is several times faster.
Both give the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are worked on at once.
PAIRS = 4096


def _flat(peaks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, mz, intensity) of a column of peak lists."""
    offsets = np.asarray(peaks.offsets)
    inner = peaks.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], np.asarray(inner.field(0)), np.asarray(inner.field(1))


def _norms(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values * values)])
    # Differences of running sums lose digits; short lists are summed by themselves.
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(np.append(values * values, 0.0), offsets[full])
        out[full[-1]] = sums[offsets[full[-1] + 1]] - sums[offsets[full[-1]]] if len(full) == 1 else float((values[offsets[full[-1]] : offsets[full[-1] + 1]] ** 2).sum())
    return np.sqrt(out)


def cosines(a: tuple, b: tuple, shift: np.ndarray, tol: float) -> np.ndarray:
    """Greedy one-to-one matches by product (ties: lower i, then j) over the norms of all peaks, pair by pair.

    a, b: (offsets, mz, intensity), mz ascending in each list. Peaks match where b's mz is within tol of a's, or is
    after adding shift, if shift is larger than tol.
    """
    (a_at, a_mz, a_in), (b_at, b_mz, b_in) = a, b
    n = len(shift)
    pair = np.repeat(np.arange(n), np.diff(a_at))
    lengths = np.diff(b_at)
    rows, columns = [], []
    # Every peak of a with every place of its partner's list, place by place: lists are short.
    for j in range(int(lengths.max(initial=0))):
        own = np.flatnonzero(lengths[pair] > j)
        if not len(own):
            break
        at = b_at[pair[own]] + j
        m, s = b_mz[at], shift[pair[own]]
        lo, hi = a_mz[own] - tol, a_mz[own] + tol
        met = ((m >= lo) & (m <= hi)) | ((np.abs(s) > tol) & (m + s >= lo) & (m + s <= hi))
        rows.append(own[met])
        columns.append(at[met])
    out = np.zeros(n)
    if rows:
        i, j = np.concatenate(rows), np.concatenate(columns)
        product = a_in[i] * b_in[j]
        order = np.lexsort((j, i, -product))
        i, j, product = i[order], j[order], product[order]
        place = np.arange(len(i))
        taken = np.zeros(len(i), dtype=bool)
        while len(place):
            # The best match left of each peak on either side; one that is best for both is taken.
            first_i, first_j = np.full(len(a_mz), len(order)), np.full(len(b_mz), len(order))
            np.minimum.at(first_i, i[place], place)
            np.minimum.at(first_j, j[place], place)
            best = place[(first_i[i[place]] == place) & (first_j[j[place]] == place)]
            taken[best] = True
            used_i, used_j = np.zeros(len(a_mz), dtype=bool), np.zeros(len(b_mz), dtype=bool)
            used_i[i[best]], used_j[j[best]] = True, True
            place = place[~used_i[i[place]] & ~used_j[j[place]]]
        out = np.bincount(pair[i[taken]], weights=product[taken], minlength=n)
    scale = _norms(a_at, a_in) * _norms(b_at, b_in)
    return np.divide(out, scale, out=np.zeros(n), where=scale > 0)


def modified_cosines(pairs: DataFrame, keep: list[str], a: str, b: str, shift: str, tol: float) -> DataFrame:
    """keep and sim of each row of pairs; a and b are peak lists (weighted already), shift is added to b's mz."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                left, right, moved = (part.column(len(keep) + k) for k in range(3))
                sim = cosines(_flat(left), _flat(right), moved.to_numpy(zero_copy_only=False), tol)
                yield pa.record_batch([*part.columns[: len(keep)], pa.array(sim, pa.float64())], [*keep, "sim"])

    types = dict(pairs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "sim double"])
    return pairs.select(*keep, a, b, F.col(shift).cast("double")).mapInArrow(run, schema)

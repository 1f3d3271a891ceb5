"""The best weighted Tanimoto of each row over its group's anchors, most pairs being ruled out by bounds.

A Tanimoto is at most the smaller popcount over the larger, so weight * min / max bounds what an anchor can give. Rows
and anchors of a group are packed into blocks of bounded size; a large group has several, by bands of weight and
popcount. Each block of rows first meets the block of anchors of the greatest bound; of the others only those whose
bound beats the least of the block's best values so far. Within a pair of blocks anchors go by falling weight, and a
row leaves when no weight that is left can beat its best. Bits are counted in numpy on Arrow batches: where many anchors
have a weight, tile by tile, for of equal weight and popcount the anchor that shares most bits is the best one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .joins import bounded_broadcast, durable, stored

#: Rows of a block, anchors of a block; rows that are worked on at once.
ROWS, ANCHORS, STEP = 8192, 16384, 1 << 14
#: Anchors of a weight from which pairs are counted in tiles; rows and anchors of a tile.
RUN, TILE = 32, (256, 256)
#: Parts that the lists of a block of rows are dealt into; tasks of a stage at most.
PIECES, MOST_TASKS = 8, 4096


def best_values(words, pops, ids, block, a_words, a_pops, a_ids, a_weights, a_at, best) -> int:
    """Raises best (a value for each row) to the greatest weight * Tanimoto over the row's anchors; the pairs it compared.

    block: the pair of blocks that each row is in; a_at: where the anchors of each pair of blocks start, by falling
    weight. A row and an anchor of equal ids don't meet.
    """
    pairs = np.arange(len(a_at) - 1)
    runs = np.bincount(np.repeat(pairs, np.diff(a_at))[np.flatnonzero(_starts(a_weights, a_at))], minlength=len(pairs))
    tiled = np.diff(a_at) >= RUN * np.maximum(runs, 1)
    if not tiled.any():
        return _one_by_one(words, pops, ids, block, a_words, a_pops, a_ids, a_weights, a_at, best)
    compared, at = 0, np.searchsorted(block, np.arange(len(a_at)))
    for k in np.flatnonzero(tiled):
        own, of = slice(at[k], at[k + 1]), slice(a_at[k], a_at[k + 1])
        compared += _in_tiles(words[own], pops[own], ids[own], a_words[of], a_pops[of], a_ids[of], a_weights[of], best[own])
    rest = np.flatnonzero(~tiled[block])
    if len(rest):
        mine = best[rest]
        compared += _one_by_one(words[rest], pops[rest], ids[rest], block[rest], a_words, a_pops, a_ids, a_weights, a_at, mine)
        best[rest] = mine
    return compared


def _starts(a_weights: np.ndarray, a_at: np.ndarray) -> np.ndarray:
    """Where a run of anchors of equal weight starts, in a pair of blocks."""
    first = np.diff(a_weights, prepend=np.inf) != 0
    first[a_at[:-1][np.diff(a_at) > 0]] = True
    return first


def _packed(words: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same bits in half as many words, where none uses its upper half."""
    if words.shape[1] < 2 or (words >> np.uint64(32)).any() or (others >> np.uint64(32)).any():
        return words, others
    half = lambda x: x[:, ::2] | np.pad(x[:, 1::2], ((0, 0), (0, x.shape[1] % 2))) << np.uint64(32)
    return half(words), half(others)


def _in_tiles(words, pops, ids, a_words, a_pops, a_ids, a_weights, best) -> int:
    """best_values of one pair of blocks, anchors by falling weight."""
    compared, by_pop = 0, np.argsort(pops, kind="stable")
    words, a_words = _packed(words, a_words)
    order = np.lexsort((a_pops, -a_weights))
    words, a_words, a_pops, a_ids, a_weights = np.ascontiguousarray(words[by_pop].T), np.ascontiguousarray(a_words[order].T), a_pops[order], a_ids[order], a_weights[order]
    pops, ids, mine = pops[by_pop], ids[by_pop], best[by_pop]
    same = len(np.intersect1d(ids, a_ids)) > 0
    # Anchors of equal weight and popcount are a run, and long runs are cut to tiles.
    first = np.flatnonzero((np.diff(a_weights, prepend=np.inf) != 0) | (np.diff(a_pops, prepend=-1) != 0))
    w, ap, ends = a_weights[first], a_pops[first].astype(float), np.append(first[1:], len(a_pops))
    for lo in range(0, len(pops), TILE[0]):
        p, value = pops[lo : lo + TILE[0]].astype(float), mine[lo : lo + TILE[0]]
        ratio = np.where(p[-1] < ap, p[-1] / np.maximum(ap, 1), np.where(ap < p[0], ap / max(p[0], 1), 1.0))
        bound = w * ratio
        # The most promising runs first: what they give rules others out.
        left = np.argsort(-bound, kind="stable")
        while len(left := left[bound[left] > value.min()]):
            n = max(1, int(np.searchsorted(np.cumsum(ends[left] - first[left]), TILE[1], side="right")))
            some, left = left[:n], left[n:]
            at = np.concatenate([np.arange(first[r], ends[r]) for r in some])
            starts = np.concatenate([[0], np.cumsum(ends[some] - first[some])[:-1]])
            for cut in range(0, len(at), 8 * TILE[1]) if n == 1 else (0,):
                own = at[cut : cut + 8 * TILE[1]] if n == 1 else at
                both = np.zeros((len(p), len(own)), dtype=np.uint16) if len(words) != 1 else np.bitwise_count(words[0, lo : lo + TILE[0], None] & a_words[0, own])
                for c, a in zip(words, a_words, strict=True) if len(words) > 1 else ():
                    both += np.bitwise_count(c[lo : lo + TILE[0], None] & a[own])
                if same:
                    both[ids[lo : lo + TILE[0], None] == a_ids[own]] = 0
                most = (both.max(axis=1)[:, None] if n == 1 else np.maximum.reduceat(both, starts, axis=1)).astype(float)
                either = p[:, None] + ap[some] - most
                np.maximum(value, (w[some] * np.divide(most, either, out=np.zeros_like(most), where=either > 0)).max(axis=1), out=value)
                compared += both.size
    best[by_pop] = mine
    return compared


def _one_by_one(words, pops, ids, block, a_words, a_pops, a_ids, a_weights, a_at, best) -> int:
    """best_values where weights differ: of each row the next anchor that may beat its best."""
    compared = 0
    columns, a_columns = ([np.ascontiguousarray(c) for c in x.T] for x in (words, a_words))
    for lo in range(0, len(words), STEP):
        p, mine, place = pops[lo : lo + STEP], best[lo : lo + STEP], np.arange(min(STEP, len(words) - lo))
        k, end = a_at[block[lo : lo + STEP]], a_at[block[lo : lo + STEP] + 1]
        while True:
            # Anchors go by falling weight: a row whose best is as great is done.
            going = k < end
            going[going] = a_weights[k[going]] > mine[place[going]]
            if not going.all():
                place, k, end = place[going], k[going], end[going]
            if not len(place):
                break
            pp, ap, w = p[place], a_pops[k], a_weights[k]
            low, high = np.minimum(pp, ap), np.maximum(pp, ap)
            may = np.flatnonzero((w * np.divide(low, high, out=np.zeros(len(low)), where=high > 0) > mine[place]) & (ids[lo + place] != a_ids[k]))
            if len(may):
                row, of = place[may], k[may]
                both = np.zeros(len(may), dtype=np.int64)
                for c, a in zip(columns, a_columns, strict=True):
                    both += np.bitwise_count(c[lo + row] & a[of])
                either = pp[may] + ap[may] - both
                mine[row] = np.maximum(mine[row], w[may] * np.divide(both, either, out=np.zeros(len(may)), where=either > 0))
                compared += len(may)
            k = k + 1
    return compared


def _words(lists: pa.Array, wide: int) -> np.ndarray:
    """Lists of long words as a matrix, short and null ones filled up with zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), wide), dtype=np.int64)
    if len(flat):
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, sizes)
        row = np.repeat(np.arange(len(lists)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.view(np.uint64)


def _inner(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and values of a column of lists of structs."""
    at = np.asarray(column.offsets)
    return at - at[0], column.values.slice(at[0], at[-1] - at[0])


def _met(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, int]:
    """Of (..., rows, anchors, best so far or null): where rows start, their numbers and best values, pairs compared."""
    n = batch.num_columns - 3
    (at, own), (a_at, anchors) = _inner(batch.column(n)), _inner(batch.column(n + 1))
    wide = max(np.diff(np.asarray(x.field("fp").offsets)).max(initial=0) for x in (own, anchors))
    block, pair = np.repeat(np.arange(batch.num_rows), np.diff(at)), np.repeat(np.arange(batch.num_rows), np.diff(a_at))
    weights = anchors.field("weight").to_numpy(zero_copy_only=False)
    order = np.lexsort((-weights, pair))
    before = batch.column(n + 2)
    best = before.flatten().to_numpy(zero_copy_only=False).copy() if before.null_count == 0 else np.zeros(len(block))
    pops, a_pops = (np.nan_to_num(x.field("pop").to_numpy(zero_copy_only=False).astype(float)).astype(np.int64) for x in (own, anchors))
    ids, a_ids = (x.field("id").to_numpy(zero_copy_only=False) for x in (own, anchors))
    compared = best_values(_words(own.field("fp"), wide), pops, ids, block, _words(anchors.field("fp"), wide)[order], a_pops[order], a_ids[order], weights[order], a_at, best)
    return at, own.field("n"), best, compared


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row of a block: its number, its best value, and (once) the pairs compared."""
    for batch in batches:
        _, numbers, best, compared = _met(batch)
        counts = np.zeros(len(best), dtype=np.int64)
        counts[:1] = compared
        yield pa.record_batch([numbers, pa.array(best), pa.array(counts)], ["n", "v", "compared"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is kept of a block, and lists of its rows' numbers and best values."""
    for batch in batches:
        at, numbers, best, compared = _met(batch)
        counts = np.zeros(batch.num_rows, dtype=np.int64)
        counts[:1] = compared
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), x) for x in (numbers, pa.array(best))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *lists, pa.array(counts)], [*batch.schema.names[:-3], "n", "v", "compared"])


def _blocked(df: DataFrame, by: list[str], most: int, band) -> DataFrame:
    """df with __block: 0 in groups of at most ``most`` rows; in larger ones by band, and by hash where a band is larger."""
    large = df.groupBy(*by, band.alias("__band")).agg(F.count("*").alias("__n"))
    totals = large.groupBy(*by).agg(F.sum("__n").alias("__all")).where(F.col("__all") > most)
    # Few groups have more than a block's rows: a row of this table stands for that many.
    sizes = large.join(totals, by).select(*by, "__band", F.ceil(F.col("__n") / most).alias("__parts"))
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.col("__parts"))
    met = df.withColumn("__band", band).join(bounded_broadcast(sizes), [*by, "__band"], "left")
    return met.withColumn("__block", F.when(F.col("__parts").isNull(), F.struct(F.lit(0).alias("band"), F.lit(0).cast("long").alias("part"))).otherwise(F.struct(F.col("__band").alias("band"), part.alias("part")))).drop("__band", "__parts")


def weighted_best(rows: DataFrame, anchors: DataFrame, by: list[str], name: str = "best", counted: str | None = None, apart: tuple[str, str] | None = None, few_anchors: bool = False) -> DataFrame:
    """rows with the greatest weight * Tanimoto over the anchors of their group (0 without any), and has_anchors.

    rows: by, fp (long words), popcount, anything else; anchors: by, a_fp, a_pop, weight. Groups (equal columns ``by``,
    none of them null) may have any number of either. counted: a column of the pairs whose bits were compared, which
    sum up to all of them. apart: whole-number columns of rows and anchors; a pair that agrees in them is left out.
    few_anchors: the caller vouches that no group has more than a block of anchors (as a search's top list), so they
    are neither counted nor divided.
    """
    # Both are counted before they are packed, and rows get numbers: they are kept, or all that makes them would run again.
    numbered = stored(rows.withColumn("__n", F.monotonically_increasing_id()))
    known = anchors.where((F.col("weight") > 0) & F.col("a_fp").isNotNull())
    known = known if few_anchors else durable(known)
    pop_band = lambda c: F.floor(F.log(F.coalesce(c, F.lit(0)) + 1.0) * 8).cast("int")
    weight_band = F.floor(-2 * F.log2("weight")).cast("int") * 1000
    # Ids that are null, or that nobody asked for, differ from all others.
    own_id, a_id = (F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(null)) for c, null in zip(apart, (-(2**63), -(2**63) + 1), strict=True)) if apart else (F.lit(0).cast("long"), F.lit(1).cast("long"))
    own = _blocked(numbered.select(*by, "fp", "popcount", F.col("__n").alias("n"), own_id.alias("id")), by, ROWS, pop_band(F.col("popcount")))
    of = known.select(*by, "weight", "a_fp", "a_pop", a_id.alias("id"))
    of = of.withColumn("__block", F.lit(0)) if few_anchors else _blocked(of, by, ANCHORS, weight_band + pop_band(F.col("a_pop")))
    cells = own.groupBy(*by, F.col("__block").alias("__c")).agg(
        F.collect_list(F.struct("n", "fp", F.col("popcount").alias("pop"), "id")).alias("__rows"), F.min("popcount").alias("__lo"), F.max("popcount").alias("__hi")
    )
    lists = of.groupBy(*by, F.col("__block").alias("__a")).agg(
        F.collect_list(F.struct(F.col("a_fp").alias("fp"), F.col("a_pop").alias("pop"), "weight", "id")).alias("__anchors"),
        F.max("weight").alias("__w"), F.min("a_pop").alias("__alo"), F.max("a_pop").alias("__ahi"),
    )
    # The best ratio of popcounts that two ranges allow: 1 where they overlap.
    ratio = F.when(F.col("__hi") < F.col("__alo"), F.col("__hi") / F.col("__alo")).when(F.col("__ahi") < F.col("__lo"), F.col("__ahi") / F.col("__lo")).otherwise(1.0)
    bound = F.col("__w") * F.coalesce(ratio, F.lit(1.0))
    none = F.lit(None).cast("array<double>").alias("__best")
    kept = [*by, "__c", "__a", "__lo", "__hi"]
    first = lists.groupBy(*by).agg(F.max_by(F.struct("__a", "__anchors"), F.struct("__w", "__a")).alias("__f"), F.count("*").alias("__lists"))
    met = cells.join(first, by).select(*kept[:-3], "__lo", "__hi", "__f.*", "__lists", "__rows", none)
    flat = "n long, v double, compared long"
    if not few_anchors:
        # Blocks are few bytes and much work: tasks are counted by rows, or adaptive execution puts all blocks into a few.
        tasks = min(max(2 * numbered.count() // ROWS, numbered.sparkSession.sparkContext.defaultParallelism), MOST_TASKS)
        parts = numbered.groupBy(*by).agg(F.least(F.ceil(F.count("*") / ROWS), F.lit(PIECES)).alias("__parts"))
        lone, on = first.where("__lists = 1").join(parts, by), [*by, "__piece"]
        given = lone.select(*by, F.col("__f.__anchors").alias("__anchors"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__piece"))
        dealt = cells.join(lone.select(*by, "__parts"), by).withColumn("__piece", F.pmod(F.xxhash64("__c"), F.col("__parts"))).select(*on, "__rows")
        few = dealt.repartition(tasks, *on).join(given.repartition(tasks, *on).hint("merge"), on).select("__rows", "__anchors", none)
    else:
        few = met.select("__rows", "__anchors", "__best")
    few = few.mapInArrow(_flat, flat)

    def of_many() -> DataFrame:
        """Larger groups: the best list first, then those whose bound beats the least value that it left in the block."""
        many = met.where("__lists > 1").select(*kept, "__rows", "__anchors", "__best").repartition(tasks, *by, "__c")
        listed = StructType([*many.schema.fields[: len(kept)], StructField("n", ArrayType(LongType())), StructField("v", ArrayType(DoubleType())), StructField("compared", LongType())])
        start = many.mapInArrow(_listed, listed)
        open_ = start.select(*by, "__c", F.col("__a").alias("__met"), "__lo", "__hi", F.array_min("v").alias("__least"), F.map_from_arrays("n", "v").alias("__seen"))
        later = open_.join(lists, by).where((F.col("__a") != F.col("__met")) & (bound > F.col("__least"))).drop("__lo", "__hi")
        on = [*by, "__c", "__piece"]
        pieces = cells.select(*by, "__c", "__rows", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("__piece")).repartition(tasks, *on)
        later = later.withColumn("__piece", F.pmod(F.xxhash64("__a"), F.lit(PIECES)).cast("int")).repartition(tasks, *on)
        again = later.join(pieces.hint("shuffle_hash"), on).select("__rows", "__anchors", F.transform("__rows", lambda r: F.col("__seen")[r["n"]]).alias("__best"))
        rest = again.mapInArrow(_flat, flat)
        each = start.select(F.explode(F.arrays_zip("n", "v")).alias("z"), (F.col("compared") / F.size("n")).alias("c")).select("z.n", "z.v", "c")
        return each.unionByName(rest.select("n", "v", F.col("compared").cast("double").alias("c")))

    every = few.select("n", "v", F.col("compared").cast("double").alias("c"))
    every = every if few_anchors else every.unionByName(of_many())
    values = every.groupBy(F.col("n").alias("__n")).agg(F.max("v").alias("__v"), F.sum("c").alias("__k"))
    own = [F.col(f"`{c}`") for c in rows.columns]
    told = [F.coalesce("__k", F.lit(0.0)).alias(counted)] if counted else []
    return numbered.join(values, "__n", "left").select(*own, F.coalesce("__v", F.lit(0.0)).alias(name), F.col("__v").isNotNull().alias("has_anchors"), *told)

"""A similarity join of documents by the Jaccard index of their word shingles, by parity sketches.

Words are maximal runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct
shingles of ``words`` words; a shorter document's only shingle is all its words. Two documents link where
100 * intersection >= percent * union. No link is lost, and each is verified on the sets themselves.

Two sets of a and b shingles that link differ in at most d = (a + b)(100 - percent) / (100 + percent).
Shingles are dealt by hash into P parts, P being fixed for a band of sizes, and each part's hashes are
XORed: a parity sketch, of which at most d parts differ. So among any d + 1 parts one is equal. A document
offers the sketches of its first d + 1 parts that hold enough shingles to tell documents apart (d for the
most different partner its size allows). The first such part that two linked documents have in common is
among what both offer, for before it both have only parts that differ. Should a document have too few such
parts, it offers those of another deal as well, and so does any partner that was missed for that reason;
the last deal takes parts however small. Documents near the border of a band take part in the next one.

Documents with equal sets become one node before anything is joined. Nodes that share a part's sketch meet
in a bucket, where whole parity sketches are compared, whose Hamming distance is at most the symmetric
difference. First, in a share of the buckets, each node is linked to the nearest one of another component
in its block of the bucket; after that, all pairs between components that sizes and sketches allow are verified, in all buckets that
still hold several. There, blocks of nodes of a bucket's largest component meet blocks of all
others, and those meet each other: no task holds a whole bucket, nodes of the largest component are not paired,
and no pair of different components is left out. Keys of very many nodes are found beforehand by a sample, and
their nodes go to their buckets without passing through one task.

A null or wordless text has the empty set, links with nothing and is its own component. component_id is the
least doc_id reachable. Rows with null ids take part; their component is the least id of the others, or
null. Repeated rows stay as they are. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut, release, ship, sized, tidied, working
from .components import components
from .wordhash import hashes_in, mixed, run_hashes, words_in

#: How many times the least size the sizes of a band go up to; spare parts as a share of those needed.
BAND, SPARE = 1.5, 0.35
#: Deals of shingles into parts; the last one takes parts of any size.
DEALS = 4
SKETCH_BITS = 1024
#: Nodes in a block of a bucket; those of the buckets (one in so many) that the first turns look at.
BLOCK, FIRST_TURNS = 512, (8, 4)
#: A key that this many nodes share is hot, as one node in HOT_SHARE tells; so many hot keys are listed at most.
HOT_NODES, HOT_SHARE, HOT_KEYS = 2048, 32, 10_000
#: Sets that a task remembers so as to offer each once.
SEEN = 2_000_000
_DEAL = np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Rule:
    words: int = 5
    percent: int = 80

    def most_apart(self, n: int, largest: int | None = None) -> int:
        """The largest symmetric difference of a set of n and a linked one (of at most largest)."""
        other = 100 * n // self.percent
        return (n + (other if largest is None else min(other, largest))) * (100 - self.percent) // (100 + self.percent)

    def band(self, n: int) -> tuple[int, int, int]:
        """(number, least size, first size beyond) of the band of n."""
        growth, k, low = max(BAND, 100 / self.percent + 0.1), 0, 1
        while True:
            beyond = max(low + 1, int(np.ceil(low * growth)))
            if n < beyond:
                return k, low, beyond
            k, low = k + 1, beyond

    def bands(self, n: int) -> list[tuple[int, int, int, int]]:
        """For each band in which n offers sketches: its number, parts, shingles that a part needs, and d."""
        k, low, beyond = self.band(n)
        found = [(k, self._parts(beyond - 1), self._needs(beyond - 1), self.most_apart(n))]
        if k and -(-self.percent * n // 100) < low:
            _, _, beyond = self.band(low - 1)
            found.append((k - 1, self._parts(beyond - 1), self._needs(beyond - 1), (n + beyond - 1) * (100 - self.percent) // (100 + self.percent)))
        return found

    def _parts(self, largest: int) -> int:
        d = self.most_apart(largest)
        return d + 1 if d == 0 else int(np.ceil((1 + SPARE) * (d + 1))) + 1

    def _needs(self, largest: int) -> int:
        return 2 if self.most_apart(largest) >= 3 else 1


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's set. Words of all texts are hashed at once."""
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b" ".join(raws), dtype=np.uint8)
    starts, ends = words_in(raw)
    hashes = hashes_in(raw, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws])).tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        yield np.unique(run_hashes(hashes[lo:hi], min(words, hi - lo))) if hi > lo else np.zeros(0, dtype=np.uint64)


def node_of(own: np.ndarray) -> int:
    return int(mixed(mixed(own + _DEAL).sum(dtype=np.uint64)[None] + np.uint64(len(own)))[0].astype(np.int64))


def sketch_of(own: np.ndarray) -> np.ndarray:
    parity = np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def offered(own: np.ndarray, rule: Rule, cache: dict) -> np.ndarray:
    """Keys of the part sketches that a set offers."""
    keys = []
    n = len(own)
    if n not in cache:
        cache[n] = rule.bands(n)
    for band, parts, needs, apart in cache[n]:
        for deal in range(DEALS):
            dealt = own if deal == 0 else np.sort(mixed(own + _DEAL * np.uint64(deal)))
            part = ((dealt >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums, sizes, names = np.bitwise_xor.reduceat(dealt, starts), np.diff(np.append(starts, n)), part[starts]
            if deal == DEALS - 1:  # parts of any size, empty ones included
                whole = np.zeros(parts, dtype=np.uint64)
                whole[names.astype(np.int64)] = sums
                sums, names = whole, np.arange(parts, dtype=np.uint64)
            else:
                held = sizes >= needs
                sums, names = sums[held], names[held]
            seed = mixed(np.array([(band << 40) + (deal << 36)], dtype=np.uint64) + _DEAL)
            keys.append(mixed(sums[: apart + 1] + mixed(names[: apart + 1] + seed)))
            if len(names) > apart:
                break
    return np.concatenate(keys).view(np.int64)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    offsets = np.cumsum([0] + [0 if a is None else len(a) for a in arrays])
    flat = np.concatenate([a for a in arrays if a is not None]) if offsets[-1] else np.zeros(0, np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(flat, pa.int64())).cast(pa.list_(pa.int64()))


def _noded(docs: DataFrame, rule: Rule) -> DataFrame:
    """n, node and sketch of each document, behind its columns but the text; a task gives each set's sketch once."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        seen: set[int] = set()
        for part in _slices(batches):
            sizes, nodes, sketches = [], [], []
            for own, node, new in _new_sets(part.column(len(kept)), rule, seen):
                sizes.append(len(own))
                nodes.append(node)
                sketches.append(sketch_of(own) if new else None)
            made = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), _lists(sketches)]
            yield pa.record_batch([*part.columns[: len(kept)], *made], [*kept, "n", "node", "sketch"])

    schema = "".join(f"{c} {t}, " for c, t in docs.dtypes if c != "text")
    return docs.select(*kept, "text").mapInArrow(tidied(run), f"{schema}n long, node long, sketch array<long>")


def _keyed(docs: DataFrame, rule: Rule) -> DataFrame:
    """(node, key): what each set offers, once for each task that holds it.

    Sets are made anew from the texts, for the keys of all documents would take more room than their texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        seen: set[int] = set()
        cache: dict = {}
        for part in _slices(batches):
            found = [(node, offered(own, rule, cache)) for own, node, new in _new_sets(part.column(0), rule, seen) if new]
            if found:
                nodes, keys = zip(*found, strict=True)
                yield pa.record_batch([pa.array(nodes, pa.int64()), _lists(list(keys))], ["node", "keys"])

    made = docs.select("text").mapInArrow(tidied(run), "node long, keys array<long>")
    return made.select("node", F.explode("keys").alias("key"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _new_sets(texts: pa.Array, rule: Rule, seen: set[int]) -> Iterator[tuple[np.ndarray, int | None, bool]]:
    """(set, node, whether it is new to seen) of each text."""
    for own in shingle_sets(texts.to_pylist(), rule.words):
        node = node_of(own) if len(own) else None
        new = node is not None and node not in seen
        if new and len(seen) < SEEN:
            seen.add(node)
        yield own, node, new


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """node and set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                owns = [own for own in shingle_sets(batch.column(0).slice(at, 200).to_pylist(), rule.words) if len(own)]
                if owns:
                    yield pa.record_batch([pa.array([node_of(o) for o in owns], pa.int64()), _lists([o.view(np.int64) for o in owns])], ["node", "own"])

    return docs.select("text").mapInArrow(tidied(run), "node long, own array<long>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets link. Only sets of nodes in a pair are moved."""
    pairs = cut(pairs)
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    some = sets.join(F.broadcast(wanted) if 2 * pairs.count() <= BROADCAST_IDS else wanted, "node", "left_semi")
    one = some.select(F.col("node").alias("u"), F.col("own").alias("mine"))
    other = some.select(F.col("node").alias("v"), F.col("own").alias("theirs"))
    both = F.size(F.array_intersect("mine", "theirs"))
    met = pairs.join(one, "u").join(other, "v").select("u", "v", (F.size("mine") + F.size("theirs")).alias("total"), both.alias("both"))
    return met.where(F.col("both") * 100 >= percent * (F.col("total") - F.col("both"))).select("u", "v")


def _hot(docs: DataFrame, rule: Rule) -> list[int]:
    """Keys that very many nodes share, as far as one text in HOT_SHARE tells: they need no look for a second node.

    They only decide how buckets are found; a key that is missed takes the common way to the same bucket.
    """
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(HOT_SHARE)) == 0)
    often = _keyed(some, rule).distinct().groupBy("key").count().where(F.col("count") >= HOT_NODES // HOT_SHARE)
    return [r.key for r in often.orderBy(F.desc("count"), "key").limit(HOT_KEYS).collect()]


def _buckets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, node) of the keys that several nodes offer.

    Neighbours in a key's order tell. Hot keys are known to be offered by several, so their nodes go to many tasks.
    """
    keys, hot = _keyed(docs, rule), _hot(docs, rule)
    if hot:
        listed = F.broadcast(docs.sparkSession.createDataFrame([(k, True) for k in hot], "key long, hot boolean"))  # HOT_KEYS at most
        keys = keys.join(listed, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        keys = keys.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(HOT_NODES))).otherwise(0))
    by_key = Window.partitionBy("key", *(["salt"] if hot else [])).orderBy("node")
    met = keys.withColumn("last", F.lag("node").over(by_key)).withColumn("next", F.lead("node").over(by_key))
    several = F.expr("last <> node or next <> node")
    return met.where(F.col("hot") | several if hot else several).select("key", "node").distinct()


def _placed(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(rows, (node, component) of every node): component is the least node of those that links reach.

    docs: doc_id long, text, and further columns. rows: all but the text, n (of shingles), node and sketch.
    """
    ship(docs.sparkSession)
    rows = cut(_noded(docs, rule))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.max(F.when(F.size("sketch") > 0, F.col("sketch"))).alias("sketch"), F.max("n").alias("n"))
    all_nodes = nodes.select("node")
    buckets = cut(_buckets(docs, rule))
    size = buckets.count()
    if not size:
        return rows, all_nodes.select("node", F.col("node").alias("component"))
    release(docs.sparkSession)
    buckets = sized(buckets, size)
    touched = cut(sized(buckets.select("node").distinct().join(nodes, "node"), size))
    n = touched.count()
    wanted = touched.select(F.col("least").alias("id")).distinct()
    some = docs.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    of_touched = _sets(some, rule).join(touched.select("node"), "node", "left_semi")
    sets = cut(of_touched.groupBy("node").agg(F.first("own").alias("own")).coalesce(max(8, -(-n // 20_000))))
    links = _all_links(buckets, touched, sets, rule, size)
    return rows, all_nodes.join(links, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _with_first(rows: DataFrame, order: Column) -> DataFrame:
    """rows with the least order of their component as first.

    Components of several rows are looked up, in a broadcast if they are few, so that no large one has to pass
    through one task; a row alone in its component is the first.
    """
    several = cut(rows.groupBy("component").agg(F.min(order).alias("least_of_all"), F.count("*").alias("n")).where("n > 1").drop("n"))
    known = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    return rows.join(known, "component", "left").withColumn("first", F.coalesce("least_of_all", order)).drop("least_of_all")


def components_by_jaccard(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    rows, placed = _placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rule)
    known = rows.select("doc_id", F.col("n").alias("n_shingles"), "node")
    of_node = known.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = of_node.join(placed, "node")
    placed = _with_first(placed, F.col("least")).select("node", F.col("first").alias("component_id"))
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return known.join(placed, "node", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def later_copies(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, text_hash) of the rows of docs that a row before them in their component stands for.

    Rows are told apart by id and text: first is the least id (null last), then the least text_hash, which
    is xxhash64 of the text. Rows that are equal in both are one row here. Texts without words are in nobody's component.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    known, placed = _placed(own, rule)
    rows = known.where("node is not null").select("doc_id", "text_hash", "node").distinct().join(placed, "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return _with_first(rows, order).where(order != F.col("first")).select("doc_id", "text_hash")


def _all_links(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, rule: Rule, rows: int) -> DataFrame:
    """(node, component) over all links between nodes that share a bucket."""
    links, label, left = None, None, buckets
    for share in (*FIRST_TURNS, 1):
        if label is None:
            now = left.select("key", "node", F.col("node").alias("c"))
        else:
            now = left.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        # Of each bucket: its nodes, and the component that most of them are in.
        per = now.groupBy("key", "c").agg(F.count("*").alias("m"))
        several = per.groupBy("key").agg(F.sum("m").alias("size"), F.max("m").alias("most"), F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
        left = cut(sized(now.join(several.drop("kinds"), "key"), rows))
        near = _near(left.where(F.pmod(F.xxhash64("key", F.lit(share)), F.lit(share)) == 0), nodes, rule, share > 1)
        got = _linked(near, sets, rule.percent)
        links = cut(sized(got if links is None else links.union(got), rows))
        label = components(links)
        if share > 1:
            label = cut(label)
    return label


def _near(rows: DataFrame, nodes: DataFrame, rule: Rule, nearest: bool) -> DataFrame:
    """Pairs (u, v) of nodes of rows (key, node, c, size, main, most) in one bucket but not one component, which may link.

    nearest: only the nearest such node for each, among those of its own block. Otherwise every pair: blocks of
    the ``most`` nodes of the bucket's main component meet blocks of its other nodes, and those meet each other.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = F.xxhash64("node", "key")
    cell = lambda kind, i, j, home: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("cell"), F.lit(home).alias("home"))
    if nearest:
        cells = rows.withColumn("at", F.array(cell(0, F.pmod(place, blocks(F.col("size"))), F.lit(0), True)))
    else:
        main, other = blocks(F.col("most")), blocks(F.col("size") - F.col("most"))
        of_main = F.transform(every(other), lambda j: cell(1, F.pmod(place, main), j, True))
        own = F.pmod(place, other)
        visits = F.transform(every(main), lambda i: cell(1, i, own, False))
        met = F.transform(every(other), lambda j: cell(2, F.least(own, j), F.greatest(own, j), True))
        cells = rows.withColumn("at", F.when(F.col("c") == F.col("main"), of_main).otherwise(F.concat(visits, met)))
    cells = cells.select("node", "c", F.explode("at").alias("at")).select("at.cell", "at.home", "node", "c").join(nodes.select("node", "n", "sketch"), "node")
    dealt = cells.repartition("cell").sortWithinPartitions("cell").select("cell", "node", "c", "n", "home", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        for cell, node, c, n, home, sketch in _whole_cells(batches):
            for u, v, apart in _allowed(cell, c, n, home, sketch, rule):
                a, b = node[u], node[v]
                if nearest:
                    for x, y in ((a, b), (b, a)):
                        order = np.argsort(apart, kind="stable")
                        for i, j, d in zip(x[order].tolist(), y[order].tolist(), apart[order].tolist(), strict=True):
                            if i not in best or d < best[i][0]:
                                best[i] = (d, j)
                else:
                    new = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) - seen
                    if new:
                        yield _pairs(new)
                    if len(seen) < SEEN:
                        seen |= new
            if len(best) > SEEN:
                yield _pairs({(i, j) for i, (_, j) in best.items()})
                best = {}
        if best:
            yield _pairs({(i, j) for i, (_, j) in best.items()})

    pairs = dealt.mapInArrow(tidied(run), "u long, v long")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True)
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows in the order of their cells, cut only between cells; sketches are a matrix."""
    held: list[tuple[np.ndarray, ...]] = []

    def joined() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        flat = batch.column(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(batch.num_rows, -1)
        cut_at = np.flatnonzero(columns[0] != columns[0][-1])
        at = int(cut_at[-1]) + 1 if len(cut_at) else 0
        if held and (at or held[-1][0][-1] != columns[0][0]):
            first = int(np.searchsorted(columns[0] != held[-1][0][-1], True)) if at else 0
            held.append(tuple(x[:first] for x in (*columns, flat)))
            yield joined()
            held = []
            if first < at:
                yield tuple(x[first:at] for x in (*columns, flat))
        elif at:
            yield tuple(x[:at] for x in (*columns, flat))
        held.append(tuple(x[at:] for x in (*columns, flat)))
    if held:
        yield joined()


#: Cells of at most so many rows are compared by shifts of all rows at once.
FEW = 24


def _allowed(cell: np.ndarray, c: np.ndarray, n: np.ndarray, home: np.ndarray, sketch: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, distance of their sketches) of the pairs of each cell that may link, one of them at home."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.append(starts, len(cell)))
    few = np.repeat(sizes <= FEW, sizes)
    for shift in range(1, min(FEW, int(sizes.max()))):
        u = np.flatnonzero((cell[:-shift] == cell[shift:]) & (c[:-shift] != c[shift:]) & (home[:-shift] | home[shift:]) & few[:-shift])
        if len(u):
            yield from _kept(u, u + shift, np.bitwise_count(sketch[u] ^ sketch[u + shift]).sum(axis=1, dtype=np.int64), n, rule)
    for lo, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        signs = np.unpackbits(np.ascontiguousarray(sketch[lo : lo + size]).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        for at in range(0, size, 1024):
            apart = (SKETCH_BITS - signs[at : at + 1024] @ signs[at:].T) / 2
            own, other = n[lo + at : lo + min(at + 1024, size)], n[lo + at : lo + size]
            fits = apart * (100 + rule.percent) <= (own[:, None] + other[None, :]) * (100 - rule.percent)
            fits &= c[lo + at : lo + at + len(own), None] != c[None, lo + at : lo + size]
            fits &= home[lo + at : lo + at + len(own), None] | home[None, lo + at : lo + size]
            u, v = np.nonzero(np.triu(fits, 1))
            if len(u):
                yield from _kept(lo + at + u, lo + at + v, apart[u, v].astype(np.int64), n, rule)


def _kept(u: np.ndarray, v: np.ndarray, apart: np.ndarray, n: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    small, large = np.minimum(n[u], n[v]), np.maximum(n[u], n[v])
    fits = (small * 100 >= large * rule.percent) & (apart * (100 + rule.percent) <= (small + large) * (100 - rule.percent))
    if fits.any():
        yield u[fits], v[fits], apart[fits]

"""Exact repeats across a corpus, in a few steps that byte strings and word windows share.

Documents are dealt by a hash into batches of bounded size. A batch is worked on as a whole (its State, which is
made again in each step, for it depends on the texts alone), and sends what has to meet other batches to buckets:

probes    Only where a rule knows references: grams that no reference has, or nothing else, are out.
grams     Each batch sends the distinct grams of its runs, in order and as a few bytes of difference to the one
          before, to the bucket that their leading bits name. A run is a few neighbouring windows that all hold its
          gram, and its segment is all that these windows can see. Where no other run has the gram, nothing of the
          run repeats. Runs with equal segments stand for each other: they are repeated whole, and one of them takes
          part in what follows.
suffixes  Segments that share a gram and differ are swept into suffix arrays with LCPs by suffix_family, level
          by level; the longest match of each start is exact.
texts     What repeats is marked in the documents.

However often a batch holds a gram with a segment, it sends it once. A gram with more than ``hot_kinds`` different
segments, such as one inside a passage that very many documents share, would be one task's work: its windows are
fingerprinted instead (128 bits) and met by fingerprint, which spreads them over all tasks; results are the same.

Rows of equal id and text have equal results. However many there are, two of them take part, so that what repeats in
them is seen; each tells how many rows it stands for, and is given back as often.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, cut, ship
from .suffix_family import Family, Segments, pack_arrays, spread, unpack_arrays

#: Code points in a batch, about, and those whose fingerprints a bucket gets.
BATCH_CHARS, BUCKET_CHARS = 4_000_000, 16_000_000
#: Rows that a row which stands for equal ones is given back as in one piece; pieces are dealt over tasks.
PIECE = 100_000
#: Different segments of a gram beyond which windows are met by fingerprint.
HOT_KINDS = 20_000
#: What rows hold. Told to batches: a run is repeated whole, or has to be sent, or its windows have; which starts match.
WHOLE, SENT, HOT, MATCHED = 1, 2, 3, 4
#: Told before that, where only some grams count: those that met a reference, and then the places that hold one.
MET, PLACES = 10, 11
#: Sent to buckets: grams, grams that only probe, segments, fingerprints of windows (and told: those that occur
#: elsewhere). Kept by an index: levels.
GRAMS, PROBES, SEGMENTS, LONG, BRIEF, LEVEL = 0, 9, 5, 6, 7, 8
ROW = "bucket long, batch long, start long, kind int, payload binary, more binary"
ARROW_ROW = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary()), ("more", pa.binary())])


def row(bucket: int, batch: int, kind: int, payload: bytes, start: int = 0, more: bytes | None = None) -> dict:
    return {"bucket": bucket, "batch": batch, "start": start, "kind": kind, "payload": payload, "more": more}


def table_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=ARROW_ROW)


def packed(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, the bytes of equal weight together."""
    if not len(values):
        return b""
    values = values.astype(np.uint64)
    gaps = np.diff(values, prepend=values[:1])
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + int(values[0]).to_bytes(8, "little") + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    width, first = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(raw, dtype=np.uint8, offset=9).reshape(width, -1)
    gaps = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(first)


@dataclass
class Sorted:
    """A batch's fingerprints: the distinct ones in order, how often each occurs, and which one each is."""

    distinct: np.ndarray
    counts: np.ndarray
    group: np.ndarray

    second: np.ndarray | None = None

    @classmethod
    def of(cls, prints: np.ndarray, bits: int, second: np.ndarray | None = None) -> "Sorted":
        """second: what tells equal fingerprints apart, if anything."""
        prints = prints >> np.uint64(64 - bits)
        order = np.argsort(prints, kind="stable") if second is None else np.lexsort((second, prints))
        ordered = prints[order]
        first = np.ones(len(ordered), dtype=bool)
        first[1:] = ordered[1:] != ordered[:-1]
        if second is not None:
            other = second[order]
            first[1:] |= other[1:] != other[:-1]
        starts = np.flatnonzero(first)
        group = np.empty(len(prints), dtype=np.int64)
        group[order] = np.cumsum(first) - 1
        return cls(ordered[starts], np.diff(np.append(starts, len(ordered))), group, None if second is None else other[starts])

    def all_of(self, entries: np.ndarray) -> np.ndarray:
        """All places of some distinct fingerprints."""
        some = np.zeros(len(self.distinct), dtype=bool)
        some[entries] = True
        return np.flatnonzero(some[self.group])

    def place(self) -> np.ndarray:
        """One place of each distinct fingerprint."""
        found = np.zeros(len(self.distinct), dtype=np.int64)
        found[self.group[::-1]] = np.arange(len(self.group))[::-1]
        return found

def bucket_of(prints: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The bucket that the leading bits of fingerprints name."""
    lead = prints >> np.uint64(bits - 32) if bits >= 32 else prints << np.uint64(32 - bits)
    return ((lead * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def rows_of(prints: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending fingerprints, for each bucket that has any."""
    own = bucket_of(prints, buckets, bits)
    if not len(own):
        return []
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return list(zip(own[starts].tolist(), starts.tolist(), np.append(starts[1:], len(own)).tolist(), strict=True))


def meet_prints(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Which of each row's fingerprints (two halves of 128 bits, all different within a row) another row has too."""
    if not rows:
        return []
    first, second = (np.concatenate(half) for half in zip(*rows, strict=True))
    order = np.lexsort((second, first))
    same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    met = np.zeros(len(order), dtype=bool)
    met[order[1:][same]] = True
    met[order[:-1][same]] = True
    return np.split(met, np.cumsum([len(one) for one, _ in rows])[:-1])


def shared(arrays: list[np.ndarray]) -> np.ndarray:
    """The values that stand in more than one place, ascending."""
    flat = np.sort(np.concatenate(arrays))
    twice = flat[1:][flat[1:] == flat[:-1]]
    return twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are known; both are ascending."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@dataclass
class GramLevel:
    """Grams in order, their segments' hashes, and whose they are."""

    gram: np.ndarray
    whole: np.ndarray
    batch: np.ndarray
    place: np.ndarray

    def columns(self) -> list[np.ndarray]:
        return [self.gram, self.whole, self.batch, self.place]

    @classmethod
    def of(cls, rows: list[dict], all_: bool) -> "GramLevel":
        """The entries of rows of grams; if not all, only of those that stand in more than one place."""
        grams = [unpacked(r["payload"]) for r in rows]
        several = None if all_ else shared(grams)
        parts = []
        for r, own in zip(rows, grams, strict=True):
            at = np.arange(len(own)) if all_ else np.flatnonzero(among(own, several))
            parts.append((own[at], np.frombuffer(r["more"], "<u8")[at], np.full(len(at), r["batch"], np.int64), at + r["start"]))
        new = cls(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        return new.take(np.argsort(new.gram, kind="stable"))

    def take(self, chosen: np.ndarray) -> "GramLevel":
        return GramLevel(*(c[chosen] for c in self.columns()))

    def merged(self, other: "GramLevel") -> "GramLevel":
        """Both as one: each entry of the other has its place behind those of its gram here."""
        place = np.searchsorted(self.gram, other.gram, "right") + np.arange(len(other.gram))
        mine = np.ones(len(self.gram) + len(other.gram), dtype=bool)
        mine[place] = False
        out = []
        for a, b in zip(self.columns(), other.columns(), strict=True):
            both = np.empty(len(mine), dtype=a.dtype)
            both[mine], both[place] = a, b
            out.append(both)
        return GramLevel(*out)


def _judged(new: GramLevel, levels: list[GramLevel], hot_kinds: int | None) -> list[dict]:
    """What entries of new, and those of levels with a gram of new, are told."""
    own = np.unique(new.gram)
    both = new
    for level in levels:
        both = both.merged(level.take(np.flatnonzero(among(level.gram, own))))
    if not len(both.gram):
        return []
    order = np.lexsort((both.place, both.batch, both.whole, both.gram))
    gram, whole = both.gram[order], both.whole[order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new_run = new_gram | np.concatenate([[True], whole[1:] != whole[:-1]])
    runs = np.flatnonzero(new_run)
    copies = np.diff(np.append(runs, len(order)))
    several = np.diff(np.append(np.flatnonzero(new_gram[runs]), len(runs)))
    kinds = np.repeat(several, several)
    hot = kinds > (hot_kinds or len(order) + 1)
    told = {WHOLE: order[np.repeat(copies > 1, copies)], SENT: order[runs[(kinds > 1) & ~hot]], HOT: order[np.repeat(hot, copies)]}
    out = []
    for kind, chosen in told.items():
        batch = both.batch[chosen]
        by = np.argsort(batch, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(batch[by])) + 1):
            if len(part):
                out.append(row(-1, int(batch[part[0]]), kind, packed(np.sort(both.place[chosen[part]]))))
    return out


def _alive(rows: list[dict]) -> list[dict]:
    """Rows of levels that none made of them stands for: each covers adds from start to batch."""
    rows = sorted(rows, key=lambda r: (-r["batch"], r["start"]))
    out, least = [], None
    for r in rows:
        if least is None or r["batch"] < least:
            out.append(r)
            least = r["start"]
    return out[::-1]


def _joining(sizes: list[int]) -> int:
    """How many of the last levels become one; sizes are those of all, the new one's last."""
    n = 1
    while n < len(sizes) and sizes[-n - 1].bit_length() <= sum(sizes[-n:]).bit_length():
        n += 1
    return n


def alone(meet):
    """A function of (key, rows, levels) where there are no levels."""
    return lambda key, table: meet(key, table, None)


def meet_grams(hot_kinds: int | None, add: int | None = None):
    def meet(key: tuple, table: pa.Table, levels: pa.Table | None) -> pa.Table:
        if table.num_rows and key[0].as_py() < 0:  # what a batch keeps for later
            return table
        rows = sorted(table.to_pylist(), key=lambda r: (r["batch"], r["start"]))
        if not rows:
            return table_of([])
        new = GramLevel.of(rows, add is not None)
        kept = _alive(levels.to_pylist()) if levels is not None else []
        old = [GramLevel(*unpack_arrays(r["payload"])) for r in kept]
        out = _judged(new, old, hot_kinds)
        if add is not None:
            joined = _joining([len(x.gram) for x in [*old, new]])
            level, since = new, add
            for r, x in list(zip(kept, old, strict=True))[::-1][: joined - 1]:
                level, since = x.merged(level), r["start"]
            out.append(row(key[0].as_py(), add, LEVEL, pack_arrays(level.columns()), since))
        return table_of(out)

    return meet


def told_of(table: pa.Table) -> dict[int, np.ndarray]:
    """Places told to a batch, by kind."""
    found: dict[int, list] = {}
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        if kind != MATCHED:
            found.setdefault(kind, []).append(unpacked(payload).astype(np.int64))
    return {kind: np.unique(np.concatenate(parts)) for kind, parts in found.items()}


def _sent(entries: Sorted, buckets: int, bits: int, batch: int, kind: int, start: int = 0) -> list[dict]:
    """Rows of entries, bucket by bucket, with what tells equal ones apart."""
    more = (lambda lo, hi: None) if entries.second is None else (lambda lo, hi: entries.second[lo:hi].tobytes())
    return [row(b, batch, kind, packed(entries.distinct[lo:hi]), start + lo, more(lo, hi)) for b, lo, hi in rows_of(entries.distinct, buckets, bits)]


def probe_step(rule, buckets: int):
    def probe(key: tuple, table: pa.Table) -> pa.Table:
        batch, (references, rolling) = key[0].as_py(), rule.state(table, None).probes()
        rows = _sent(references, buckets, rule.bits, batch, GRAMS)
        return table_of(rows + _sent(rolling, buckets, rule.bits, batch, PROBES, len(references.distinct)))

    return probe


def meet_probes(key: tuple, table: pa.Table) -> pa.Table:
    """Tells each batch which of its grams a reference has and something else too."""
    rows = table.to_pylist()
    grams = [unpacked(r["payload"]) for r in rows]
    references = [g for g, r in zip(grams, rows, strict=True) if r["kind"] == GRAMS]
    several = shared(grams)
    if references:
        several = several[among(several, np.sort(np.concatenate(references)))]
    out = []
    for r, own in zip(rows, grams, strict=True):
        at = np.flatnonzero(among(own, several)) if references else ()
        if len(at):
            out.append(row(-1, r["batch"], MET, packed(at + r["start"])))
    return table_of(out)


def first_step(rule, buckets: int):
    def first(key: tuple, table: pa.Table, answers: pa.Table | None) -> pa.Table:
        batch = key[0].as_py()
        state = rule.state(table, None if answers is None else told_of(answers))
        kept = [] if state.kept is None else [row(-1 - batch, batch, PLACES, packed(state.kept))]
        return table_of(kept + _sent(state.entries, buckets, 64, batch, GRAMS))

    return first


def second_step(rule, buckets: int):
    def second(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        batch, told = key[0].as_py(), told_of(answers)
        # What a batch keeps for its last turn passes by.
        rows = [row(-1 - batch, batch, kind, packed(told[kind])) for kind in (WHOLE, HOT, PLACES) if kind in told]
        if told.keys() & {SENT, HOT} and table.num_rows:
            state = rule.state(table, told)
            if SENT in told:
                own = state.segments(state.entries.place()[told[SENT]], batch)
                rows += [row(b, batch, SEGMENTS, own.take(np.arange(lo, hi)).packed()) for b, lo, hi in rows_of(own.group, buckets, 64)]
            if HOT in told:
                for kind, (_, entries) in _windows(state, told[HOT], rule).items():
                    rows += _sent(entries, buckets, 64, batch, kind)
        return table_of(rows)

    return second


def _windows(state, places: np.ndarray, rule) -> dict[int, tuple[np.ndarray, Sorted]]:
    """Starts of long and of brief windows of all runs of some entries, and their fingerprints."""
    low, counts, ends = state.spans(state.entries.all_of(places))
    starts, ends = spread(low, counts), np.repeat(ends, counts)
    found = {}
    for kind, size in ((LONG, rule.length), (BRIEF, rule.short)):
        own = np.unique(starts[starts + size <= ends])
        first, second = state.prints(own, size)
        found[kind] = own, Sorted.of(first, 64, second)
    return found


def _matched(found: list[tuple[Segments, np.ndarray]], rule) -> list[dict]:
    """Of each batch: its runs with a match, and which of their starts match long and in brief."""
    parts: dict[int, list] = {}
    for segments, best in found:
        if not len(segments):
            continue
        starts = segments.starts.astype(np.int64)
        begins = np.cumsum(starts) - starts
        some = np.flatnonzero(np.maximum.reduceat(best, begins) >= rule.short)
        for b in np.unique(segments.batch[some]) if len(some) else ():
            mine = some[segments.batch[some] == b]
            flat = best[spread(begins[mine], starts[mine])]
            parts.setdefault(int(b), []).append((segments.place[mine], np.packbits(flat >= rule.length), np.packbits(flat >= rule.short)))
    return [row(-1, b, MATCHED, pack_arrays(list(arrays))) for b, own in parts.items() for arrays in own]


def meet_suffixes(rule, add: int | None = None):
    def meet(key: tuple, table: pa.Table, levels: pa.Table | None) -> pa.Table:
        if table.num_rows and key[0].as_py() < 0:  # what a batch keeps for later
            return table
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["batch"], r["start"]))
        out = []
        for kind in (LONG, BRIEF):
            own = [r for r in rows if r["kind"] == kind]
            if own:
                masks = meet_prints([(unpacked(r["payload"]), np.frombuffer(r["more"], "<u8")) for r in own])
                out += [row(-1, r["batch"], kind, packed(np.flatnonzero(m) + r["start"])) for r, m in zip(own, masks, strict=True) if m.any()]
        kept = _alive(levels.to_pylist()) if levels is not None else []
        old = [Segments.unpacked(r["payload"]) for r in kept]
        own = [Segments.unpacked(r["payload"]) for r in rows if r["kind"] == SEGMENTS]
        new = Segments.joined(own) if own else Segments.none()
        if add is not None and old and len(new):  # a batch that was asked again sends what a level has already
            have = set(zip(*(np.concatenate([getattr(x, c) for x in old]).tolist() for c in ("batch", "place", "group")), strict=True))
            new = new.take(np.array([i for i, own in enumerate(zip(new.batch.tolist(), new.place.tolist(), new.group.tolist(), strict=True)) if own not in have], dtype=np.int64))
        if not len(new):
            return table_of(out)
        family = Family(old)
        if add is None:
            family.add_all(new)
        else:
            family.add(new)
            count = 1 + len(old) - (len(family.levels) - 1)
            since = add if count == 1 else kept[len(kept) - (count - 1)]["start"]
            out.append(row(key[0].as_py(), add, LEVEL, family.levels[-1].packed(), since))
        return table_of(out + _matched(family.found, rule))

    return meet


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of size places lie in a window of length from one of starts (all different)."""
    change = np.zeros(size + 1, dtype=np.int32)
    change[starts] = 1
    change[starts + length] -= 1
    return np.cumsum(change)[:size] > 0


def dealt(docs: DataFrame) -> tuple[DataFrame, int, int, bool]:
    """(docs as doc_id, text, k, times, batch; the logarithm of their size; buckets; whether any row stands for others).

    Of rows of the same id and text (told by 128 bits), two are kept at most, and times is the number of rows that
    each stands for. Batches and buckets are of bounded size, so that there are more of them the larger the corpus is.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("doc_id", "text", F.lit(29)).alias("other"))
    same = keyed.groupBy("k", "other").agg(F.count("*").alias("n"), F.max(F.length("text").cast("long")).alias("chars"))
    total, often = same.agg(F.sum(F.least("n", F.lit(2)) * F.col("chars")), F.count(F.when(F.col("n") > 2, 1))).first()
    total = total or 0
    rows = keyed.select("doc_id", "text", "k", F.lit(1).cast("long").alias("times"))
    if often:
        listed = cut(same.where("n > 2").select("k", "other", "n"))
        marked = keyed.join(F.broadcast(listed) if often <= BROADCAST_IDS else listed, ["k", "other"], "left")
        alone = marked.where("n is null").select("doc_id", "text", "k", F.lit(1).cast("long").alias("times"))
        # Tasks keep one of their equal rows each before any is moved.
        one = marked.where("n is not null").groupBy("k", "other").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "n")))
        rows = alone.union(one.select("doc_id", "text", "k", F.explode(F.array(F.col("n") - 1, F.lit(1).cast("long")))))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches, buckets = max(least, -(-total // BATCH_CHARS)), max(least, -(-total // BUCKET_CHARS))
    batch = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(batches).cast("long"))
    return rows.withColumn("batch", batch), int(total).bit_length(), buckets, bool(often)


def given_back(rows: DataFrame) -> DataFrame:
    """rows, each as often as its times says, without times."""
    names = [c for c in rows.columns if c != "times"]
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / PIECE))))
    spread_out = pieces.repartition(F.xxhash64(*names, "piece"))
    own = F.least(F.col("times") - F.col("piece") * PIECE, F.lit(PIECE)).cast("int")
    return spread_out.withColumn("piece", F.explode(F.array_repeat(F.lit(0), own))).select(*names)


def last_step(rule):
    def last(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        told = told_of(answers)
        state = rule.state(table, told)
        marks = {size: np.zeros(state.size + 1, dtype=bool) for size in (rule.length, rule.short)}

        def mark(starts: np.ndarray, ends: np.ndarray) -> None:
            for size, marked in marks.items():
                marked[starts[starts + size <= ends]] = True

        # Runs that repeat whole: elsewhere, or twice in this batch.
        twice = np.union1d(told.get(WHOLE, np.zeros(0, np.int64)), np.flatnonzero(state.entries.counts > 1))
        low, counts, ends = state.spans(state.entries.all_of(twice))
        mark(spread(low, counts), np.repeat(ends, counts))
        for kind, payload in zip(answers.column("kind").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            if kind == MATCHED:
                runs, long, brief = unpack_arrays(payload)
                starts = spread(*state.spans(runs)[:2])
                for size, bits in ((rule.length, long), (rule.short, brief)):
                    marks[size][starts[np.unpackbits(bits, count=len(starts)).astype(bool)]] = True
        if HOT in told:
            for kind, (starts, own) in _windows(state, told[HOT], rule).items():
                twice = own.counts > 1
                twice[told.get(kind, np.zeros(0, np.int64))] = True
                marks[rule.length if kind == LONG else rule.short][starts[twice[own.group]]] = True
        done = state.finished({size: covered(np.flatnonzero(marked), size, state.size) for size, marked in marks.items()})
        return done.append_column("times", state.table.column("times"))

    return last


def repeats(docs: DataFrame, rule, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """The rule's results for each row of docs (doc_id, text); nothing is dropped or capped.

    rule: length and short (windows that are removed, and shorter ones that are counted), schema, and state(table, told), a
    batch's texts, with table (its rows, in order), size (symbols), entries (grams of runs), spans(runs) -> (first start,
    starts, end of the segment), segments(runs, batch), prints(starts, size) -> (two hashes of each) and finished(what windows of each size cover). A rule with references
    has bits (of grams that meet there, fit for a corpus of 2**size_bits by for_corpus), and its states have
    probes() -> (entries of references, of all others), and know their runs from what they were told: the entries
    that MET, or the PLACES that they kept then.
    """
    ship(docs.sparkSession)
    keyed, size_bits, buckets, several = dealt(docs)
    rule = rule.for_corpus(size_bits)
    grouped = keyed.groupBy("batch")
    if rule.references:
        met = grouped.applyInArrow(probe_step(rule, buckets), ROW).groupBy("bucket").applyInArrow(meet_probes, ROW)
        grams = grouped.cogroup(met.groupBy("batch")).applyInArrow(first_step(rule, buckets), ROW)
    else:
        grams = grouped.applyInArrow(alone(first_step(rule, buckets)), ROW)
    met = grams.groupBy("bucket").applyInArrow(alone(meet_grams(hot_kinds)), ROW)
    sent = grouped.cogroup(met.groupBy("batch")).applyInArrow(second_step(rule, buckets), ROW)
    told = sent.groupBy("bucket").applyInArrow(alone(meet_suffixes(rule)), ROW)
    found = grouped.cogroup(told.groupBy("batch")).applyInArrow(last_step(rule), f"{rule.schema}, times long")
    return given_back(found) if several else found.drop("times")

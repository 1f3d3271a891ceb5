"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words, one beginning every STEP words. Their TF-IDF vectors have a place for
each word of the benchmark and hashed places for all other words; document frequencies are counted over
every passage of the corpus, once for all items.

The latent space is a randomised SVD of the passages of the whole corpus and of the items, of unit length, their words
folded onto HASHED places: executors sum A'(A Omega) in blocks of places, with Omega drawn from a seed in each task, and
the driver makes the leading ``rank`` directions of it (Nystrom's approximation of A'A, a matrix of HASHED rows whatever
the vocabulary). Words that keep the same company lie close in it. Vectors are divided by the singular values, as in
folding in, so that what all passages of a language share does not outweigh the rest, and a direction counts by the
share of its variance, 1 - (s' / s)^2, that is above the greatest one left out, so that noise counts little.

A passage is a candidate for an item by either of two cosines. One is latent and at least ``least_latent`` (items of
LATENT_WORDS words or more; fewer say too little): it finds an item whose rarer words were replaced by words of like use. The other is of the TF-IDF
vectors themselves and at least ``least_cosine``, or what an item of n words reaches with ``part`` of them at half
their mean weight, part * sqrt(n / WINDOW) / 2, if that is less: it loses no copy, however many directions
the corpus has beyond the rank. BOUND items share, for each word, the greatest that it adds to one of them, and
only where a passage's sum of these reaches its items' cosine are they multiplied one by one. Latent candidates go on if
their neighbourhood has as many of the item's words, in any order, as the subsequence needs. Neither loses any.

A candidate's neighbourhood in the document is compared with the whole item: the longest common
subsequence of words, as a share of the item's, and the share of the item's answer (the words of its last
sentence, or of its last third if it has one sentence) that is there. An item is found where the
subsequence is at least ``whole``, or at least ``part`` with ``answer`` of the answer's words; where only the latent cosine brought it up, what is left in common may
be common words, and the subsequence has to be ``part_latent`` instead of ``part``. Items of fewer than SHORT words are only found whole and in one piece, wherever their run of words is in a text, at any cosine.

The benchmark is a query set that the driver sees MOST_ITEMS at a time and every worker holds as vectors, a
block of BLOCK_ITEMS items at a time; a larger one takes more passes and is searched whole. Null or wordless texts are never contaminated, null or wordless items find nothing;
items with equal texts are all reported; rows with equal ids are reported as one, rows with a null id under
the null id. Empty tables on either side give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied, working
from .wordhash import hashes_in, words_in

WINDOW, STEP = 48, 24
#: Places that words outside the benchmark share; bytes of text worked on at once.
HASHED, SLICE = 1 << 14, 1 << 21
#: Rank of the latent space, directions drawn beyond it, and parts in which executors sum its sketch.
RANK, SPARE, PARTS = 40, 8, 64
#: Passages of items that are multiplied at once, and those that share a bound; words that a latent vector takes.
GROUP, BOUND, LATENT_WORDS = 256, 4, 16
#: Steps that are projected at once, and pairs of a step and an item or bound that are looked into at once.
STEPS, PAIRS = 512, 1 << 14
#: Items of a block, items that the driver takes at once, and words below which an item is short.
BLOCK_ITEMS, MOST_ITEMS, SHORT = 2000, 50_000, 8
_FLAT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
RESULT = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word long, latent double"


def flattened(text: str | None) -> bytes:
    """Lower-cased UTF-8, ASCII punctuation being space."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FLAT)


def words_of(text: str | None) -> list[bytes]:
    return flattened(text).split()


def _hashed(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    return hashes_in(raw, *words_in(raw))


class Places:
    """The place of each word: its own if the benchmark has it, else one that it shares by hash."""

    def __init__(self, vocabulary: list[bytes]):
        self.known = len(vocabulary)
        self.size = self.known + HASHED
        hashes = _hashed(vocabulary)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.known - 1)
        own = self.sorted[at] == hashes
        return np.where(own, self.order[at], self.known + (hashes % np.uint64(HASHED)).astype(np.int64)).astype(np.int32)

    def folded(self) -> np.ndarray:
        """Of every place, which of the HASHED ones its words share in the latent space."""
        own = np.empty(self.known, dtype=np.int64)
        own[self.order] = (self.sorted % np.uint64(HASHED)).astype(np.int64)
        return np.concatenate([own, np.arange(HASHED)])


@dataclass
class Group:
    """Some of the items' passages, by words and in the latent space."""

    #: The row of each of the benchmark's words in scores; the last one, of zeros, for words of other groups.
    row: np.ndarray
    #: Bounds by words by passages: what an occurrence adds to a passage's product with each, over the cosine it needs.
    scores: np.ndarray
    #: Words by bounds: the greatest of these.
    most: np.ndarray
    #: Of each passage's item: its words as rows, how often it has each, and where each item's begin.
    words: np.ndarray
    counts: np.ndarray
    begins: np.ndarray
    #: What a passage's cosine needs.
    least: np.ndarray
    #: Unit latent vectors of the group's passages as columns; zeros for short items.
    latent: np.ndarray
    #: The item of each of the group's passages.
    owners: np.ndarray


@dataclass
class Space:
    places: Places
    #: The weight of each place.
    idf: np.ndarray
    groups: list[Group]
    #: Of each item: its id, its words, its answer's words.
    items: list[tuple[int | None, list[bytes], frozenset[bytes]]]
    #: Of the rarest word of each item of fewer than SHORT words: (item, its words, where the rarest is in it).
    short: dict[int, list[tuple[int, np.ndarray, int]]]
    #: What an occurrence of each place's words adds to a passage's latent vector; the last row, of zeros, is for none.
    latent: np.ndarray
    #: The cosine that each item needs.
    least: np.ndarray


def _slices(texts: list[str | None], places: Places) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], int]]:
    """(places of words, offsets of texts, the texts as they are split, the first text) for a bounded number of bytes."""
    held, first, count = [], 0, 0
    for k, text in enumerate(texts):
        held.append(flattened(text))
        count += len(held[-1])
        if count >= SLICE or k == len(texts) - 1:
            raw = np.frombuffer(b" ".join(held), dtype=np.uint8)
            starts, ends = words_in(raw)
            bounds = np.cumsum([0] + [len(t) + 1 for t in held])
            yield places.of(hashes_in(raw, starts, ends)), np.searchsorted(starts, bounds), held, first
            held, first, count = [], k + 1, 0


def _steps(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the steps of each text, and the text each is in."""
    sizes = -(-np.diff(offsets) // STEP)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return offsets[:-1][owner] + within * STEP, owner


def _frequencies(docs: DataFrame, places: Places) -> tuple[np.ndarray, int]:
    """Of every place, the number of the corpus' passages (here side by side) that have it; and all passages."""
    size = places.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        counts, total = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for flat, offsets, _, _ in _slices(batch.column(0).slice(at, 512).to_pylist(), places):
                    if not len(flat):
                        continue
                    starts, owner = _steps(offsets)
                    pair = (np.arange(len(starts)) - np.searchsorted(owner, owner)) // 2
                    passage = np.cumsum(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])])) - 1
                    of_word = np.repeat(passage, np.diff(np.append(starts, len(flat))))
                    # 32 bits sort many times faster, and nearly always hold a passage and a place.
                    kind = np.uint32 if (int(passage[-1]) + 1) * size < 1 << 32 else np.uint64
                    pairs = of_word.astype(kind) * kind(size) + flat.astype(kind)
                    pairs.sort()
                    new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
                    counts += np.bincount((pairs[new] % kind(size)).astype(np.int64), minlength=size)
                    total += int(passage[-1]) + 1
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], total))], ["place", "n"])

    rows = docs.select("text").mapInArrow(tidied(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    counts, total = np.zeros(size), 0
    for r in rows:
        if r.place < 0:
            total = r.n
        else:
            counts[r.place] = r.n
    return counts, total


def _sketch(texts: DataFrame, places: Places, idf: np.ndarray, width: int) -> np.ndarray:
    """A'(A Omega) of the passages (here side by side) of texts, summed by executors."""
    folded, size = places.folded(), places.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        drawn = _drawn(width)[folded] * idf[:, None]
        drawn = np.concatenate([drawn, np.zeros((1, width))]).astype(np.float32)
        energies, total = np.append(idf**2, 0.0), np.zeros((width, HASHED))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for flat, offsets, _, _ in _slices(batch.column(0).slice(at, 512).to_pylist(), places):
                    if len(flat):
                        table, follows, starts = _table(flat, offsets, size)
                        # Passages of two steps each: the first, third.. step of a text, with the one behind it.
                        owner = np.searchsorted(offsets, starts, "right")
                        odd = (np.arange(len(starts)) - np.searchsorted(owner, owner)) % 2
                        first = np.flatnonzero(odd == 0)
                        passage = np.cumsum(odd == 0) - 1
                        both = np.add.reduceat(_summed(drawn, table), first, axis=0)
                        energy = np.add.reduceat(energies[table].sum(axis=1), first)
                        both /= np.maximum(energy, 1e-9)[:, None].astype(np.float32)
                        of_word = np.repeat(passage, np.diff(np.append(starts, len(flat))))
                        weight, where = idf[flat], folded[flat]
                        for j, column in enumerate(np.ascontiguousarray(both.T, dtype=np.float64)):
                            total[j] += np.bincount(where, weights=column[of_word] * weight, minlength=HASHED)
        if total.any():
            blocks = np.split(total, PARTS, axis=1)
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["part", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), dtype=np.float64)
                sums[part] = sums[part] + own if part in sums else own.copy()
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "sums"])

    schema, total = "part int, sums binary", np.zeros((width, PARTS, HASHED // PARTS))
    for r in texts.mapInArrow(tidied(run), schema).repartition(PARTS, "part").mapInArrow(tidied(added), schema).collect():
        total[:, r.part] = np.frombuffer(r.sums).reshape(width, -1)
    return total.reshape(width, HASHED).T


def _drawn(width: int) -> np.ndarray:
    return np.random.default_rng(1).standard_normal((HASHED, width))


def _directions(sketch: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading right singular vectors of A as columns, A's singular values, and the greatest one left out, from A'(A Omega)."""
    core = _drawn(sketch.shape[1]).T @ sketch
    values, turn = np.linalg.eigh((core + core.T) / 2)
    some = values > max(values[-1], 0.0) * 1e-10
    vectors, lengths, _ = np.linalg.svd(sketch @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)
    kept = int((lengths > 1e-4 * lengths.max(initial=0.0))[:rank].sum())
    return vectors[:, :kept], lengths[:kept], float(lengths[kept]) if kept < len(lengths) else 0.0


def _latent(texts: DataFrame, places: Places, idf: np.ndarray, rank: int) -> np.ndarray:
    """What an occurrence of each place's words adds to a latent vector, and a row of zeros; no columns at rank 0."""
    if rank <= 0:
        return np.zeros((places.size + 1, 0), dtype=np.float32)
    vectors, lengths, floor = _directions(_sketch(texts, places, idf, rank + SPARE), rank)
    rows = (vectors * (1 - (floor / lengths) ** 2) / lengths)[places.folded()] * idf[:, None]
    return np.concatenate([rows, np.zeros((1, rows.shape[1]))]).astype(np.float32)


def _group(passages: list[tuple[int, np.ndarray]], told: list[np.ndarray], idf: np.ndarray, latent: np.ndarray, least: np.ndarray) -> Group:
    """The vectors of (item, places of words), and their items' words; least is each item's cosine."""
    # Passages of like latent vectors share a bound: what a word adds to one of them is then close to what it adds to all.
    own = np.stack([latent[words].sum(axis=0) for _, words in passages])
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    order = _alike(own)
    passages, own = [passages[k] for k in order], own[order]
    known = np.unique(np.concatenate([told[k] for k, _ in passages]))
    none = len(known)
    row = np.full(len(idf) + HASHED + 1, none, dtype=np.int32)
    row[known] = np.arange(none)
    rows = np.stack([np.bincount(row[words], minlength=none) for _, words in passages]) * idf[known]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    owners = np.array([k for k, _ in passages])
    scores = np.zeros((-(-len(passages) // BOUND) * BOUND, none + 1), dtype=np.float32)
    scores[: len(passages), :none] = rows * idf[known] / least[owners, None]
    scores = scores.reshape(-1, BOUND, none + 1).transpose(0, 2, 1).copy()
    own[[len(told[k]) < LATENT_WORDS for k in owners]] = 0
    kinds = [np.unique(row[told[k]], return_counts=True) for k in owners]
    begins = np.cumsum([0] + [len(w) for w, _ in kinds])
    words, counts = (np.concatenate([kind[j] for kind in kinds]) for j in (0, 1))
    return Group(row, scores, scores.max(axis=2).T.copy(), words, counts, begins, least[owners], own.T.copy(), owners)


def _alike(vectors: np.ndarray) -> np.ndarray:
    """An order of vectors in which each is followed by the nearest that is left."""
    left, order = np.ones(len(vectors), dtype=bool), [0]
    left[0] = False
    while left.any():
        order.append(int(np.argmax(np.where(left, vectors @ vectors[order[-1]], -2.0))))
        left[order[-1]] = False
    return np.array(order)


def _answer(text: str) -> frozenset[bytes]:
    sentences = [s for s in map(words_of, re.split(r"[.!?]+\s+", text.strip())) if s]
    own = words_of(text)
    return frozenset(sentences[-1] if len(sentences) > 1 else own[-max(len(own) // 3, 1) :])


def common_subsequence(item: list[bytes], words: list[bytes]) -> int:
    """The length of the longest common subsequence, with a bit for each word of item."""
    where: dict[bytes, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        met = row & where.get(w, 0)
        row = ((row + met) | (row - met)) & full
    return len(item) - row.bit_count()


def _spaces(docs: DataFrame, benchmark: DataFrame, items: list[tuple[int | None, str]], rank: int, least_cosine: float, part: float) -> Iterator[Space]:
    """A space for each block of items; words, frequencies, weights and directions are common to all."""
    items = [(i, t) for i, t in items if words_of(t)]
    if not items:
        return
    vocabulary = sorted({w for _, t in items for w in words_of(t)})
    place = {w: k for k, w in enumerate(vocabulary)}
    places = Places(vocabulary)
    counts, total = _frequencies(docs, places)
    idf = np.log((total + 1) / (counts + 1)) + 0.05
    latent = _latent(docs.select("text").union(benchmark.select("text")), places, idf, rank)
    for block in range(0, len(items), BLOCK_ITEMS):
        own = items[block : block + BLOCK_ITEMS]
        told = [np.fromiter(map(place.__getitem__, words_of(t)), np.int64) for _, t in own]
        passages = [(k, words[at : at + WINDOW]) for k, words in enumerate(told) for at in range(0, len(words), WINDOW)]
        sizes = np.array([len(words) for words in told])
        least = np.minimum(least_cosine, part * np.sqrt(np.minimum(sizes, WINDOW) / WINDOW) / 2)
        groups = [_group(passages[at : at + GROUP], told, idf[: places.known], latent, least) for at in range(0, len(passages), GROUP)]
        short: dict[int, list[tuple[int, np.ndarray, int]]] = {}
        for k, words in enumerate(told):
            if len(words) < SHORT:
                at = int(np.argmax(idf[words]))
                short.setdefault(int(words[at]), []).append((k, words, at))
        yield Space(places, idf, groups, [(i, words_of(t), _answer(t)) for i, t in own], short, latent, least)


def _runs(flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray, space: Space) -> dict[int, np.ndarray]:
    """Of each short item that is in the texts in one piece, the steps in which it begins."""
    found = {}
    for word, items in space.short.items():
        spots = np.flatnonzero(flat == word)
        for k, own, at in items:
            first = spots - at
            first = first[(first >= 0) & (first + len(own) <= len(flat))]
            for j, w in enumerate(own):
                first = first[flat[first + j] == w]
            # In one text.
            first = first[np.searchsorted(offsets, first, "right") == np.searchsorted(offsets, first + len(own) - 1, "right")]
            if len(first):
                found[k] = np.unique(np.searchsorted(starts, first, "right") - 1)
    return found


def _search(texts: list[str | None], space: Space, least_latent: float, part_latent: float) -> Iterator[tuple[int, int, float, float, int, list[bytes]]]:
    """(text, item, cosine, latent cosine, start of the passage, the text's words) of candidates."""
    for flat, offsets, held, first in _slices(texts, space.places):
        if len(flat):
            split: dict[int, list[bytes]] = {}
            for text, item, cosine, latent, start in _candidates(flat, offsets, space, least_latent, part_latent):
                if text not in split:
                    split = {text: held[text].split()}
                yield first + text, item, cosine, latent, start, split[text]


def _table(flat: np.ndarray, offsets: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of places for each step, filled up with none; whether the next step is of the same text; starts of steps."""
    starts, owner = _steps(offsets)
    lens = np.diff(np.append(starts, len(flat)))
    places = np.full(len(starts) * STEP, none, dtype=np.int32)
    places[np.repeat(np.arange(len(starts)) * STEP - starts, lens) + np.arange(len(flat))] = flat
    return places.reshape(-1, STEP), np.append(owner[1:] == owner[:-1], False), starts


def _summed(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the vectors that each of rows names."""
    out = vectors[rows[:, 0]]
    more = np.empty_like(out)
    for k in range(1, rows.shape[1]):
        np.take(vectors, rows[:, k], axis=0, out=more, mode="clip")
        out += more
    return out


def _candidates(flat: np.ndarray, offsets: np.ndarray, space: Space, least_latent: float, part_latent: float) -> Iterator[tuple[int, int, float, float, int]]:
    places, follows, starts = _table(flat, offsets, space.places.size)
    owner = np.searchsorted(offsets, starts, "right") - 1
    energy = np.append(space.idf**2, 0.0)[places].sum(axis=1)
    energy[:-1] += np.where(follows[:-1], energy[1:], 0)
    # A word that occurs twice adds no more to the length than two words do: cosines are never too small.
    length = np.sqrt(np.maximum(energy, 1e-9)).astype(np.float32)
    runs = _runs(flat, offsets, starts, space)
    # Products of steps; a passage is a step and the one behind it, if that is of the same text.
    for at in range(0, len(starts), STEPS):
        n = min(STEPS, len(starts) - at)
        both = np.flatnonzero(follows[at : at + n])
        means = _summed(space.latent, places[at : at + STEPS + 1])
        means[both] += means[both + 1]
        means = means[:n] / np.maximum(np.linalg.norm(means[:n], axis=1, keepdims=True), 1e-9)
        for group in space.groups:
            rows = group.row[places[at : at + STEPS + 1]]
            most = _summed(group.most, rows)
            most[both] += most[both + 1]
            a, bound = np.nonzero(most[:n] >= length[at : at + n, None] * np.float32(1 - 1e-5))
            latent = means @ group.latent
            found = {}
            for k in range(0, len(a), PAIRS):
                some, block = a[k : k + PAIRS], bound[k : k + PAIRS]
                shares = _exact(group, rows, follows[at : at + n], some, block) / length[at + some, None]
                for x, j in zip(*np.nonzero(shares >= 1), strict=True):
                    q = int(block[x]) * BOUND + int(j)
                    if q < len(group.owners):
                        found[int(some[x]), q] = float(shares[x, j])
            step, q = np.nonzero(latent >= least_latent)
            for k in range(0, len(step), PAIRS):
                some, own = step[k : k + PAIRS], q[k : k + PAIRS]
                enough = _shared(group, places, at, some, own) >= part_latent * np.array([len(space.items[i][1]) for i in group.owners])[own]
                for x, y in zip(some[enough].tolist(), own[enough].tolist(), strict=True):
                    found.setdefault((x, y), None)
            for y in np.flatnonzero(np.isin(group.owners, list(runs))) if runs else ():
                here = runs[int(group.owners[y])]
                for x in here[(here >= at) & (here < at + n)] - at:
                    found.setdefault((int(x), int(y)), None)
            for (x, y), share in sorted(found.items(), key=lambda f: f[0]):
                if share is None:
                    block, j = divmod(y, BOUND)
                    share = float(_exact(group, rows, follows[at : at + n], np.array([x]), np.array([block]))[0, j] / length[at + x])
                need = float(group.least[y])
                cosine = max(min(share * need, 1.0), need if share >= 1 else 0.0)
                yield int(owner[at + x]), int(group.owners[y]), cosine, float(latent[x, y]), int(starts[at + x] - offsets[owner[at + x]])


def _exact(group: Group, rows: np.ndarray, follows: np.ndarray, steps: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Products of passages at steps with the items of bounds, each over the cosine it needs."""
    out = group.scores[bounds[:, None], rows[steps]].sum(axis=1)
    both = np.flatnonzero(follows[steps])
    out[both] += group.scores[bounds[both, None], rows[steps[both] + 1]].sum(axis=1)
    return out


def _shared(group: Group, places: np.ndarray, at: int, steps: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """Of each (step, passage of an item): words of the item that are in the step's neighbourhood, in any order, or a few more."""
    backs = -(-np.add.reduceat(group.counts, group.begins[:-1]) // STEP)[passages]
    low, high = max(at + int((steps - backs).min()), 0), min(at + int((steps + backs).max()) + 2, len(places))
    near = group.row[places[low:high]]
    present = np.zeros((len(near), group.most.shape[0]), dtype=bool)
    present[np.arange(len(near))[:, None], near] = True
    out = np.zeros(len(steps), dtype=np.int64)
    for back in np.unique(backs):
        # Of each step, what is in as many steps from it on as a neighbourhood has.
        within, size, width = present.copy(), 1, int(2 * back + 2)
        while size < width:
            more = min(size, width - size)
            within[:-more] |= within[more:]
            size += more
        own = np.flatnonzero(backs == back)
        lens = group.begins[passages[own] + 1] - group.begins[passages[own]]
        before = np.cumsum(lens) - lens
        spots = np.repeat(group.begins[passages[own]] - before, lens) + np.arange(lens.sum())
        first = np.maximum(at + steps[own] - back - low, 0)
        out[own] = np.add.reduceat(within[np.repeat(first, lens), group.words[spots]] * group.counts[spots], before)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, least_cosine: float = 0.28, least_latent: float = 0.7, whole: float = 0.75, part: float = 0.5, part_latent: float = 0.65, answer: float = 0.6) -> DataFrame:
    """A row for each benchmark item found in a row of docs (doc_id, text): RESULT.

    cosine and latent are those of the best passage (the latent one to four digits), lcs and answer are shares of the
    item's words, start_word is where the best passage begins. At rank 0 there is no latent space.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts, found = max(1, -(-benchmark.count() // MOST_ITEMS)), None
    for k in range(parts):
        chosen = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else benchmark
        rows = [(r.item_id, r.text) for r in chosen.select("item_id", "text").collect() if r.text]
        items = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        for space in _spaces(docs, chosen, items, rank, least_cosine, part):
            own = docs.mapInArrow(tidied(_finder(space, least_latent, whole, part, part_latent, answer)), RESULT)
            found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], RESULT)
    best = F.max_by(F.struct("cosine", "lcs", "answer", "start_word", "latent"), F.struct("lcs", "cosine", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def _finder(space: Space, least_latent: float, whole: float, part: float, part_latent: float, answer: float):
    def verified(item: int, words: list[bytes], start: int, alone: bool) -> tuple[float, float] | None:
        _, own, closing = space.items[item]
        lo, hi = max(start - len(own), 0), start + WINDOW + len(own)
        near = words[lo:hi]
        if len(own) < SHORT:
            same = any(near[i : i + len(own)] == own for i in range(len(near) - len(own) + 1))
            return (1.0, 1.0) if same else None
        lcs = common_subsequence(own, near) / len(own)
        if lcs < (part_latent if alone else part):
            return None
        closed = len(closing.intersection(near)) / len(closing)
        return (lcs, closed) if lcs >= whole or closed >= answer else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, best = batch.column(0).slice(at, 128).to_pylist(), {}
                for text, item, cosine, latent, start, words in _search(batch.column(1).slice(at, 128).to_pylist(), space, least_latent, part_latent):
                    if shares := verified(item, words, start, cosine < space.least[item]):
                        got = (shares[0], cosine, -start, shares[1], round(latent, 4))
                        if (text, item) not in best or got > best[text, item]:
                            best[text, item] = got
                if best:
                    lcs, cosine, start, closed, latent = zip(*best.values(), strict=True)
                    known = (([ids[t] for t, _ in best], pa.int64()), ([space.items[i][0] for _, i in best], pa.int64()))
                    told = ((cosine, pa.float64()), (lcs, pa.float64()), (closed, pa.float64()), ([-x for x in start], pa.int64()), (latent, pa.float64()))
                    yield pa.record_batch([pa.array(c, t) for c, t in (*known, *told)], [c.split()[0] for c in RESULT.split(", ")])

    return run

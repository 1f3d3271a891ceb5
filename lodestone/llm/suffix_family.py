"""A logarithmic family of suffix arrays over segments that meet at an anchor.

A segment is a short run of symbols (bytes or words) around an anchor, and belongs to a group of segments whose
anchors are equal. Matches that are looked for hold the anchor at the same place in both texts, so suffixes
are compared place by place: ``sweep`` goes through the places from the right to the left and keeps, at
each, all suffixes that start there in lexicographic order with the lengths of the prefixes that neighbours
have in common (LCP). From one place to the next the order changes by one stable sort on a symbol and an LCP
grows by one or falls to nothing, so a sweep is linear in the symbols. The longest match of a start is the larger
LCP of its two neighbours. Symbols themselves are compared and no hashes of them.

``Family`` holds levels: segments in the order of their suffixes from the anchor on, by group. A new batch is
swept together with the members of its groups in every level (found by merging the sorted groups), which gives
the matches among the new ones and between new and old; then it becomes a level, and levels of equal size class
merge, so that there are logarithmically many and every segment is merged logarithmically often.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of the table of symbols in a sweep, about; a new batch has no more. Segments that are put into it at once.
SWEEP_BYTES, SLICE = 8 << 20, 1024


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays as bytes: kind, length and content of each."""
    out = []
    for a in arrays:
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    return b"".join(out)


def unpack_arrays(raw: bytes) -> list[np.ndarray]:
    at, found = 0, []
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        found.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return found


def spread(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many numbers from each low on."""
    if not len(low):
        return np.zeros(0, np.int64)
    return np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


@dataclass
class Segments:
    """Segments in ascending order of group. Symbols are positive."""

    group: np.ndarray
    #: Whose each is: a batch and a place in it.
    batch: np.ndarray
    place: np.ndarray
    #: Symbols before the anchor, in all, and starts (the first symbols).
    left: np.ndarray
    size: np.ndarray
    starts: np.ndarray
    #: Where each one's symbols begin in symbols.
    at: np.ndarray
    symbols: np.ndarray

    def __len__(self) -> int:
        return len(self.group)

    def take(self, chosen: np.ndarray) -> "Segments":
        """Some of them, in the given order; symbols that nobody has any more go."""
        sizes = self.size[chosen].astype(np.int64)
        flat = self.symbols[spread(self.at[chosen], sizes)]
        return Segments(self.group[chosen], self.batch[chosen], self.place[chosen], self.left[chosen], self.size[chosen], self.starts[chosen], np.cumsum(sizes) - sizes, flat)

    def columns(self) -> list[np.ndarray]:
        return [self.group, self.batch, self.place, self.left, self.size, self.starts, self.at, self.symbols]

    def packed(self) -> bytes:
        """As bytes; large symbols, of which few differ, as places in a list of them."""
        *columns, symbols = self.columns()
        if symbols.itemsize < 8:
            return pack_arrays([*columns, symbols])
        known, places = np.unique(symbols, return_inverse=True)
        return pack_arrays([*columns, known, places.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)])

    @classmethod
    def unpacked(cls, raw: bytes) -> "Segments":
        *columns, symbols = unpack_arrays(raw)
        return cls(*columns, symbols) if len(columns) == 7 else cls(*columns[:7], columns[7][symbols])

    @classmethod
    def joined(cls, parts: list["Segments"]) -> "Segments":
        """All of parts by group; within a group, in the order of the parts."""
        columns = [np.concatenate(c) for c in zip(*(p.columns() for p in parts), strict=True)]
        lengths = [len(p.symbols) for p in parts]
        columns[6] = columns[6] + np.repeat(np.cumsum([0, *lengths[:-1]]), [len(p) for p in parts])
        order = np.argsort(columns[0], kind="stable")
        return cls(*(c[order] for c in columns[:7]), columns[7])

    @classmethod
    def none(cls, kind: str = "u1") -> "Segments":
        whole, small = np.zeros(0, np.int64), np.zeros(0, np.int32)
        return cls(np.zeros(0, np.uint64), whole, whole, small, small, small, whole, np.zeros(0, kind))


def sweep(segments: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the longest match of each start, one segment's behind the other; segments in the order of their suffixes
    from the anchor on, by group; the LCP of each of those with the one before).
    """
    n = len(segments)
    starts = segments.starts.astype(np.int64)
    best = np.zeros(int(starts.sum()), dtype=np.int32)
    if not n:
        return best, np.zeros(0, np.int64), np.zeros(0, np.int32)
    first = int(segments.left.max()) - segments.left.astype(np.int64)  # the column of each one's first symbol
    width, anchor = int((first + segments.size).max()), int(segments.left.max())
    sizes = segments.size.astype(np.int64)
    table = np.zeros((width, n), dtype=segments.symbols.dtype)  # 0: no symbol
    for at in range(0, n, SLICE):
        part = slice(at, at + SLICE)
        whose = np.repeat(np.arange(at, min(at + SLICE, n)), sizes[part])
        table[spread(first[part], sizes[part]), whose] = segments.symbols[spread(segments.at[part], sizes[part])]
    begins = np.cumsum(starts) - starts
    until = int((first + starts).max())
    change = np.concatenate([[True], segments.group[1:] != segments.group[:-1]])
    rank = np.cumsum(change) - 1  # by place in the order; groups keep their places
    same = ~change[1:]
    order, lcp = np.arange(n), np.zeros(n + 1, dtype=np.int32)  # the last one closes the last group
    at_anchor = (order, lcp[:n])
    for column in range(width - 1, -1, -1):
        symbol = table[column][order]
        turned = np.flatnonzero((symbol[1:] < symbol[:-1]) & same)
        common = lcp[1:n].copy()
        if len(turned):
            unsorted = np.zeros(rank[-1] + 1, dtype=bool)
            unsorted[rank[turned]] = True
            some = np.flatnonzero(unsorted[rank])
            moved = np.arange(n)
            moved[some] = some[np.lexsort((symbol[some], rank[some]))]  # stable
            order, symbol = order[moved], symbol[moved]
            # What two have in common that were apart is the least between them.
            lo, hi = moved[:-1] + 1, moved[1:]
            near = hi == lo
            common[near] = lcp[hi[near]]
            far = np.flatnonzero(~near & (symbol[1:] == symbol[:-1]) & same)
            if len(far):
                common[far] = np.minimum.reduceat(lcp, np.stack([lo[far], hi[far] + 1], axis=1).ravel())[::2]
        goes_on = same & (symbol[1:] == symbol[:-1]) & (symbol[1:] != 0)
        lcp = np.zeros(n + 1, dtype=np.int32)
        lcp[1:n] = np.where(goes_on, common + 1, 0)
        if column == anchor:
            at_anchor = (order, lcp[:n])
        if column < until:
            own = column - first[order]
            here = (own >= 0) & (own < starts[order])
            best[begins[order[here]] + own[here]] = np.maximum(lcp[:n], lcp[1:])[here]
    return best, *at_anchor


def _merged(a: Segments, b: Segments) -> Segments:
    """Two levels as one, in the order of their suffixes."""
    both = Segments.joined([a, b])
    return both.take(sweep(both)[1])


class Family:
    """Levels of segments; matches of those that were added are in ``found``."""

    def __init__(self, levels: list[Segments] = ()):
        self.levels = list(levels)
        #: (segments, the longest match of each of their starts), one for each sweep.
        self.found: list[tuple[Segments, np.ndarray]] = []

    def add(self, new: Segments) -> None:
        """new: by group."""
        own = np.unique(new.group)
        parts = [new]
        for level in self.levels:
            at = np.searchsorted(own, level.group)
            met = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == level.group) if len(own) else []
            if len(met):
                parts.append(level.take(met))
        both = Segments.joined(parts)
        best, order, _ = sweep(both)
        self.found.append((both, best))
        mine = np.zeros(len(both), dtype=bool)
        # joined() is stable: of each group, new ones come first.
        begins = np.searchsorted(both.group, both.group, "left")
        mine[:] = np.arange(len(both)) - begins < np.searchsorted(new.group, both.group, "right") - np.searchsorted(new.group, both.group, "left")
        self.levels.append(both.take(order[mine[order]]))
        while len(self.levels) > 1 and len(self.levels[-2]).bit_length() <= len(self.levels[-1]).bit_length():
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(_merged(a, b))

    def add_all(self, segments: Segments) -> None:
        """segments in batches of bounded size."""
        width = int(segments.size.max(initial=1)) * segments.symbols.itemsize
        each = max(1, SWEEP_BYTES // width)
        for at in range(0, len(segments), each):
            self.add(segments.take(np.arange(at, min(at + each, len(segments)))))

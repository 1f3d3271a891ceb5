"""64-bit hashes of words and of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import keeps

#: Words kept per Python worker; beyond it, new ones are hashed without being kept.
KEPT_WORDS = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = found
        return found


_hashes = _Hashes()
keeps("words", _hashes.clear)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the finalizer of splitmix64, its constants being fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers by place in a run.
def _places(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours: a polynomial in one multiplier, mixed at the end."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    if n <= 8:
        total = np.zeros(count, dtype=np.uint64)
        for k, factor in enumerate(_places(n)):
            total += hashes[k : k + count] * factor
        return mixed(total)
    # Doubling: runs of 2, 4, 8, ... and then the places where n is put together from them.
    total, width, done, part = np.zeros(count, dtype=np.uint64), 1, 0, hashes
    factors = _places(64)
    step = 0
    while True:
        if n & width:
            total = mixed(total + part[done : done + count] * factors[step])
            done += width
            step += 1
        width *= 2
        if width > n:
            return mixed(total)
        part = mixed(part[: len(part) - width // 2] * factors[40] + part[width // 2 :] * factors[41])


_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A number for each byte, and bytes that are hashed at once.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
CHUNK = 1 << 20
#: ASCII white space.
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of running sums, and of its inverse."""
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_kept_powers: list[np.ndarray] = []


def words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs without white space start and end in bytes."""
    black = np.zeros(len(raw) + 2, dtype=np.int8)
    black[1:-1] = ~_SPACE[raw]
    edges = np.diff(black)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hashes_in(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at some places of bytes, ascending: by running sums, a chunk at a time."""
    found = np.zeros(len(starts), dtype=np.uint64)
    if not _kept_powers:
        _kept_powers.extend(powers(CHUNK))
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = max(int(np.searchsorted(ends, first + CHUNK, "right")), lo + 1)  # a longer word is a chunk of its own
        size = int(ends[hi - 1]) - first
        up, down = _kept_powers if size <= CHUNK else powers(size)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(BYTES[raw[first : first + size]] * up[:size], out=sums[1:])
        a, b = starts[lo:hi] - first, ends[lo:hi] - first
        found[lo:hi] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        lo = hi
    return found

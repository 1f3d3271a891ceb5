"""Column functions on fingerprints: arrays of long words at work, binary at rest (most significant bit first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .peaks import let


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def common(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)


def tanimoto(a: Column, b: Column, pop_a: Column | None = None, pop_b: Column | None = None) -> Column:
    """Shared bits over bits of either; 0 if there are none. Stored popcounts save their computation."""
    pa, pb = popcount(a) if pop_a is None else pop_a, popcount(b) if pop_b is None else pop_b
    return let(common(a, b), lambda both: F.when(pa + pb - both > 0, both / (pa + pb - both)).otherwise(0.0))


def sign_words(values: Column, words: int, width: int = 32) -> Column:
    """Bits of the positive values of an array, width to a word, least significant first."""
    word = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("long"), lambda a, i: a + F.when(F.get(values, i + k * width) > 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.array(*(word(k) for k in range(words)))


def on_bits(words: Column, lo: int, hi: int, width: int = 32) -> Column:
    """Places of set bits in [lo, hi)."""
    return F.filter(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda i: F.get(words, F.floor(i / width).cast("int")).bitwiseAND(F.pow(F.lit(2.0), i % width).cast("long")) != 0)


def pack(words: Column) -> Column:
    """Eight bytes for each word."""
    return F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def unpack(packed: Column) -> Column:
    digits = F.hex(packed)
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(digits) / 16).cast("int") - 1), lambda k: F.conv(digits.substr(k * 16 + 1, F.lit(16)), 16, -10).cast("long"))

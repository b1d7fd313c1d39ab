"""Vector expressions, in double precision and in the order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 63


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(a, b, square))


def code_words(v: Column, thresholds: Column, chunk: int, dim: int) -> Column:
    """One bit a component, set where it is above its chunk's threshold, in words of 32 bits (lowest first)."""
    words = []
    for at in range(0, dim, 32):
        bits = [
            F.when(v[i].cast("double") > thresholds[i // chunk], F.lit(1 << (i - at)).cast("long")).otherwise(F.lit(0).cast("long"))
            for i in range(at, min(dim, at + 32))
        ]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        words.append(total)
    return F.array(*words)


def hamming(a: Column, b: Column, words: int) -> Column:
    """Bits that differ. Unrolled, so it stays in generated code."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, words):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total

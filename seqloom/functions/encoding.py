"""Bits that integer codes need for a value, as column expressions, and the codes' rules for choosing among them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2(v: Column) -> Column:
    """Floor of the binary logarithm of a positive integer, exact at powers of two."""
    return (F.length(F.bin(v)) - 1).cast("bigint")


def gamma(v: Column, offset: int = 1) -> Column:
    return 2 * (1 + log2(v + offset)) - 1


def subexponential(v: Column, k: int, offset: int = 0) -> Column:
    n = v + offset
    return F.when(n < (1 << k), F.lit(k + 1).cast("bigint")).otherwise(log2(n) - k + 1 + 1 + log2(n))


def beta_width(most: Column) -> Column:
    """Fixed width for values up to most: the binary logarithm plus a half, rounded up; 0 where there is nothing to tell apart."""
    return F.when(most <= 0, F.lit(0).cast("bigint")).otherwise(log2(most) + 1)


def golomb(v: Column, m: int, offset: int = 0) -> Column:
    width = m.bit_length()
    n = v + offset
    return F.floor(n / m).cast("bigint") + 1 + F.when(n % m < (1 << width) - m, width - 1).otherwise(width)


def golomb_rice(v: Column, log2m: int, offset: int = 0) -> Column:
    return F.shiftright(v + offset, log2m) + 1 + log2m


def unary(v: Column, offset: int = 0) -> Column:
    return v + offset + 1


def itf8(v: Column) -> Column:
    """Bits of the 32-bit variable-length form; negative values take five bytes."""
    return (F.when((v < 0) | (v >= 1 << 28), 5).when(v < 1 << 7, 1).when(v < 1 << 14, 2).when(v < 1 << 21, 3).otherwise(4) * 8).cast("bigint")


def ltf8(v: Column) -> Column:
    """Bits of the 64-bit variable-length form."""
    out = F.when((v < 0) | (v >= 1 << 56), 9)
    for n in range(1, 9):
        out = out.when(v < 1 << (7 * n), n)
    return (out * 8).cast("bigint")


#: Candidates of the choice, by name, in its order.
CHOICES = {"gamma1": lambda v: gamma(v, 1), "subexp2": lambda v: subexponential(v, 2), "subexp3": lambda v: subexponential(v, 3), "subexp4": lambda v: subexponential(v, 4)}
OTHERS = {"golomb3": lambda v: golomb(v, 3), "golomb10": lambda v: golomb(v, 10), "golomb_rice2": lambda v: golomb_rice(v, 2), "golomb_rice5": lambda v: golomb_rice(v, 5), "unary": unary, "itf8": itf8, "ltf8": ltf8}
# Fixed value: a dictionary code is tried for fewer distinct values than this.
DICTIONARY = 99

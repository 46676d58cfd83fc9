"""The flag word of a record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bits of the flag word.
BITS = {
    "paired": 0x1, "proper_pair": 0x2, "unmapped": 0x4, "mate_unmapped": 0x8, "reverse": 0x10, "mate_reverse": 0x20,
    "first": 0x40, "last": 0x80, "secondary": 0x100, "failed": 0x200, "duplicate": 0x400, "supplementary": 0x800,
}
#: The bits that the record itself carries; those of its mate are kept apart.
OWN = [n for n in BITS if n not in ("mate_unmapped", "mate_reverse", "supplementary")]


def has(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(BITS[name])) != 0


def required(flag: Column, mask: int) -> Column:
    """Passes if ANY of the bits is set; a mask of 0 lets everything pass."""
    return F.lit(True) if mask == 0 else flag.bitwiseAND(F.lit(mask)) != 0


def filtered(flag: Column, mask: int) -> Column:
    """Drops what has any of the bits."""
    return flag.bitwiseAND(F.lit(mask)) == 0


def unpack(flag: Column) -> list[Column]:
    """One 0/1 column per bit."""
    return [has(flag, n).cast("int").alias(n) for n in BITS]


def pack(names: list[str]) -> Column:
    """The flag word from 0/1 columns of the given names."""
    out = F.lit(0)
    for n in names:
        out = out + F.col(n) * F.lit(BITS[n])
    return out

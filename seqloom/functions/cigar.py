"""CIGAR text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_cigar(c: Column) -> Column:
    """The whole text is one or more of number plus operation. (Removing tokens does not recurse over long texts as a repeated group does.)"""
    return (F.length(c) > 0) & (F.regexp_replace(c, "[0-9]+[MIDNSHP=X]", "") == "")


def _total(c: Column, ops: str) -> Column:
    lengths = F.transform(F.regexp_extract_all(c, F.lit(f"([0-9]+)[{ops}]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: F.try_add(a, x))


def reference_span(c: Column) -> Column:
    """Reference bases that the operations consume; null where a length exceeds 64 bits."""
    return _total(c, "MDN=X")


def read_span(c: Column) -> Column:
    """Read bases that the operations consume."""
    return _total(c, "MIS=X")

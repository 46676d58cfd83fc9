"""Regions name[:start[-end]], 1-based and inclusive, and the binning index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = 2**31 - 1


@dataclass(frozen=True)
class Region:
    name: str
    start: int = 0
    end: int = END

    @staticmethod
    def parse(text: str) -> Region:
        name, _, span = text.partition(":")
        if not name:
            raise ValueError(f"no sequence name in region {text!r}")
        start, _, end = span.partition("-")
        return Region(name, int(start) if start else 0, int(end) if end else END)


def last_base(pos: str = "pos", span: str = "span") -> Column:
    """The last reference base of a record; its start where it has no span."""
    return F.when(F.col(span) > 0, F.col(pos) + F.col(span) - 1).otherwise(F.col(pos))


def contained(r: Region, pos: Column, end: Column, name: Column) -> Column:
    return (name == r.name) & (pos >= r.start) & (end <= (r.end if r.end > 0 else END))


def overlapping(r: Region, pos: Column, end: Column, name: Column) -> Column:
    return (name == r.name) & (end >= r.start) & (pos <= (r.end if r.end > 0 else END))


def starting_at(r: Region, pos: Column, name: Column) -> Column:
    return (name == r.name) & (pos == r.start)


def query(df: DataFrame, r: Region, kind: str, end: str = "end") -> DataFrame:
    """Rows of df (rname, pos, end) in the region; kind is contained, overlapping or starting_at. An end of -1 means starting_at."""
    name, pos = F.col("rname"), F.col("pos")
    if kind == "starting_at" or r.end == -1:
        return df.filter(starting_at(r, pos, name))
    return df.filter((contained if kind == "contained" else overlapping)(r, pos, F.col(end), name))


def compatible(df: DataFrame, r: Region, order: list[str]) -> DataFrame:
    """The command-line form: rows starting in the region, and the first one beyond its end."""
    own = df.filter((F.col("rname") == r.name) & (F.col("pos") >= r.start))
    return own.filter(F.col("pos") <= r.end).unionByName(own.filter(F.col("pos") > r.end).orderBy(*order).limit(1))


def bin_of(start: Column, end: Column) -> Column:
    """The smallest bin of the published binning scheme that holds the 0-based half-open interval."""
    last = end - 1
    out = F.lit(0)
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), offset + F.shiftright(start, shift)).otherwise(out)
    return out

"""The field and tag selector: *, SEQ:RNAME, *:SEQ, SEQ/*:NM and the like."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The record's fields in their order.
FIELDS = ("QNAME", "FLAG", "RNAME", "POS", "MAPQ", "CIGAR", "RNEXT", "PNEXT", "TLEN", "SEQ", "QUAL")


@dataclass(frozen=True)
class Selector:
    """Which fields and tags to keep. With but_* the named ones are left out instead of kept."""

    fields: frozenset[str]
    tags: frozenset[str]
    but_fields: bool
    but_tags: bool

    @staticmethod
    def parse(spec: str) -> Selector:
        """A star means all but what is listed; names are separated by colons; a slash begins the tag part.

        Names other than fields are tags. Without a slash the star holds for tags, too.
        """
        left, slash, right = spec.partition("/")
        if not re.fullmatch(r"\*?[A-Z0-9:]*", left) or not re.fullmatch(r"\*?[A-Z0-9:]*", right):
            raise ValueError(f"not a selector: {spec!r}")
        names = [n for n in left.lstrip("*").split(":") if n]
        tags = [n for n in names if n not in FIELDS] + [n for n in right.lstrip("*").split(":") if n]
        if bad := [t for t in tags if len(t) != 2]:
            raise ValueError(f"not fields or tags: {bad}")
        star = left.startswith("*")
        return Selector(frozenset(n for n in names if n in FIELDS), frozenset(tags), star, right.startswith("*") if slash else star)

    def columns(self) -> list[str]:
        return [f.lower() for f in FIELDS if (f in self.fields) != self.but_fields]

    def tag_map(self, tags: Column) -> Column:
        if not self.tags:
            return tags if self.but_tags else F.lit(None).cast("map<string,string>")
        listed = lambda k: k.isin(*sorted(self.tags))
        return F.map_filter(tags, (lambda k, v: ~listed(k)) if self.but_tags else (lambda k, v: listed(k)))


def tag_text(tags: Column) -> Column:
    """Tags as key:type:value in key order, separated by tabs; a type and value without their colon read key:typevalue."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "\t")


def select(df: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """keep, the selected fields, and a column tags of the selected tags as text (empty where there is none)."""
    s = Selector.parse(spec)
    return df.select(*keep, *s.columns(), F.coalesce(tag_text(s.tag_map(F.col("tags"))), F.lit("")).alias("tags"))


def tsv(df: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """keep and one line: the selected fields and tags separated by tabs, nulls as *."""
    s = Selector.parse(spec)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in s.columns()]
    tags = F.coalesce(tag_text(s.tag_map(F.col("tags"))), F.lit(""))
    return df.select(*keep, F.concat_ws("\t", *cells, F.when(tags != "", tags)).alias("line"))

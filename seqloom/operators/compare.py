"""Comparison of two record streams place by place, and of tag sets."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import row_numbers

PREMATURE = "PREMATURE"


def _unequal(field: str, a: Column, b: Column, tolerance: Mapping[str, int], masks: Mapping[str, int]) -> Column:
    if field in masks:
        a, b = a.bitwiseAND(F.lit(~masks[field])), b.bitwiseAND(F.lit(~masks[field]))
    if field in tolerance:
        near = F.abs(a.cast("bigint") - b.cast("bigint")) <= tolerance[field]
        return ~(F.coalesce(near, F.lit(False)) | (a.isNull() & b.isNull()))
    return ~a.eqNullSafe(b)


def shown(value: Column, most: int) -> Column:
    """A value in a report: cut to most characters with ..., null as !NULL!."""
    text = value.cast("string")
    return F.when(text.isNull(), "!NULL!").when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def compare_streams(left: DataFrame, right: DataFrame, order: str, fields: Sequence[str], tolerance: Mapping[str, int] | None = None, masks: Mapping[str, int] | None = None, most: int = 40) -> DataFrame:
    """Rows (counter, field, value1, value2): the n-th record of left against the n-th of right, in the order of an integer column.

    Null equals null. Values within the tolerance of a field are equal; bits of a mask are
    ignored. Where one stream has ended, field is PREMATURE. Records are numbered in blocks of the
    order and joined by number.
    """
    sides = [row_numbers(df.select(order, *fields), [], [order], F.shiftright(F.col(order).cast("bigint"), 12), "counter").select("counter", F.struct(*fields).alias(s)) for s, df in (("a", left), ("b", right))]
    both = sides[0].join(sides[1], "counter", "full")
    one = lambda f: F.struct(F.lit(f).alias("field"), shown(F.col(f"a.{f}"), most).alias("value1"), shown(F.col(f"b.{f}"), most).alias("value2"))
    ended = F.col("a").isNull() | F.col("b").isNull()
    found = F.array_compact(F.array(*[F.when(_unequal(f, F.col(f"a.{f}"), F.col(f"b.{f}"), tolerance or {}, masks or {}), one(f)) for f in fields]))
    last = F.array(F.struct(F.lit(PREMATURE).alias("field"), shown(F.col(f"a.{order}") if order in fields else F.lit(None), most).alias("value1"), F.lit("!NULL!").alias("value2")))
    return both.select("counter", F.inline(F.when(ended, last).otherwise(found)))


def compare_tags(a: Column, b: Column, ignored: Collection[str] = (), only: Collection[str] = ()) -> Column:
    """The sorted keys whose values differ or that one of two tag maps lacks, each once; null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: ~x.eqNullSafe(y))
    keys = F.map_keys(F.map_filter(both, lambda k, v: v))
    if ignored:
        keys = F.filter(keys, lambda k: ~k.isin(*ignored))
    if only:
        keys = F.filter(keys, lambda k: k.isin(*only))
    return F.array_sort(keys)


def dump(left: DataFrame, right: DataFrame, order: str, fields: Sequence[str], name: str = "qname", most: int = 40) -> DataFrame:
    """Rows (counter, field, tag, premature, value1, value2, name1, name2, record1, record2): all there is to say about each discrepancy.

    As compare_streams, with the tags (a map column tags) that differ, under the field TAG, and with
    the names and the whole records on both sides. premature is 0, or 1 or 2 for the stream that
    has ended; what it lacks is null. Other values are shown cut to most characters, null as !NULL!.
    """
    tagged = [df if "tags" in df.columns else df.withColumn("tags", F.lit(None).cast("map<string,string>")) for df in (left, right)]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in [order, *fields]]
    text = F.concat_ws("\t", *cells, F.array_join(F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), "\t"))
    every = list(dict.fromkeys([*fields, name]))
    sides = [row_numbers(df.select(*dict.fromkeys([order, *every]), "tags", text.alias("_text")), [], [order], F.shiftright(F.col(order).cast("bigint"), 12), "counter").select("counter", F.struct(*every, "tags", "_text").alias(s)) for s, df in zip("ab", tagged, strict=True)]
    both = sides[0].join(sides[1], "counter", "full")
    one = lambda field, tag, x, y, ended: F.struct(F.lit(field).alias("field"), tag.cast("string").alias("tag"), F.lit(ended).alias("premature"), x.cast("string").alias("value1"), y.cast("string").alias("value2"))
    none = F.lit(None)
    found = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), one(f, none, shown(F.col(f"a.{f}"), most), shown(F.col(f"b.{f}"), most), 0)) for f in fields]))
    tags = F.transform(compare_tags(F.col("a.tags"), F.col("b.tags")), lambda k: one("TAG", k, shown(F.col("a.tags")[k], most), shown(F.col("b.tags")[k], most), 0))
    last = F.array(one(PREMATURE, none, none, none, 1)), F.array(one(PREMATURE, none, none, none, 2))
    rows = F.when(F.col("a").isNull(), last[0]).when(F.col("b").isNull(), last[1]).otherwise(F.concat(found, tags))
    return both.select("counter", F.inline(rows), F.col(f"a.{name}").alias("name1"), F.col(f"b.{name}").alias("name2"), F.col("a._text").alias("record1"), F.col("b._text").alias("record2"))


def summary(found: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows (field, n) of discrepancies, with place: fields in their order first, then tags."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(f) for f in order]), F.col("field")), F.lit(0))
    counts = found.groupBy("field").agg(F.count("*").alias("n"))
    return counts.select("field", "n", F.when(rank > 0, rank).otherwise(len(order) + 1).cast("int").alias("place"))

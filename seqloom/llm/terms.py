"""Frequency of every distinct value or term, with bounds for rare and common ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import spread

TERM = "array<struct<term:string,n:bigint>>"


def symbols(text: Column) -> Column:
    """Per-record counts of the single characters of a text."""
    each = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.transform(each, lambda c: F.struct(c.alias("term"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("bigint").alias("n"))).cast(TERM)


def single(value: Column) -> Column:
    """The value itself as a term; null gives no term."""
    return F.when(value.isNotNull(), F.array(F.struct(value.cast("string").alias("term"), F.lit(1).cast("bigint").alias("n")))).cast(TERM)


def entries(tags: Column) -> Column:
    """key:value of each entry of a map; an entry with a null value gives no term."""
    every = F.array_compact(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    times = lambda t: F.when(F.size(F.array_distinct(every)) == F.size(every), F.lit(1)).otherwise(F.size(F.filter(every, lambda x: x == t)))
    return F.transform(F.array_distinct(every), lambda t: F.struct(t.alias("term"), times(t).cast("bigint").alias("n"))).cast(TERM)


def term_frequencies(df: DataFrame, fields: Mapping[str, Column], rare: tuple[int, int], common: tuple[int, int]) -> DataFrame:
    """Rows (field, term, n, n_rows, mark): occurrences and records of each term.

    fields: name -> a column of per-record term counts (symbols, single, entries), each term once
    per record. mark is rare if the term is in fewer than rare[0]/rare[1] of all rows of df,
    common if in more than common[0]/common[1], else null. Rows without terms (null, empty) count
    among all rows. Repeated rows count each time; an empty table gives no row. The counts of a
    record are combined per task before the shuffle, so that its size follows the distinct terms.
    """
    none = F.array().cast(TERM)

    def named(field: str, c: Column) -> Column:
        return F.transform(F.coalesce(c, none), lambda x: F.struct(F.lit(field).alias("field"), x["term"].alias("term"), x["n"].alias("n")))

    counts = spread(df).select(F.inline(F.concat(*[named(f, c) for f, c in fields.items()]))).groupBy("field", "term").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows"))
    total = F.lit(df.count()).cast("bigint")
    mark = F.when(F.col("n_rows") * rare[1] < total * rare[0], "rare").when(F.col("n_rows") * common[1] > total * common[0], "common")
    return counts.withColumn("mark", mark)

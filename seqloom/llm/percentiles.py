"""Percentiles per group of large integer columns, by bisection of value intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import broadcast_if_small, cut

SECTIONS = 256


def value_counts(df: DataFrame, group: str, fields: Mapping[str, Column], parts: Sequence[str] = ()) -> DataFrame:
    """The mergeable summary: rows (parts..., grp, field, value, n) of integer columns, nulls left out.

    Summaries of separate days, files or runs are combined with merge_counts; the percentiles of
    the combination are those of all rows together.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), c.cast("bigint").alias("value")) for f, c in fields.items()]))
    return df.select(*parts, F.col(group).alias("grp"), each.alias("x")).filter("x.value is not null").groupBy(*parts, "grp", "x.field", "x.value").agg(F.count("*").alias("n"))


def merge_counts(*summaries: DataFrame) -> DataFrame:
    out = summaries[0].select("grp", "field", "value", "n")
    for s in summaries[1:]:
        out = out.unionByName(s.select("grp", "field", "value", "n"))
    return out.groupBy("grp", "field", "value").agg(F.sum("n").alias("n"))


def bisect_percentiles(counts: DataFrame, percents: Sequence[int], tolerance: int = 0) -> DataFrame:
    """Rows (grp, field, pct, n, value, error): percentile pct is the smallest value that at least pct percent of the n do not exceed.

    counts: grp, field, value, n (merge_counts). Each group and percentile keeps an interval that
    holds its target. A pass counts the rows below the SECTIONS - 1 equidistant midpoints of each
    interval, eight bisections at once, and narrows it to the section of the target rank. Passes end
    when no interval is wider than tolerance + 1; value is then off by at most error, 0 if
    tolerance is 0. The number of passes follows from the widest range, not from the rows. Values
    must lie within +-2**62. A null group is a group of its own; no counts give no rows.
    """
    counts = cut(counts, "counts")
    each = F.explode(F.array(*[F.lit(p) for p in percents]))
    at = counts.groupBy("grp", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")).withColumn("pct", each)
    at = cut(at.select("grp", "field", "pct", "total", F.expr("(total * pct + 99) div 100").alias("rank"), F.lit(0).cast("bigint").alias("below"), "lo", "hi"), "intervals")
    wide = at.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    while wide > tolerance:
        steps = at.withColumn("step", F.expr(f"(hi - lo) div {SECTIONS} + 1")).withColumnsRenamed({"grp": "_grp", "field": "_field"})
        inside = counts.join(broadcast_if_small(steps), F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("field") == F.col("_field")) & F.col("value").between(F.col("lo"), F.col("hi")))
        sections = inside.groupBy("_grp", "_field", "pct", "total", "rank", "below", "lo", "hi", "step", F.expr("(value - lo) div step").alias("i")).agg(F.sum("n").alias("n"))
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("_grp", "_field", "pct").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        hit = sections.withColumn("upto", upto).filter("upto >= rank and upto - n < rank")
        at = hit.select(F.col("_grp").alias("grp"), F.col("_field").alias("field"), "pct", "total", "rank", (F.col("upto") - F.col("n")).alias("below"), F.expr("lo + i * step").alias("lo"), F.expr("least(hi, lo + i * step + step - 1)").alias("hi"))
        at = cut(at, "intervals")
        wide = wide // SECTIONS
    return at.select("grp", "field", "pct", F.col("total").alias("n"), F.expr("lo + (hi - lo) div 2").alias("value"), F.expr("(hi - lo + 1) div 2").alias("error"))

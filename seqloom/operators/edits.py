"""Smaller record operators: trimming, reversed features, mate-flag checks, frequency classes, track lookups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import flags
from seqloom.plans.shared import carried_forward, running_total


def trimmed(reads: DataFrame, length: int) -> DataFrame:
    """Rows (row_id, cigar, seq) of placed records cut to their first bases; operations behind the cut are dropped, shorter records stay."""
    kept = F.expr(f"transform(filter(ops, o -> o.rp <= {length} and o.len > 0), o -> concat(cast(if(o.op in ('M', 'I', 'S', '=', 'X'), least(o.len, {length} - o.rp + 1), o.len) as string), o.op))")
    return reads.select("row_id", F.array_join(kept, "").alias("cigar"), F.substring("seq", 1, length).alias("seq"))


def reversed_features(reads: DataFrame) -> DataFrame:
    """reads with features in reverse order, positions counted from the other end (n - pos - 1)."""
    turned = F.transform(F.reverse("features"), lambda x: F.struct((F.col("n") - x["pos"] - 1).alias("pos"), x["op"].alias("op"), x["text"].alias("text"), x["len"].alias("len")))
    return reads.withColumn("features", turned)


def limited_fields(df: DataFrame, spec: str, keep: list[str]) -> DataFrame:
    """keep and the fields of a spec such as SEQ[10]:QNAME, cut to their length with ... behind; without a number they stay whole."""
    out = []
    for part in spec.split(":"):
        m = re.fullmatch(r"([A-Z]+)(?:\[(\d+)\])?", part)
        if not m:
            raise ValueError(f"not a field: {part!r}")
        c = F.col(m[1].lower()).cast("string")
        out.append((c if m[2] is None else F.when(F.length(c) > int(m[2]), F.concat(F.substring(c, 1, int(m[2])), F.lit("..."))).otherwise(c)).alias(m[1].lower()))
    return df.select(*keep, *out)


def mate_flags_fit(a: Column, b: Column) -> Column:
    """Whether two flag words can be those of one pair."""
    has = flags.has
    each = [(has(x, "unmapped") == has(y, "mate_unmapped")) & (has(x, "reverse") == has(y, "mate_reverse")) for x, y in ((a, b), (b, a))]
    return has(a, "paired") & has(b, "paired") & each[0] & each[1] & (has(a, "proper_pair") == has(b, "proper_pair")) & ~(has(a, "first") & has(b, "first")) & ~(has(a, "last") & has(b, "last"))


def mate_flags_differ(a: Column, b: Column) -> Column:
    """Whether the mate bits of two words for one record differ."""
    return a.bitwiseAND(F.lit(0x28)) != b.bitwiseAND(F.lit(0x28))


def frequency_class(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n, cum_n, total) of an integer column, nulls left out: counts, and counts up to each value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count("*").alias("n"))
    total = df.filter(F.col(column).isNotNull()).count()
    return running_total(counts, [], "value", "n", "cum_n").select("value", "n", "cum_n", F.lit(total).cast("bigint").alias("total"))


def on_track(positions: DataFrame, track: DataFrame) -> DataFrame:
    """positions (rname, refpos) that a track (rname, pos) of known places has."""
    t = track.select(F.col("rname").alias("_n"), F.col("pos").alias("_p"))
    return positions.join(t, (F.col("rname") == F.col("_n")) & (F.col("refpos") == F.col("_p")), "left_semi")


def high_bit(v: Column) -> Column:
    """Place of the highest set bit of a positive integer, from 0; -1 for 0."""
    return F.when(v == 0, -1).otherwise(F.length(F.bin(v)) - 1)


def forward_window(df: DataFrame, order: str, width: int) -> DataFrame:
    """df (rname, pos) with base: the largest position so far in its rname, and in_window: whether pos is less than width behind it.

    A forward-only window of that width has nothing for what lies further behind. order: an integer column.
    """
    df = carried_forward(df, ["rname"], order, F.max("pos"), F.max("pos"), F.max("v"))
    df = df.withColumn("base", F.greatest("_carried", "_within")).drop("_carried", "_within")
    return df.withColumn("in_window", (F.col("base") - F.col("pos") < width).cast("int"))

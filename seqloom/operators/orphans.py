"""References to records that do not exist, by bitmaps over dictionary-encoded keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import broadcast_if_small, cut, partitions_for

#: Periods (days since 1970) of events without a time: a target counts from the start, a reference as the last.
FIRST, LAST = -(2**31), 2**31 - 1
ALWAYS = "timestamp_ntz '0001-01-01 00:00:00'"


def _day(t: Column, missing: int) -> Column:
    return F.coalesce(F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")), F.lit(missing))


def _bits(condition: Column) -> Column:
    """The word of the keys for which the condition holds."""
    return F.coalesce(F.bit_or(F.when(condition, F.col("_mask"))), F.lit(0).cast("bigint"))


def unresolved_keys(refs: DataFrame, targets: DataFrame, keys: Sequence[str], rows: int, per_range: int = 1 << 18) -> DataFrame:
    """Rows (digest, period): xxhash64 of keys referred to in a period without a target that surely stood by then.

    refs: keys..., t (time of the reference), own (whether the referring row is itself a target
    under this key). targets: keys..., t, until (time of removal, or null), row_id. rows: about
    how many of both there are.

    Keys are dictionary-encoded: hashed into key ranges, and numbered densely within a range in
    key order. Per range and period, 64 keys make one word of each bitmap; words without a bit
    are not stored. References AND NOT standing targets leave the survivors, which are decoded
    through the dictionary entries of their word (at most 64). For a row that refers to its own
    key two different rows must stand, whatever their number of deliveries: the one with the
    key's smallest row_id, and another. Targets of the same period count as standing only if they
    all precede its first reference, removals count from the start of their period, so that
    survivors include every unresolved key; the caller checks them row by row.
    """
    none = F.lit(None).cast("timestamp_ntz")
    row = F.col("row_id").cast("bigint").alias("row")
    events = (
        refs.select(*keys, _day(F.col("t"), LAST).alias("period"), F.lit(0).alias("kind"), F.col("t").cast("timestamp_ntz").alias("t"), "own", F.lit(None).cast("bigint").alias("row"))
        .unionByName(targets.select(*keys, _day(F.col("t"), FIRST).alias("period"), F.lit(1).alias("kind"), F.coalesce(F.col("t").cast("timestamp_ntz"), F.expr(ALWAYS)).alias("t"), F.lit(False).alias("own"), row))
        .unionByName(targets.filter(F.col("until").isNotNull()).select(*keys, _day(F.col("until"), LAST).alias("period"), F.lit(2).alias("kind"), none.alias("t"), F.lit(False).alias("own"), row))
    )
    ranges = partitions_for(rows, per_range, refs.sparkSession.sparkContext.defaultParallelism)
    ref, target = F.col("kind") == 0, F.col("kind") == 1
    per_key = events.groupBy(F.pmod(F.xxhash64(*keys), F.lit(ranges)).alias("range"), *keys, "period").agg(
        F.max(F.when(ref, ~F.col("own"))).alias("others"), F.max(F.when(ref, F.col("own"))).alias("owns"), F.min(F.when(ref, F.col("t"))).alias("first_ref"),
        F.max(target).alias("stands"), F.min(F.when(target, F.col("row"))).alias("low"), F.max(F.when(target, F.col("row"))).alias("high"),
        F.max(F.when(target, F.col("t"))).alias("last_target"), F.max(F.col("kind") == 2).alias("removed"),
    )
    coded = per_key.withColumn("_id", F.dense_rank().over(Window.partitionBy("range").orderBy(*keys)) - 1).withColumn("_least", F.min("low").over(Window.partitionBy("range", *keys)))
    coded = coded.withColumn("_mask", F.expr("shiftleft(1L, _id & 63)"))
    early = F.coalesce(F.col("last_target") <= F.col("first_ref"), F.lit(True))
    one, another = F.col("stands") & F.coalesce(F.col("low") == F.col("_least"), F.lit(True)), F.col("stands") & (F.col("high") > F.col("_least"))
    words = coded.groupBy("range", F.shiftright("_id", 6).alias("word"), "period").agg(
        _bits(F.col("others")).alias("r1"), _bits(F.col("owns")).alias("r2"), _bits(one).alias("p1"), _bits(another).alias("p2"),
        _bits(one & early).alias("e1"), _bits(another & early).alias("e2"), _bits(F.col("removed")).alias("w"),
        F.collect_list(F.struct("_mask", F.xxhash64(*keys).alias("digest"))).alias("entries"),
    )
    by_word = Window.partitionBy("range", "word").orderBy("period")
    before, so_far = by_word.rowsBetween(Window.unboundedPreceding, -1), by_word.rowsBetween(Window.unboundedPreceding, 0)
    stood = lambda p, e: F.coalesce(F.bit_or(p).over(before), F.lit(0).cast("bigint")).bitwiseOR(F.col(e))
    words = words.withColumns({"s1": stood("p1", "e1"), "s2": stood("p2", "e2"), "gone": F.bit_or("w").over(so_far)})
    left = words.withColumn("left", F.expr("(r1 & ~(s1 | s2)) | (r2 & ~(s1 & s2)) | ((r1 | r2) & gone)")).filter("left != 0")
    return left.select("period", F.explode(F.expr("filter(entries, x -> (x._mask & left) != 0)")).alias("e")).select("e.digest", "period")


def orphan_references(refs: DataFrame, targets: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """refs with the reason why no target stands: missing, withdrawn or later.

    refs: keys..., t, row_id, own (the row itself is a target under its key) and further columns.
    targets: keys..., t, until, row_id. A row is no target of its own reference, whatever its
    number of deliveries under one row_id. Of several other targets the one never removed counts
    before removed ones, then the first to arrive. missing: there is none; withdrawn: it was
    removed at or before t; later: it arrived after t. Unknown times make no case. Rows with a
    null in the keys refer to nothing and must be left out by the caller. Empty tables give no
    rows, or missing throughout. refs keep their further columns.
    """
    # Only digests of the surviving keys are kept. A key that shares one is judged below like the others, with all its targets.
    left = broadcast_if_small(cut(unresolved_keys(refs, targets, keys, rows).select(F.col("digest").alias("_digest")).distinct(), "orphans"))
    met = F.xxhash64(*keys) == F.col("_digest")
    doubtful, known = refs.join(left, met, "left_semi"), targets.join(left, met, "left_semi")
    known = known.groupBy(*keys, "row_id").agg(F.min(F.coalesce(F.col("t").cast("timestamp_ntz"), F.expr(ALWAYS))).alias("_t"), F.max(F.struct(F.col("until").isNull(), F.col("until").cast("timestamp_ntz").alias("u"))).alias("_u"))
    # The two first targets decide, as at most one of them is the referring row; the group limit is applied before the shuffle.
    known = known.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_u.u").isNotNull(), "_t", "row_id"))).filter("_rn <= 2")
    side = lambda i: F.max(F.when(F.col("_rn") == i, F.struct(F.col("row_id").alias("id"), F.col("_t").alias("t"), F.col("_u.u").alias("u"))))
    known = known.groupBy(*keys).agg(side(1).alias("_1"), side(2).alias("_2"))
    other = F.when(F.col("own") & (F.col("_1.id") == F.col("row_id")), F.col("_2")).otherwise(F.col("_1"))
    judged = doubtful.join(known, list(keys), "left").withColumn("_o", other)
    reason = F.when(F.col("_o").isNull(), "missing").when(F.col("_o.u") <= F.col("t"), "withdrawn").when(F.col("_o.t") > F.col("t"), "later")
    return judged.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_1", "_2", "_o", "own")

"""Overlapping and gapped intervals per entity, from independently ranked starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import attach, cut, running_total


def stretches_and_gaps(df: DataFrame, entity: str, start: str, end: str, block_bits: int = 16) -> DataFrame:
    """Rows (entity, kind, start_pos, end_pos): merged stretches (covered) and the gaps between neighbours.

    Intervals are closed integer intervals; those that overlap or touch (next start = end + 1)
    make one stretch. Rows with a null entity, start or end, or with end < start, cover nothing
    and are left out; repeated rows change nothing. An empty table gives no row. Gaps are listed
    whatever their length.

    Starts and ends are counted per distinct position and ranked independently of each other, in
    blocks of positions, so that a heavy entity is spread over many tasks. With r starts before
    position s, the stretch breaks before s exactly if r ends in all are smaller than s - 1, that
    is, if the r-th end e is: ranks are joined by equality, and (e, s) bounds a gap. The k-th
    boundary on either side gives the k-th stretch.
    """
    df = df.select(F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).filter("entity is not null and s is not null and e >= s")
    points = df.select("entity", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("s").alias("pos")), F.struct(F.lit("e").alias("side"), F.col("e").alias("pos")))).alias("x"))
    counts = points.groupBy("entity", "x.side", "x.pos").agg(F.count("*").alias("n"))
    ranked = running_total(counts, ["entity", "side"], "pos", "n", "upto", block_bits)
    # Starts meet ends at the rank before their first: 0 for the first start of an entity.
    at_rank = ranked.select("entity", F.when(F.col("side") == "s", F.col("upto") - F.col("n")).otherwise(F.col("upto")).alias("rank"), F.when(F.col("side") == "s", F.col("pos")).alias("s"), F.when(F.col("side") == "e", F.col("pos")).alias("e"))
    bounds = at_rank.groupBy("entity", "rank").agg(F.max("s").alias("s"), F.max("e").alias("e"))
    # No end at rank 0, no start at the last one; else a break where the start lies beyond the end by more than 1.
    bounds = cut(bounds.filter("s is null and e is not null and rank > 0 or e is null and rank = 0 or s > e + 1"), "bounds")
    last = bounds.groupBy("entity").agg(F.max("rank").alias("last"))
    bounds = attach(bounds, last, ["entity"], ["rank"]).filter("s is not null or rank = last")
    first = bounds.filter("s is not null").select("entity", F.col("s").alias("pos"), F.col("e"), F.lit(1).alias("n"))
    starts = running_total(first, ["entity"], "pos", "n", "k", block_bits).select("entity", "k", F.col("pos").alias("s"), F.col("e").alias("gap_end"))
    final = bounds.filter("s is null").select("entity", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("s"), F.col("e").alias("gap_end"))
    # One row per entity on either side.
    count = starts.groupBy("entity").agg(F.max("k").alias("m"))
    final = final.drop("k").join(count, "entity").select("entity", (F.col("m") + 1).alias("k"), "s", "gap_end")
    both = starts.unionByName(final)
    gaps = starts.filter("gap_end is not null").select("entity", F.lit("gap").alias("kind"), (F.col("gap_end") + 1).alias("start_pos"), (F.col("s") - 1).alias("end_pos"))
    pieces = both.select("entity", F.explode(F.array(F.struct("k", "s", F.lit(None).cast("bigint").alias("e")), F.struct((F.col("k") - 1).alias("k"), F.lit(None).cast("bigint").alias("s"), F.col("gap_end").alias("e")))).alias("p"))
    covered = pieces.groupBy("entity", "p.k").agg(F.max("p.s").alias("start_pos"), F.max("p.e").alias("end_pos")).filter("start_pos is not null")
    return covered.select("entity", F.lit("covered").alias("kind"), "start_pos", "end_pos").unionByName(gaps)

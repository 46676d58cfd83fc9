"""Batches in coordinate order, and mates within and across them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import flags
from seqloom.plans.shared import row_numbers


def batched(reads: DataFrame, size: int) -> DataFrame:
    """reads with rn, the place in coordinate order within rname, and batch: a new one after size records or another rname.

    Rows without a name have rname *, and are ordered by row_id alone. Null positions count as 0.
    """
    df = reads.withColumn("rname", F.coalesce("rname", F.lit("*"))).withColumn("pos", F.when(F.col("rname") == "*", 0).otherwise(F.coalesce("pos", F.lit(0))))
    rough = F.when(F.col("rname") == "*", F.shiftright("row_id", 12)).otherwise(F.shiftright("pos", 10).cast("bigint"))
    df = row_numbers(df, ["rname"], ["pos", "row_id"], rough, "rn")
    return df.withColumn("batch", F.expr(f"cast((rn - 1) div {size} as bigint)"))


def batch_mates(batches: DataFrame, columns: list[str]) -> DataFrame:
    """batches with pair and mate_<column>: within a batch the first record of a name goes with the second, the third begins a new pair.

    Flags are ignored. A record without partner, or without name, is detached: its mate columns are null.
    Groups are bounded by the size of a batch.
    """
    by_name = Window.partitionBy("rname", "batch", "qname").orderBy("rn")
    df = batches.withColumn("pair", F.floor((F.row_number().over(by_name) - 1) / 2).cast("bigint"))
    in_pair = Window.partitionBy("rname", "batch", "qname", "pair").orderBy("rn")
    other = lambda c: F.when(F.col("qname").isNotNull(), F.coalesce(F.lead(c).over(in_pair), F.lag(c).over(in_pair)))
    return df.withColumns({f"mate_{c}": other(c) for c in columns})


def to_next(mates: DataFrame) -> Column:
    """Records between the first member of a pair and the second; null for others. mates has mate_rn."""
    return F.when(F.col("mate_rn") > F.col("rn"), F.col("mate_rn") - F.col("rn") - 1)


def restore_mates(batches: DataFrame) -> DataFrame:
    """Rows (row_id, mate_row_id) of both members, from the distances alone: the partner of row rn is row rn + distance + 1."""
    first = batches.filter("distance is not null").select("rname", F.col("row_id").alias("a"), (F.col("rn") + F.col("distance") + 1).alias("rn"))
    pair = first.join(batches.select("rname", "rn", F.col("row_id").alias("b")), ["rname", "rn"])
    return pair.select(F.explode(F.array(F.struct(F.col("a").alias("row_id"), F.col("b").alias("mate_row_id")), F.struct(F.col("b").alias("row_id"), F.col("a").alias("mate_row_id")))).alias("x")).select("x.*")


def insert_size(start1: Column, end1: Column, reverse1: Column, start2: Column, end2: Column, reverse2: Column) -> Column:
    """From the 5' end of the first to that of the second, one more away from 0."""
    a, b = F.when(reverse1, end1).otherwise(start1), F.when(reverse2, end2).otherwise(start2)
    return b - a + F.when(b >= a, 1).otherwise(-1)


def query_mates(reads: DataFrame) -> DataFrame:
    """Rows (row_id, n_mates, mate_row_id) of paired records with a name and one of the two end flags.

    A mate has the same name and the other end flag only. mate_row_id is null unless there is
    exactly one. Names are counted before the join, so that no pairs of records are formed.
    """
    flag = F.col("flag")
    end = F.when(flags.has(flag, "first") & ~flags.has(flag, "last"), 1).when(flags.has(flag, "last") & ~flags.has(flag, "first"), 2)
    ends = reads.filter("(flag & 1) = 1 and qname is not null").select("row_id", "qname", end.alias("end")).filter("end is not null")
    counts = ends.groupBy("qname", "end").agg(F.count("*").alias("n"), F.min("row_id").alias("one")).select("qname", (3 - F.col("end")).alias("end"), "n", "one")
    return ends.join(counts, ["qname", "end"], "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n_mates"), F.when(F.col("n") == 1, F.col("one")).alias("mate_row_id"))


def loose_mate_info(reads: DataFrame) -> DataFrame:
    """Rows (row_id, rnext, pnext, mate_reverse, mate_unmapped, mq, tlen): mate fields set anew for names with exactly one first and one last record.

    reads: row_id, qname, flag, rname, pos, mapq, end (last reference base). MQ is taken over only
    between two mapped records; the insert size is 0 unless both are mapped to one sequence.
    """
    flag = F.col("flag")
    primary = reads.filter("qname is not null and (flag & 1) = 1 and (flag & 2304) = 0")
    rec = F.struct("row_id", "rname", "pos", "end", "mapq", flags.has(flag, "reverse").alias("rev"), flags.has(flag, "unmapped").alias("un"))
    side = lambda n: F.max(F.when(flags.has(flag, n), rec))
    count = lambda n: F.count_if(flags.has(flag, n))
    pairs = primary.groupBy("qname").agg(count("first").alias("na"), count("last").alias("nb"), F.count("*").alias("n"), side("first").alias("a"), side("last").alias("b")).filter("na = 1 and nb = 1 and n = 2 and a.row_id <> b.row_id")
    mapped = ~F.col("a.un") & ~F.col("b.un")
    size = lambda x, y: F.when(mapped & (F.col("a.rname") == F.col("b.rname")), insert_size(F.col(f"{x}.pos"), F.col(f"{x}.end"), F.col(f"{x}.rev"), F.col(f"{y}.pos"), F.col(f"{y}.end"), F.col(f"{y}.rev"))).otherwise(0)
    ahead = F.col("a.pos") < F.col("b.pos")
    first = F.when(ahead, size("a", "b")).otherwise(-size("b", "a"))
    both = F.col("a.un") & F.col("b.un")

    def one(x: str, y: str, tlen: Column) -> Column:
        return F.struct(
            F.col(f"{x}.row_id").alias("row_id"), F.when(both, F.lit("*")).otherwise(F.col(f"{y}.rname")).alias("rnext"), F.when(both, 0).otherwise(F.col(f"{y}.pos")).alias("pnext"),
            F.col(f"{y}.rev").cast("int").alias("mate_reverse"), F.col(f"{y}.un").cast("int").alias("mate_unmapped"), F.when(mapped, F.col(f"{y}.mapq")).alias("mq"), tlen.cast("bigint").alias("tlen"),
        )

    return pairs.select(F.explode(F.array(one("a", "b", first), one("b", "a", -first))).alias("x")).select("x.*")


def position_deltas(batches: DataFrame) -> DataFrame:
    """batches with delta, the step from the record before in its batch (0 for the first), and batch_start."""
    by = Window.partitionBy("rname", "batch").orderBy("rn")
    return batches.withColumn("delta", F.col("pos") - F.coalesce(F.lag("pos").over(by), F.col("pos"))).withColumn("batch_start", F.first("pos").over(by))


def restore_positions(deltas: DataFrame) -> DataFrame:
    """pos from batch_start and the deltas."""
    by = Window.partitionBy("rname", "batch").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("pos", (F.col("batch_start") + F.sum("delta").over(by)).cast("int"))

"""Ordered merging of sources and of their headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import row_numbers


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """All rows with source, the place of their source; a column that a source lacks is null."""
    out = None
    for i, df in enumerate(sources):
        df = df.withColumn("source", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merged_order(df: DataFrame) -> DataFrame:
    """df (rname, pos, source, row_id) with ord, the place in the merge within rname: by position, then source, then place in the source.

    Unplaced rows (no name, *, no position) come under rname * in the order of their sources.
    """
    free = F.col("rname").isNull() | (F.col("rname") == "*") | (F.coalesce("pos", F.lit(0)) <= 0)
    df = df.withColumn("rname", F.when(free, "*").otherwise(F.col("rname"))).withColumn("_p", F.when(free, 0).otherwise(F.col("pos")).cast("bigint"))
    rough = F.when(free, F.col("source").cast("bigint")).otherwise(F.shiftright("_p", 10))
    return row_numbers(df, ["rname"], ["_p", "source", "row_id"], rough, "ord").drop("_p")


def written_in_order(df: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows of merged_order in the order of contigs (sequence_id), range-partitioned: each file of a write is sorted and follows the one before."""
    ids = contigs.select(F.col("name").alias("rname"), "sequence_id")
    joined = df.join(ids, "rname", "left").withColumn("_id", F.coalesce("sequence_id", F.lit(2**31 - 1)))
    return joined.repartitionByRange("_id", "ord").sortWithinPartitions("_id", "ord").drop("_id", "sequence_id")


def prefixed_names(df: DataFrame, ids: DataFrame) -> DataFrame:
    """df with qname as <id of its source>.<qname>; ids: source, id."""
    return df.join(F.broadcast(ids), "source").withColumn("qname", F.concat_ws(".", "id", "qname")).drop("id")


def resolve_collisions(ids: DataFrame) -> DataFrame:
    """ids (source, id) where an id that several sources share gets 1, 2, ... appended in the order of sources."""
    of = Window.partitionBy("id")
    return ids.select("source", F.when(F.count("*").over(of) > 1, F.concat("id", F.row_number().over(of.orderBy("source")).cast("string"))).otherwise(F.col("id")).alias("id"))


def merge_headers(entries: DataFrame, key: str) -> DataFrame:
    """The entry of the first source for each key; entries: source, key and further columns. Ties within a source go to the smallest entry."""
    rest = [c for c in entries.columns if c != key]
    first = entries.groupBy(key).agg(F.min(F.struct("source", *[c for c in rest if c != "source"])).alias("x"))
    return first.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def merge_header_lines(lines: DataFrame) -> DataFrame:
    """Rows (part, place, value): the header of a merge, in the order of its lines.

    lines: source (its place among the sources), name (of the source), kind (SQ, PG, RG or CO), id,
    place (in its source) and value. Sequences, programs and read groups are those of the first
    source that has their id, and stand in the order of sources and places; comments stay, all of
    them, and a last one names the sources. Headers are small by nature: so are the windows here.
    """
    part = F.when(F.col("kind") == "SQ", 1).when(F.col("kind") == "RG", 2).when(F.col("kind") == "PG", 3).otherwise(4)
    rank = F.row_number().over(Window.partitionBy("kind", "id").orderBy("source", "place"))
    kept = lines.withColumn("_rank", F.when(F.col("kind") == "CO", 1).otherwise(rank)).filter("_rank = 1").withColumn("part", part)
    kept = kept.select("part", F.row_number().over(Window.partitionBy("part").orderBy("source", "place")).cast("bigint").alias("place"), "value")
    names = F.transform(F.array_sort(F.collect_set(F.struct("source", "name"))), lambda x: x["name"])
    return kept.unionByName(lines.agg(names.alias("n")).filter("size(n) > 0").select(F.lit(5).alias("part"), F.lit(1).cast("bigint").alias("place"), F.concat(F.lit("@CO\tMerged from: "), F.array_join("n", " ")).alias("value")))

"""Letters of sequences and names of contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def normalise(seq: Column) -> Column:
    """Upper case, everything but ACGTN as N."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def is_strict(seq: Column) -> Column:
    """Whether the strict form would accept it."""
    return ~F.upper(seq).rlike("[^ACGTN]")


def resolve_names(names: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows (name, contig): the contig of a name, tried as it is, M for MT and back, without or with chr, chrM as MT; null if none."""
    name = F.col("name")
    tries = F.array_compact(F.array(name, F.when(name == "M", F.lit("MT")), F.when(name == "MT", F.lit("M")), F.when(F.lower(F.substring(name, 1, 3)) == "chr", F.expr("substring(name, 4)")).otherwise(F.concat(F.lit("chr"), name)), F.when(name == "chrM", F.lit("MT"))))
    each = names.select("name").distinct().select("name", F.posexplode(tries).alias("rank", "contig"))
    known = contigs.select(F.col("name").alias("contig")).distinct()
    best = each.join(known, "contig", "left_semi").groupBy("name").agg(F.min_by("contig", "rank").alias("contig"))
    return names.select("name").distinct().join(best, "name", "left")

"""FASTQ: records of four lines, in one file or two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fastq_records(reads: DataFrame, swapped: bool = False) -> DataFrame:
    """reads with file (0 unpaired, 1 and 2 the ends of pairs) and record, the four lines.

    Secondary and supplementary rows are left out. Bases stay as they are aligned, without
    reverse complement. swapped puts the first of a pair into file 2, the second into file 1.
    """
    first, second = (2, 1) if swapped else (1, 2)
    flag = F.col("flag")
    part = F.when(flag.bitwiseAND(1) == 0, 0).when(flag.bitwiseAND(64) != 0, first).otherwise(second)
    cell = lambda c: F.coalesce(F.col(c), F.lit("*"))
    record = F.concat_ws("\n", F.concat(F.lit("@"), cell("qname")), cell("seq"), F.lit("+"), cell("qual"))
    return reads.filter(flag.bitwiseAND(0x900) == 0).withColumn("file", part).withColumn("record", record)


def write_fastq(reads: DataFrame, path: str, gzip: bool = False, swapped: bool = False) -> None:
    """One folder of text files per value of file below path."""
    out = fastq_records(reads, swapped).select("file", F.col("record").alias("value"))
    out.write.partitionBy("file").option("compression", "gzip" if gzip else "none").text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Rows (qname, seq, qual) of the FASTQ files at or below path, plain or gzipped; plain ones are split by byte ranges."""
    from seqloom.sources.binary import FastqSource

    spark.dataSource.register(FastqSource)
    return spark.read.format(FastqSource.name()).load(path)

"""FASTA: whole sequences, chunks, sub-ranges, and the search for a reference file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.files import exists, open_file


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows (rname, seq): one per sequence, its lines joined, as they are written. A file is read in records that begin with >."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(text, "^([^ \t\r\n]*)", 1)
    df = records.select(text.alias("_t"), name.alias("rname")).filter("rname <> ''")
    return df.select("rname", F.regexp_replace(F.coalesce(F.when(F.instr("_t", "\n") > 0, F.expr("substring(_t, instr(_t, '\\n') + 1)")), F.lit("")), "[\r\n]", "").alias("seq"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, length bigint, byte_offset bigint, line_bases int, line_width int")


def byte_range(fai: DataFrame, start: str, end: str) -> DataFrame:
    """fai with first_byte and last_byte of the bases start to end (1-based, inclusive columns)."""
    at = lambda p: F.expr(f"byte_offset + (({p} - 1) div line_bases) * line_width + ({p} - 1) % line_bases")
    return fai.withColumn("first_byte", at(start)).withColumn("last_byte", at(end))


def sub_range(sequences: DataFrame, name: str, start: int, length: int) -> DataFrame:
    """The bases of a sequence from start to start + length, both ends included: one more than length."""
    return sub_ranges(sequences.filter(F.col("rname") == name), "seq", start, length).select("rname", "seq")


def sub_ranges(df: DataFrame, column: str, start: int, length: int) -> DataFrame:
    """df with the column cut to the bases from start to start + length."""
    return df.withColumn(column, F.substring(column, start, length + 1))


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """Rows (rname, line_no, value): the lines of a FASTA file, line 0 the name."""
    n = F.ceil(F.length("seq") / width).cast("int")
    body = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("seq"), (i - 1) * width + 1, F.lit(width)))
    all_lines = F.concat(F.array(F.concat(F.lit(">"), "rname")), F.when(n > 0, body).otherwise(F.array().cast("array<string>")))
    return sequences.select("rname", F.posexplode(all_lines).alias("line_no", "value"))


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """One record per row: the lines of a sequence stay together."""
    joined = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), "rname", F.lit("\n"), joined).alias("value")).write.text(path)


def find_reference(path: str, given: str | None = None) -> str:
    """A given path; else X.fa beside X.<any>; else the path in X.ref; else the environment's SEQLOOM_REFERENCE."""
    stem = os.path.splitext(path)[0]
    named = None
    if exists(f"{stem}.ref"):
        with open_file(f"{stem}.ref") as f:
            named = f.readline().decode().strip()
    for candidate in (given, f"{stem}.fa", named, os.environ.get("SEQLOOM_REFERENCE")):
        if candidate and exists(candidate):
            return candidate
    raise FileNotFoundError(f"no reference for {path}")


def check_md5(sequences: DataFrame, header: DataFrame) -> DataFrame:
    """header (name, m5) with md5 of the upper-case bases and ok; null where the sequence or m5 is absent."""
    own = sequences.select(F.col("rname").alias("name"), F.md5(F.upper("seq")).alias("md5"))
    return header.join(own, "name", "left").withColumn("ok", F.lower("m5") == F.col("md5"))


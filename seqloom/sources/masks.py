"""Position masks: a line of numbers, or a line of x and _."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS, MARKS = r"^[0-9]+( [0-9]+)*\s*$", "^[x_]+$"


def parse_positions(line: Column) -> Column:
    """Positions of a line such as "12 40 77"; what isn't a number is left out."""
    return F.array_compact(F.transform(F.split(line, " "), lambda x: x.try_cast("int")))


def parse_marks(line: Column) -> Column:
    """1-based positions of x in a line such as "__x__x"."""
    marks = F.split(line, "")
    at = F.transform(marks, lambda c, i: F.when(c == "x", i + 1))
    return F.array_compact(at)


def read_masks(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """Rows (line_no, mask) of a mask file; form numbers or marks, else known by its first line."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    if form is None:
        first = lines.select("line").first()
        form = "marks" if first and first[0] and set(first[0]) <= {"x", "_"} else "numbers"
    parse = parse_marks if form == "marks" else parse_positions
    return lines.select("line_no", parse(F.col("line")).alias("mask"))


def mask_statistics(masks: DataFrame) -> DataFrame:
    """masks with n_masked, first_pos and last_pos instead of the array mask."""
    rest = [c for c in masks.columns if c != "mask"]
    return masks.select(*rest, F.size("mask").alias("n_masked"), F.array_min("mask").alias("first_pos"), F.array_max("mask").alias("last_pos"))


def dense(mask: Column) -> Column:
    """0/1 per position up to the last masked one."""
    return F.when(F.size(mask) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.array_max(mask)), lambda i: F.array_contains(mask, i).cast("int")))


def is_masked(mask: Column, pos: Column) -> Column:
    return F.array_contains(mask, pos)

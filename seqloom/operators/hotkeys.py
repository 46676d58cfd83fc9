"""Results per key where a few keys hold most rows, by value-frequency compression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import attach, running_total


def value_frequencies(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows (key, field, value, n) of integer columns, nulls included: the compressed form of df.

    All later work runs on these rows. The count is combined before the shuffle, so that a key
    with a third of all rows sends each of its values once per task.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("bigint").alias("value")) for v in values]))
    return df.select(F.col(key).alias("key"), fields.alias("f")).groupBy("key", "f.field", "f.value").agg(F.count("*").alias("n"))


def weighted_percentiles(freq: DataFrame, percents: Sequence[int]) -> DataFrame:
    """Rows (key, field, pct, value): the smallest value that pct percent of the rows do not exceed; nulls are left out."""
    freq = freq.filter(F.col("value").isNotNull())
    totals = freq.groupBy("key", "field").agg(F.sum("n").alias("total"))
    ranked = running_total(freq, ["key", "field"], "value", "n", "upto")
    joined = attach(ranked, totals, ["key", "field"], ["value"])
    rank = F.expr("(total * pct + 99) div 100")
    return joined.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents]))).filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select("key", "field", "pct", "value")


def key_profile(df: DataFrame, key: str, values: Sequence[str], percents: Sequence[int] = (50, 90)) -> DataFrame:
    """One row per key and integer column: rows, nulls, distinct values, mode and percentiles, and the key's share.

    Columns key, field, n_rows, n_nulls, n_distinct, mode (the smallest of the most frequent
    values), mode_n, p<percent>..., all_rows, share. The null key is a key of its own. A column
    without a value has 0 distinct values and null mode and percentiles. An empty table gives no
    row. Columns of df other than those named are ignored. Values must be integers.
    """
    freq = value_frequencies(df, key, values)
    known = F.col("value").isNotNull()
    per = freq.groupBy("key", "field").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_nulls"), F.count("value").alias("n_distinct"),
        F.max(F.when(known, F.struct(F.col("n"), (-F.col("value").cast("decimal(20,0)")).alias("low"), F.col("value").alias("v")))).alias("_mode"),
    )
    pct = weighted_percentiles(freq, percents).groupBy("key", "field").agg(*[F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"p{p}") for p in percents])
    pct = pct.select(F.col("key").alias("_k"), F.col("field").alias("_f"), *[f"p{p}" for p in percents])
    out = per.join(pct, F.col("key").eqNullSafe(F.col("_k")) & (F.col("field") == F.col("_f")), "left")
    total = df.count()
    return out.select("key", "field", "n_rows", "n_nulls", "n_distinct", F.col("_mode.v").alias("mode"), F.col("_mode.n").alias("mode_n"), *[f"p{p}" for p in percents], F.lit(total).cast("bigint").alias("all_rows"), (F.col("n_rows") / F.lit(max(total, 1))).alias("share"))


def heavy_keys(df: DataFrame, key: str, value: str, percent: int) -> DataFrame:
    """The keys that hold at least percent of all rows, by the compressed form; nulls count among all rows."""
    freq = value_frequencies(df, key, [value])
    total = df.count()
    return freq.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct")).filter(F.col("n_rows") * 100 >= F.lit(total) * percent)

"""Lineage cuts in the shared folder, size-checked broadcasts and two-level running totals."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Measured bytes up to which a table may be broadcast: texts by their length, CELL bytes for each value beside them.
BROADCAST_BYTES = 1 << 20
CELL = 16
#: Parts into which the rows of one key are spread where a join on it can't be a broadcast.
SALTS = 32

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an own one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", named)
        _written.append((spark, named))
    return named


def scratch(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df once into the shared folder and go on from the written table.

    The table survives the loss of executors, has a known size and keeps later plans short.
    It is removed when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written(kept: int = 0) -> None:
    while len(_written) > kept:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already
            return


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written into the shared folder within it: for sessions that run query after query."""
    shared_folder(spark)
    kept = len(_written)
    try:
        yield
    finally:
        _remove_written(kept)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of df as BROADCAST_BYTES counts them; one pass over it, so that df should be a written table."""
    wide = [c for c, t in df.dtypes if t == "string" or t == "binary"]
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    sizes = [F.sum(F.octet_length(c)) for c in wide] + [F.sum(F.length(F.to_json(F.struct(c)))) for c in nested]
    n, *more = df.agg(F.count("*"), *sizes).first()
    return n * CELL * len(df.columns) + sum(x or 0 for x in more)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its measured bytes allow it; else leave it to a shuffle."""
    return F.broadcast(df) if measured_bytes(df) <= BROADCAST_BYTES else df


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """df with the further columns of facts, which has one row per key (null is a key like any other); rows without one are left out.

    A key may hold any share of df: facts are broadcast if they are small enough; else the rows of
    a key are spread over SALTS parts by the columns spread_by, and facts are repeated for each part.
    """
    facts = cut(facts, "facts")
    other = facts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    if measured_bytes(facts) <= BROADCAST_BYTES:
        other = F.broadcast(other)
    else:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
        other = other.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        same = same & (F.col("_salt") == F.col("_part"))
    return df.join(other, same).drop("_salt", "_part", *[f"_k{i}" for i in range(len(keys))])


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_partition))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: for work that takes far longer than a shuffle of its input.

    A table of enough files or row groups, as any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def running_total(df: DataFrame, keys: Sequence[str], order: str, n: str, out: str, block_bits: int = 16) -> DataFrame:
    """Add the sum of n over the rows of the same keys up to and including this one, in the order of an integer column.

    (keys, order) must be unique. A single window per key would put a heavy key into one task;
    here windows run inside blocks of 2**block_bits order values, and a second, small window
    runs over the block sums of each key.
    """
    block = F.shiftright(F.col(order), block_bits)
    df = df.withColumn("_block", block)
    sums = df.groupBy(*keys, "_block").agg(F.sum(n).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_block"])], "_before")
    same = F.lit(True)
    for i, k in enumerate([*keys, "_block"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(sums, same).withColumn(out, F.col("_before") + F.sum(n).over(inside)).drop("_block", "_before", *[f"_k{i}" for i in range(len(keys) + 1)])


def digest(*cols: Column) -> Column:
    """A 64-bit digest in which nulls count (xxhash64 alone skips them)."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, out: str) -> DataFrame:
    """Number the rows of the same keys from 1 in the given order, without one task per key.

    block: an integer that never falls along the order (a coarser form of its first column). Rows
    are numbered inside a block; the rows of earlier blocks are added from a small table.
    """
    df = df.withColumn("_block", block)
    sums = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    if keys:
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:  # all blocks are of one key: they are summed up in blocks of blocks
        sums, before = running_total(sums.withColumnRenamed("_block", "_b"), [], "_b", "_n", "_upto").withColumnRenamed("_b", "_block"), F.col("_upto") - F.col("_n")
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_block"])], before.alias("_before"))
    same = F.lit(True)
    for i, k in enumerate([*keys, "_block"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return df.join(sums, same).withColumn(out, F.col("_before") + inside).drop("_block", "_before", *[f"_k{i}" for i in range(len(keys) + 1)])


def carried_forward(df: DataFrame, keys: Sequence[str], order: str, over_block: Column, within: Column, so_far: Column, block_bits: int = 16) -> DataFrame:
    """df with _carried: what the earlier blocks of the same keys, in the order of an integer column, hand on to this one; null in the first.

    over_block sums a block up (as the column v), so_far combines v over the earlier blocks in a window
    named by the second, small table; within is added as _within, over the window of the block. No
    window holds a whole key.
    """
    df = df.withColumn("_block", F.shiftright(F.col(order), block_bits))
    blocks = df.groupBy(*keys, "_block").agg(over_block.alias("v"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), so_far.over(before).alias("_carried"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return df.join(blocks, same).withColumn("_within", within.over(inside)).drop("_block", "_b", *[f"_k{i}" for i in range(len(keys))])

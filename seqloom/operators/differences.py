"""Differences between two copies of a dataset, by hierarchical checksums over key ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import broadcast_if_small, cut, digest

def _records(df: DataFrame, key: str, fields: Sequence[str], version: str | None, leaf_bits: int) -> DataFrame:
    """key, leaf range, version and digest of each delivered row, and its fields."""
    own = F.col(version) if version else F.lit(None).cast("timestamp")
    df = df.select(F.col(key).cast("bigint").alias("key"), own.alias("version"), *[F.col(f).alias(f"f_{f}") for f in fields])
    return df.select("key", F.shiftright("key", leaf_bits).alias("node"), F.struct("version", digest(*[F.col(f"f_{f}") for f in fields]).alias("h")).alias("rec"), F.struct(*[f"f_{f}" for f in fields]).alias("values"))


def _standing(records: DataFrame) -> DataFrame:
    """One digest per key: that of the latest version, ties broken by the greater digest. Keys of one leaf range stay together."""
    return records.select("node", "key", "rec").repartition("node").groupBy("node", "key").agg(F.max("rec").alias("rec"))


def _leaves(standing: DataFrame, side: str) -> DataFrame:
    h = digest(F.col("key"), F.col("rec.h"))
    return standing.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(0xFFFF)).alias("s")).select("node", F.struct("n", "x", "s").alias(side))


def differing_ranges(leaves: DataFrame, fan_bits: int = 4) -> DataFrame:
    """Leaf ranges (node) whose checksums differ, found from the top down; a written table.

    leaves: node and the checksums l and r of either side (n, x, s; null where a side has no
    record). The levels above are summed up once each, on the way up. Each step down splits the
    ranges still in question into 2**fan_bits parts, fan_bits bisections at once, and compares
    only the parts below a mismatched range.
    """
    low, high = leaves.agg(F.min("node"), F.max("node")).first()
    span, levels = max(high if high is not None else 0, -(low or 0) - 1, 0), [leaves]
    while span > 0:
        sums = [F.struct(F.sum(f"{x}.n").alias("n"), F.bit_xor(f"{x}.x").alias("x"), F.sum(f"{x}.s").alias("s")).alias(x) for x in "lr"]
        levels.append(cut(levels[-1].groupBy(F.shiftright("node", fan_bits).alias("node")).agg(*sums), "level"))
        span >>= fan_bits
    differ = ~(F.col("l.n").eqNullSafe(F.col("r.n")) & F.col("l.x").eqNullSafe(F.col("r.x")) & F.col("l.s").eqNullSafe(F.col("r.s")))
    wrong = None
    for level in reversed(levels):
        if wrong is not None:
            up = F.shiftright("node", fan_bits)
            level = level.join(broadcast_if_small(wrong).withColumnRenamed("node", "_up"), up.eqNullSafe(F.col("_up")), "left_semi")
        wrong = cut(level.filter(differ).select("node"), "ranges")
    return wrong


def copy_differences(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str], names: tuple[str, str] = ("left", "right"), version: tuple[str | None, str | None] = (None, None), leaf_bits: int = 4, fan_bits: int = 4) -> DataFrame:
    """Rows (key, field): records missing on a side, and fields that differ between the sides.

    key is an integer column. Of several rows with one key on a side the one with the latest
    version counts, then the one with the greater digest; exact repetitions count once. Fields
    are compared exactly, null equals null only. A null key is a key of its own. Empty tables
    differ in every record of the other side. Other columns of either table are ignored.

    Both sides are digested per key and summed per range of 2**leaf_bits keys; the ranges are
    compared from the top down (differing_ranges). Only below mismatched leaf ranges are the
    digests of single records compared, and only for records whose digests differ are the
    fields fetched.
    """
    sides = [_records(df, key, fields, v, leaf_bits) for df, v in zip((left, right), version, strict=True)]
    l, r = (_leaves(_standing(x), s) for s, x in zip("lr", sides, strict=True))
    leaves = l.withColumnRenamed("node", "_l").join(r.withColumnRenamed("node", "_r"), F.col("_l").eqNullSafe(F.col("_r")), "full")
    wrong = broadcast_if_small(differing_ranges(cut(leaves.select(F.coalesce("_l", "_r").alias("node"), "l", "r"), "leaves"), fan_bits)).withColumnRenamed("node", "_up")
    within = [x.join(wrong, F.col("node").eqNullSafe(F.col("_up")), "left_semi") for x in sides]
    a, b = (_standing(x).select(F.col("key").alias(f"{s}_key"), F.col("rec.h").alias(f"{s}_h"), F.lit(True).alias(s)) for s, x in zip("lr", within, strict=True))
    pairs = a.join(b, F.col("l_key").eqNullSafe(F.col("r_key")), "full").filter(F.col("l").isNull() | F.col("r").isNull() | (F.col("l_h") != F.col("r_h")))
    keys = cut(pairs.select(F.when(F.col("l"), F.col("l_key")).otherwise(F.col("r_key")).alias("key"), F.coalesce("l", F.lit(False)).alias("l"), F.coalesce("r", F.lit(False)).alias("r")), "keys")
    lone = keys.filter(~(F.col("l") & F.col("r"))).select("key", F.when(F.col("l"), f"missing_in_{names[1]}").otherwise(f"missing_in_{names[0]}").alias("field"))
    both = keys.filter("l and r").select("key")
    both = broadcast_if_small(both).withColumnRenamed("key", "_key")
    rows = [x.join(both, F.col("key").eqNullSafe(F.col("_key")), "left_semi").select("key", F.lit(i).alias("side"), "rec", "values") for i, x in enumerate(sides)]
    latest = rows[0].unionByName(rows[1]).groupBy("key").agg(*[F.max_by(F.when(F.col("side") == i, F.col("values")), F.when(F.col("side") == i, F.col("rec"))).alias(s) for i, s in enumerate("lr")])
    changed = F.array(*[F.when(~F.col(f"l.f_{f}").eqNullSafe(F.col(f"r.f_{f}")), F.lit(f)) for f in fields])
    return lone.unionByName(latest.select("key", F.explode(F.array_compact(changed)).alias("field")))

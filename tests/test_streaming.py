"""Streams of several micro-batches."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from seqloom.operators.alignment import coverage_runs
from seqloom.streaming import mates

SCHEMA = "row_id bigint, qname string, rname string, pos int, cigar string, loaded_at timestamp"


def add(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def made(n, seed):
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    return [(seed * 1000 + i, rng.choice([None, *"abcdefgh"]), rng.choice(["c", "c", "d", "*", None]), rng.choice([None, 0, *range(1, 40)]), rng.choice(["5M", "2S3M4N1M", "*", None, "5Mx"]), at + dt.timedelta(days=rng.randrange(5))) for i in range(n)]


def test_pileup_of_three_batches_is_that_of_the_whole(spark, tmp_path):
    parts = [made(60, s) for s in range(3)]
    for p in parts:
        add(spark, p, f"{tmp_path}/in")
    query = mates.stream_pileup(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    whole = spark.createDataFrame([r for p in parts for r in p], SCHEMA).filter("rname <> '*' and pos >= 1 and cigar in ('5M', '2S3M4N1M')").withColumn("span", F.when(F.col("cigar") == "5M", 5).otherwise(8))
    got = sorted(map(tuple, mates.read_pileup(spark, f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, coverage_runs(whole).collect())) and got


def test_mates_across_batches(spark, tmp_path):
    rows = [r for s in range(3) for r in made(25, s)]
    for i in range(3):
        add(spark, rows[25 * i : 25 * (i + 1)], f"{tmp_path}/in")
    out = mates.stream_mates(stream(spark, f"{tmp_path}/in"))
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = []
    for name in "abcdefgh":
        ids = sorted(r[0] for r in rows if r[1] == name)
        want += [(name, a, b) for a, b in zip(ids[::2], ids[1::2])]
    assert sorted(map(tuple, spark.read.schema(mates.PAIRS).parquet(f"{tmp_path}/out").collect())) == sorted(want)


def test_waiting_records_are_detached(spark, tmp_path):
    add(spark, [(1, "a", "c", 1, "1M", None), (2, "b", "c", 1, "1M", None), (3, "b", "c", 1, "1M", None)], f"{tmp_path}/in")
    got = []
    query = mates.stream_mates(stream(spark, f"{tmp_path}/in"), wait_ms=500).writeStream.foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while len(got) < 2 and time.time() < until:
            if len(got) == 1:  # a time-out is looked at with the next data
                add(spark, [(9, None, None, None, None, None)], f"{tmp_path}/in")
            time.sleep(1)
    finally:
        query.stop()
    assert sorted(got) == [("a", 1, None), ("b", 2, 3)]


def test_counts_drop_what_is_later_than_the_watermark(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    for rows in ([(1, "a", "c", 1, "1M", day(1)), (2, "a", "c", 1, "1M", day(1))], [(3, "a", "c", 1, "1M", day(9))], [(6, "a", "e", 1, "1M", day(9))], [(4, "a", "c", 1, "1M", day(1)), (5, "a", "d", 1, "1M", day(9))]):
        add(spark, rows, f"{tmp_path}/in")
    out = mates.stream_counts(stream(spark, f"{tmp_path}/in"), late="2 days")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r["start"].day, r["rname"]): r["n_rows"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "c"): 2}


def test_order_of_a_batch(spark):
    df = spark.createDataFrame([(1, "c", 5), (2, "c", 4), (3, "c", 5), (4, "d", 1), (5, "c", None)], "row_id bigint, rname string, pos int")
    assert sorted(r["row_id"] for r in mates.checked_order(df).collect()) == [1, 3, 4, 5]
    with pytest.raises(ValueError, match="position 4 on c"):
        mates.checked_order(df, "raise")
    assert mates.checked_order(df.limit(0), "raise").count() == 0

"""The slice index as gzipped tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "sequence_id int, alignment_start int, alignment_span int, container_start_offset bigint, slice_offset int, slice_size int"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def read_crai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=SCHEMA)


def write_crai(index: DataFrame, path: str) -> None:
    """Files in the order of sequence, start and offset."""
    ordered = index.select(*COLUMNS).repartitionByRange("sequence_id", "alignment_start", "container_start_offset").sortWithinPartitions("sequence_id", "alignment_start", "container_start_offset", "slice_offset")
    ordered.write.option("compression", "gzip").csv(path, sep="\t")


def write_bai(index: DataFrame, contigs: DataFrame, path: str) -> None:
    """Write the slices of one container file as a .bai, for readers that know only those; index: its slice index.

    A slice is a chunk from its container's place on, marked by its number in it; slices of one bin
    in one container make one chunk. One task writes it: it grows with the slices of a file, not
    with its records. contigs: sequence_id, for the number of sequences.
    """
    import pyarrow as pa
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from seqloom.operators.index import linear_index, slice_bin
    from seqloom.sources.binary import bai_bytes
    from seqloom.sources.files import resolve

    n = (contigs.agg(F.max("sequence_id")).first()[0] or 0) + 1
    number = F.row_number().over(Window.partitionBy("container_start_offset").orderBy("slice_offset")) - 1
    placed = index.withColumn("k", number).filter("sequence_id >= 0 and alignment_start > 0")
    place = F.shiftleft("container_start_offset", 16) + F.col("k")
    chunks = placed.withColumn("bin", slice_bin(F.col("alignment_start"), F.col("alignment_span"))).groupBy("sequence_id", "bin", "container_start_offset").agg(F.min(place).alias("a"), (F.max(place) + 1).alias("b"))
    rows = chunks.select("sequence_id", "bin", "a", "b").unionByName(linear_index(placed).select("sequence_id", (-1 - F.col("window")).cast("int").alias("bin"), F.shiftleft("offset", 16).alias("a"), F.lit(0).cast("bigint").alias("b")))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bins, linear = [{} for _ in range(n)], [{} for _ in range(n)]
        for s, b, x, y in zip(*(t.column(c).to_pylist() for c in ("sequence_id", "bin", "a", "b"))):
            if b < 0:
                linear[s][-1 - b] = x
            elif b >= 0:
                bins[s].setdefault(b, []).append((x, y))
        raw = bai_bytes([{b: sorted(c) for b, c in of.items()} for of in bins], [[of[w] for w in sorted(of)] for of in linear])
        fs, inner = resolve(path)
        with fs.open_output_stream(inner, compression=None) as f:
            f.write(raw)
        return pa.table({"n": pa.array([len(raw)], pa.int64())})

    rows.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "n bigint").collect()

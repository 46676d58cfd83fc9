"""Streams of records: mates across micro-batches, and per-batch pileups into a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seqloom.functions.cigar import is_cigar, reference_span
from seqloom.operators.alignment import coverage_steps, runs_of_steps

PAIRS = "qname string, row_id bigint, mate_row_id bigint"


def _pairer(wait_ms: int | None):
    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (waiting,) = state.get
            state.remove()
            yield pd.DataFrame({"qname": [key[0]], "row_id": [waiting], "mate_row_id": pd.array([None], dtype="Int64")})
            return
        ids = sorted(i for f in frames for i in f["row_id"].tolist())
        if state.exists:
            ids = [state.get[0], *ids]
            state.remove()
        pairs = list(zip(ids[0::2], ids[1::2]))
        if len(ids) % 2:
            state.update((ids[-1],))
            if wait_ms is not None:
                state.setTimeoutDuration(wait_ms)
        if pairs:
            yield pd.DataFrame({"qname": [key[0]] * len(pairs), "row_id": [a for a, _ in pairs], "mate_row_id": pd.array([b for _, b in pairs], dtype="Int64")})

    return pair


def stream_mates(stream: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """Rows (qname, row_id, mate_row_id) of a stream with qname and row_id.

    The first record of a name waits for the second; the third begins a new pair. With wait_ms a
    record that has waited so long is given without mate (detached), and the stream must have a
    processing-time trigger; without it records wait on. Records without a name are left out.
    """
    named = stream.filter("qname is not null").select("qname", F.col("row_id").cast("bigint").alias("row_id"))
    timeout = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return named.groupBy("qname").applyInPandasWithState(_pairer(wait_ms), PAIRS, "row_id bigint", "append", timeout)


def stream_counts(stream: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Records per rname and window of loaded_at, with late records up to the watermark."""
    timed = stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)
    return timed.groupBy(F.window("loaded_at", width).alias("w"), "rname").agg(F.count("*").alias("n_rows")).select(F.col("w.start").alias("start"), "rname", "n_rows")


def checked_order(batch: DataFrame, on_backward: str = "drop") -> DataFrame:
    """A batch (rname, pos, row_id) without the rows whose position lies before an earlier one's; raise raises instead.

    What a forward-only window would reject. row_id is the order of the stream.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("rname").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = batch.withColumn("_b", F.coalesce(F.col("pos") < F.max("pos").over(by), F.lit(False)))
    if on_backward == "raise" and (bad := marked.filter("_b").select("rname", "pos").first()):
        raise ValueError(f"position {bad['pos']} on {bad['rname']} comes after a later one")
    return marked.filter("not _b").drop("_b")


def stream_pileup(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch adds the steps of its coverage to the table at path, under the batch's number; read_pileup adds the batches up.

    stream: rname, pos, cigar; records without a name, a place or a CIGAR cover nothing. A batch
    that is run again replaces its own files only.
    """

    def one(batch: DataFrame, number: int) -> None:
        placed = batch.filter("rname <> '*' and pos >= 1").filter(is_cigar(F.col("cigar"))).withColumn("span", reference_span(F.col("cigar")))
        coverage_steps(placed).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    """Rows (rname, start_pos, end_pos, depth) over all micro-batches so far."""
    return runs_of_steps(spark.read.schema("rname string, p bigint, d bigint").parquet(path))

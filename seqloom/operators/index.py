"""Slices, containers and the two indexes over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.cigar import reference_span
from seqloom.functions.region import bin_of
from seqloom.plans.shared import carried_forward, running_total

WINDOW_BITS = 14


def slice_stats(batches: DataFrame) -> DataFrame:
    """Per slice (rname, batch): first start, last base, records and bases. batches: rname, batch, pos, end, n_bases, bytes."""
    return batches.groupBy("rname", "batch").agg(F.min("pos").cast("bigint").alias("alignment_start"), F.max("end").cast("bigint").alias("alignment_end"), F.count("*").alias("n_records"), F.sum("n_bases").alias("n_bases"), F.sum("bytes").alias("slice_size"))


def container_stats(slices: DataFrame, slices_each: int) -> DataFrame:
    """Per container of slices_each slices: the second level of the aggregate."""
    return slices.groupBy("rname", F.floor(F.col("batch") / slices_each).cast("bigint").alias("container")).agg(F.min("alignment_start").alias("alignment_start"), F.max("alignment_end").alias("alignment_end"), F.sum("n_records").alias("n_records"), F.sum("n_bases").alias("n_bases"), F.count("*").alias("n_slices"), F.sum("slice_size").alias("container_size"))


def slice_offsets(slices: DataFrame, contigs: DataFrame, slices_each: int, header: int = 0) -> DataFrame:
    """Index rows (sequence_id, alignment_start, alignment_span, container_start_offset, slice_offset, slice_size) in the order of contigs, for slices laid one after another.

    Unplaced slices are not indexed, but take their room behind the others.
    """
    ids = contigs.select(F.col("name").alias("rname"), "sequence_id")
    place = slices.join(ids, "rname", "left").withColumn("seq", F.coalesce("sequence_id", F.lit(2**31 - 1)).cast("bigint"))
    # At most 2**31 slices per contig: sequence and slice make one order column.
    place = running_total(place.withColumn("at", F.shiftleft("seq", 31) + F.col("batch")), [], "at", "slice_size", "upto", block_bits=33)
    start = F.min(F.col("upto") - F.col("slice_size")).over(Window.partitionBy("rname", F.floor(F.col("batch") / slices_each)))
    return place.withColumn("container_start_offset", start + header).filter("sequence_id is not null").select(
        "sequence_id", "alignment_start", (F.col("alignment_end") - F.col("alignment_start") + 1).alias("alignment_span"), "container_start_offset", (F.col("upto") - F.col("slice_size") + header - F.col("container_start_offset")).alias("slice_offset"), "slice_size")


def sizes_from_offsets(index: DataFrame) -> DataFrame:
    """index with gap: the distance to the next slice of the same container, null for the last."""
    return index.withColumn("gap", F.lead("slice_offset").over(Window.partitionBy("container_start_offset").orderBy("slice_offset")) - F.col("slice_offset"))


def find_slices(index: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (region, sequence_id, start, end) joined with the slices that overlap them.

    Slices are spread over the windows they touch and met there by equality; a slice and a region
    that share several windows meet in the first of them only.
    """
    low = lambda a, b: F.expr(f"sequence(shiftright({a}, {WINDOW_BITS}), shiftright({b}, {WINDOW_BITS}))")
    s = index.withColumn("last", F.expr("greatest(alignment_start + alignment_span - 1, alignment_start)"))
    s = s.withColumn("w", F.explode(low("cast(alignment_start as bigint)", "cast(last as bigint)")))
    r = regions.withColumn("w", F.explode(low("cast(start as bigint)", "cast(end as bigint)")))
    both = r.join(s, ["sequence_id", "w"]).filter("alignment_start <= end and last >= start")
    return both.filter(F.col("w") == F.shiftright(F.greatest(F.col("alignment_start").cast("bigint"), F.col("start").cast("bigint")), WINDOW_BITS)).drop("w", "last")


def leftmost(index: DataFrame) -> DataFrame:
    """The first slice of each sequence."""
    cols = [c for c in index.columns if c != "sequence_id"]
    best = index.groupBy("sequence_id").agg(F.min(F.struct("alignment_start", *[c for c in cols if c != "alignment_start"])).alias("x"))
    return best.select("sequence_id", *[F.col(f"x.{c}").alias(c) for c in cols])


def slice_bin(start: Column, span: Column) -> Column:
    return bin_of(start.cast("int") - 1, (start + F.greatest(span, F.lit(1))).cast("int") - 1)


def bin_chunks(index: DataFrame) -> DataFrame:
    """Rows (sequence_id, bin, first_offset, last_offset, n_slices): slices of one bin, those of one container as one chunk. index: as a slice index."""
    df = index.withColumn("bin", slice_bin(F.col("alignment_start"), F.col("alignment_span")))
    return df.groupBy("sequence_id", "bin", "container_start_offset").agg(F.min("slice_offset").alias("first_offset"), F.max("slice_offset").alias("last_offset"), F.count("*").alias("n_slices"))


def linear_index(index: DataFrame) -> DataFrame:
    """Rows (sequence_id, window, offset): the smallest container offset of the slices that touch a 16 kb window, from the first to the last touched one; windows without any take that of the window before, leading ones 0."""
    touch = F.explode(F.expr(f"sequence(shiftright(cast(alignment_start - 1 as bigint), {WINDOW_BITS}), shiftright(cast(alignment_start + greatest(alignment_span, 1) - 2 as bigint), {WINDOW_BITS}))"))
    least = index.select("sequence_id", touch.alias("window"), "container_start_offset").groupBy("sequence_id", "window").agg(F.min("container_start_offset").alias("offset"))
    every = least.groupBy("sequence_id").agg(F.max("window").alias("m")).select("sequence_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("window"))
    fill = F.last("offset", ignorenulls=True).over(Window.partitionBy("sequence_id").orderBy("window").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(least, ["sequence_id", "window"], "left").select("sequence_id", "window", F.coalesce(fill, F.lit(0).cast("bigint")).alias("offset"))


def record_chunks(records: DataFrame) -> DataFrame:
    """Rows (file, sequence_id, bin, v_start, v_end, unsorted): chunks of records of one bin that follow each other in a file.

    records: file, sequence_id, pos, cigar, v_start and v_end (virtual offsets). Records whose
    blocks are the same or neighbours make one chunk. unsorted: a record of the chunk comes behind
    one of its file that has a greater sequence or position.
    """
    df = records.withColumn("bin", slice_bin(F.col("pos"), reference_span(F.col("cigar"))))
    place = F.shiftleft(F.col("sequence_id").cast("bigint"), 32) + F.col("pos")
    before = carried_forward(df.withColumn("_place", place), ["file"], "v_start", F.max("_place"), F.max("_place"), F.max("v"), 32)
    before = before.withColumn("bad", F.greatest("_within", "_carried") > F.col("_place")).drop("_within", "_carried", "_place")
    same = Window.partitionBy("file", "sequence_id", "bin").orderBy("v_start")
    apart = before.withColumn("new", F.when(F.shiftright(F.lag("v_end").over(same), 16) >= F.shiftright("v_start", 16), 0).otherwise(1))
    runs = apart.withColumn("run", F.sum("new").over(same.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file", "sequence_id", "bin", "run").agg(F.min("v_start").alias("v_start"), F.max("v_end").alias("v_end"), F.max("bad").alias("unsorted")).drop("run")


def linear_windows(records: DataFrame) -> DataFrame:
    """Rows (file, sequence_id, window, offset): the least virtual offset of the records that touch a 16 kb window, filled as in linear_index."""
    end = F.col("pos") + F.greatest(reference_span(F.col("cigar")), F.lit(1)) - 2
    touch = F.explode(F.sequence(F.shiftright(F.col("pos").cast("bigint") - 1, WINDOW_BITS), F.shiftright(end, WINDOW_BITS)))
    keys = ["file", "sequence_id"]
    least = records.select(*keys, "v_start", touch.alias("window")).groupBy(*keys, "window").agg(F.min("v_start").alias("offset"))
    every = least.groupBy(*keys).agg(F.max("window").alias("m")).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("window"))
    fill = F.last("offset", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("window").rowsBetween(Window.unboundedPreceding, 0))
    return every.join(least, [*keys, "window"], "left").select(*keys, "window", F.coalesce(fill, F.lit(0).cast("bigint")).alias("offset"))


def random_checks(index: DataFrame, records: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (region, n_slices, n_found, n_missed): what single positions, chosen at random by the caller, find through the index.

    index: as a slice index. records: sequence_id, pos, end. places: region, sequence_id, at.
    n_slices slices must be read for the n_found records that cover the position; n_missed of
    these start in no slice that was found, 0 if the index is right. Positions that no slice
    touches have 0 everywhere, unless records there were missed.
    """
    asked = places.select("region", "sequence_id", F.col("at").cast("bigint").alias("start"), F.col("at").cast("bigint").alias("end"))
    slices = find_slices(index, asked)
    # Each record is met by the positions in the windows that it covers.
    over = records.withColumn("w", F.explode(F.sequence(F.shiftright(F.col("pos").cast("bigint"), WINDOW_BITS), F.shiftright(F.greatest("end", "pos").cast("bigint"), WINDOW_BITS))))
    hit = asked.withColumn("w", F.shiftright("start", WINDOW_BITS)).withColumnRenamed("end", "_e").join(over, ["sequence_id", "w"]).filter("pos <= start and end >= start").select("region", "sequence_id", F.col("pos").cast("bigint").alias("p"))
    found = slices.groupBy("region").agg(F.count("*").alias("n_slices"), F.collect_list(F.struct(F.col("alignment_start").cast("bigint").alias("a"), F.expr("alignment_start + alignment_span - 1L").alias("b"))).alias("parts"))
    counted = hit.groupBy("region", "p").agg(F.count("*").alias("n")).join(found, "region", "left").withColumn("inside", F.coalesce(F.expr("exists(parts, x -> p between x.a and x.b)"), F.lit(False)))
    counted = counted.groupBy("region").agg(F.sum("n").alias("n_found"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("n_missed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return places.select("region").join(found.drop("parts"), "region", "left").join(counted, "region", "left").select("region", zero("n_slices"), zero("n_found"), zero("n_missed"))

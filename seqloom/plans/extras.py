"""Queries of the smaller operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import alignment as al
from seqloom.operators import compare, edits, index
from seqloom.plans.bases import ALIGNED, FEATURES_SQL, OPS, PLACED, placed
from seqloom.plans.records import MATED, SPANNED, _mated, reads, spanned
from seqloom.plans.sets import LATEST, PLAIN, _latest, _streams, _streams_sql
from seqloom.plans.shared import cut, table

LENGTH, WINDOW = 40, 1000


def trim_reads(spark, sf_dir):
    return edits.trimmed(al.placed(reads(spark, sf_dir)), LENGTH)


def features_reversed(spark, sf_dir):
    each = edits.reversed_features(al.features(placed(spark, sf_dir))).select("row_id", F.inline("features"))
    return each.select("row_id", "pos", "op")


def field_lengths(spark, sf_dir):
    return edits.limited_fields(reads(spark, sf_dir), "SEQ[10]:QUAL[5]:RNAME", ["row_id"])


def mate_flags(spark, sf_dir):
    """Whether the flag words of the members of a pair fit together."""
    df = reads(spark, sf_dir).select(F.col("row_id").alias("_id"), F.col("flag").alias("_flag"))
    pairs = _mated(spark, sf_dir).filter("mate_rn > rn").select("row_id", "mate_row_id", "flag")
    both = pairs.join(df, F.col("mate_row_id") == F.col("_id"))
    return both.select("row_id", "mate_row_id", edits.mate_flags_fit(F.col("flag"), F.col("_flag")).cast("int").alias("fit"))


MATE_FLAGS_SQL = f"""
SELECT a.row_id, mate_row_id, CAST(x & 1 > 0 AND y & 1 > 0 AND (x & 4 > 0) = (y & 8 > 0) AND (x & 16 > 0) = (y & 32 > 0) AND (y & 4 > 0) = (x & 8 > 0) AND (y & 16 > 0) = (x & 32 > 0) AND (x & 2) = (y & 2) AND NOT (x & y & 64 > 0) AND NOT (x & y & 128 > 0) AS INT) AS fit
FROM (SELECT m.row_id, mate_row_id, m.flag AS x, r.flag AS y FROM {MATED} m JOIN reads r ON r.row_id = mate_row_id WHERE mate_rn > rn) a
"""


def mate_flag_changes(spark, sf_dir):
    """Records whose mate bits differ between the two copies."""
    other = _latest(spark, sf_dir).select("row_id", F.col("flag").alias("other"))
    return reads(spark, sf_dir).join(other, "row_id").filter(edits.mate_flags_differ(F.col("flag"), F.col("other"))).agg(F.count("*").alias("n_rows"))


def mapq_frequencies(spark, sf_dir):
    return edits.frequency_class(reads(spark, sf_dir), "mapq")


def known_places(spark, sf_dir):
    """Aligned bases per record that lie on the starts of the index's slices, taken for a track of known places."""
    track = table(spark, sf_dir, "slice_index").join(table(spark, sf_dir, "contigs"), "sequence_id").select(F.col("name").alias("rname"), F.col("alignment_start").cast("bigint").alias("pos"))
    return edits.on_track(al.bases(placed(spark, sf_dir)), track).groupBy("row_id").agg(F.count("*").alias("n_bases"))


def flag_bits(spark, sf_dir):
    return reads(spark, sf_dir).select("row_id", F.bin("flag").alias("bits"), edits.high_bit(F.col("flag")).alias("high"))


def window_track(spark, sf_dir):
    """What a forward-only window of 1,000 bases would still hold, in the order of delivery."""
    df = reads(spark, sf_dir).filter("rname <> '*' and pos >= 1").select("row_id", "rname", "pos")
    return edits.forward_window(df, "row_id", WINDOW).select("row_id", "base", "in_window")


def index_check(spark, sf_dir):
    """Placed records that no slice of their contig overlaps, in an index that lacks every seventh slice."""
    ids = table(spark, sf_dir, "contigs").select(F.col("name").alias("rname"), "sequence_id")
    at = spanned(spark, sf_dir).filter("rname <> '*' and pos >= 1").select(F.col("row_id").alias("region"), "rname", F.col("pos").alias("start"), "end").join(ids, "rname").drop("rname")
    hit = index.find_slices(table(spark, sf_dir, "slice_index").filter("slice_size % 7 <> 0"), at).select("region").distinct()
    return at.join(hit, "region", "left_anti").select(F.col("region").alias("row_id"))


INDEX_CHECK_SQL = f"SELECT row_id FROM {SPANNED} r JOIN contigs c ON c.name = rname WHERE rname <> '*' AND pos >= 1 AND NOT EXISTS (SELECT 1 FROM slice_index i WHERE i.sequence_id = c.sequence_id AND slice_size % 7 <> 0 AND alignment_start <= r.\"end\" AND greatest(alignment_start + alignment_span - 1, alignment_start) >= r.pos)"


def diff_dump(spark, sf_dir):
    """The comparison as a written table of discrepancies: counter, field, tag, premature, values and names."""
    found = _streams(spark, sf_dir).withColumn("premature", (F.col("field") == compare.PREMATURE).cast("int")).withColumn("tag", F.lit(None).cast("string"))
    return cut(found.select("counter", "field", "tag", "premature", "value1", "value2"), "discrepancies")


QUERIES = {
    "trim_reads": trim_reads, "features_reversed": features_reversed, "field_lengths": field_lengths, "mate_flags": mate_flags, "mate_flag_changes": mate_flag_changes, "mapq_frequencies": mapq_frequencies, "known_places": known_places,
    "flag_bits": flag_bits, "window_track": window_track, "index_check": index_check, "diff_dump": diff_dump,
}
SQL = {
    "trim_reads": f"SELECT row_id, string_agg(CAST(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN least(len, {LENGTH} - rp + 1) ELSE len END AS VARCHAR) || op, '' ORDER BY k) AS cigar, any_value(seq)[1:{LENGTH}] AS seq FROM {OPS} WHERE rp <= {LENGTH} AND len > 0 GROUP BY row_id",
    "features_reversed": f"SELECT f.row_id, CAST(n - f.pos - 1 AS BIGINT) AS pos, op FROM ({FEATURES_SQL}) f JOIN {PLACED} p ON p.row_id = f.row_id",
    "field_lengths": "SELECT row_id, CASE WHEN length(seq) > 10 THEN seq[1:10] || '...' ELSE seq END AS seq, CASE WHEN length(qual) > 5 THEN qual[1:5] || '...' ELSE qual END AS qual, rname FROM reads",
    "mate_flags": MATE_FLAGS_SQL,
    "mate_flag_changes": f"SELECT count(*) AS n_rows FROM reads r JOIN {LATEST} c ON c.row_id = r.row_id WHERE r.flag & 40 <> c.flag & 40",
    "mapq_frequencies": "SELECT value, n, CAST(sum(n) OVER (ORDER BY value) AS BIGINT) AS cum_n, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT CAST(mapq AS BIGINT) AS value, count(*) AS n FROM reads WHERE mapq IS NOT NULL GROUP BY 1)",
    "known_places": f"SELECT row_id, count(*) AS n_bases FROM {ALIGNED} WHERE (rname, refpos) IN (SELECT (name, alignment_start) FROM slice_index JOIN contigs USING (sequence_id)) GROUP BY row_id",
    "flag_bits": "SELECT row_id, bin(flag) AS bits, CAST(CASE WHEN flag = 0 THEN -1 ELSE length(bin(flag)) - 1 END AS INT) AS high FROM reads",
    "window_track": f"SELECT row_id, base, CAST(base - pos < {WINDOW} AS INT) AS in_window FROM (SELECT row_id, pos, max(pos) OVER (PARTITION BY rname ORDER BY row_id) AS base FROM reads WHERE rname <> '*' AND pos >= 1)",
    "index_check": INDEX_CHECK_SQL,
    "diff_dump": f"SELECT counter, field, CAST(NULL AS VARCHAR) AS tag, CAST(field = 'PREMATURE' AS INT) AS premature, value1, value2 FROM ({_streams_sql(PLAIN)})",
}

"""Queries over sets of records: merging, headers and comparison; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import region
from seqloom.operators import compare, merge
from seqloom.plans.records import MATED, REGION, SPANNED, _mated, reads, spanned
from seqloom.plans.shared import table

FIELDS = ["qname", "flag", "rname", "pos", "tlen", "qual"]
TOLERANCE, DUPLICATE = 5, 0x400
# A table of sources: the read groups, in their order.
SOURCES = "(SELECT rg, CAST(row_number() OVER (ORDER BY rg) - 1 AS INT) AS source FROM read_groups)"
UNPLACED = "(rname IS NULL OR rname = '*' OR coalesce(pos, 0) <= 0)"


def _sources(spark, sf_dir) -> DataFrame:
    groups = table(spark, sf_dir, "read_groups").select("rg").distinct()
    return groups.withColumn("source", (F.row_number().over(Window.orderBy("rg")) - 1).cast("int"))


def _with_source(df, spark, sf_dir):
    return df.join(F.broadcast(_sources(spark, sf_dir)), "rg")


def merge_kway(spark, sf_dir):
    df = merge.merged_order(_with_source(reads(spark, sf_dir).select("row_id", "rname", "pos", "rg"), spark, sf_dir))
    return df.select("rname", "ord", "source", "row_id")


def _merged_sql(rows):
    return f"""SELECT r AS rname, row_number() OVER (PARTITION BY r ORDER BY p, source, row_id) AS ord, source, row_id
    FROM (SELECT CASE WHEN {UNPLACED} THEN '*' ELSE rname END AS r, CASE WHEN {UNPLACED} THEN 0 ELSE pos END AS p, source, row_id FROM {rows} JOIN {SOURCES} USING (rg))"""


def merge_region(spark, sf_dir):
    found = region.query(spanned(spark, sf_dir), REGION, "contained").select("row_id", "rname", "pos", "rg")
    return merge.merged_order(_with_source(found, spark, sf_dir)).select("rname", "ord", "source", "row_id")


def merge_names(spark, sf_dir):
    """Names under the id of their source."""
    ids = _sources(spark, sf_dir).select("source", F.col("rg").alias("id"))
    return merge.prefixed_names(_with_source(reads(spark, sf_dir).select("row_id", "qname", "rg"), spark, sf_dir), ids).select("row_id", "qname")


def merge_collisions(spark, sf_dir):
    """Ids of the files: their run, numbered where several files share it."""
    files = reads(spark, sf_dir).select(F.col("file_id").alias("source")).filter("source is not null").distinct()
    return merge.resolve_collisions(files.withColumn("id", F.substring_index("source", "_", 1))).withColumnRenamed("source", "file_id")


def merge_headers(spark, sf_dir):
    """Read groups of two headers: the table, and what the records' tags name; the first wins."""
    own = table(spark, sf_dir, "read_groups").select("rg", F.lit(0).alias("source"), "sample")
    tagged = reads(spark, sf_dir).select(F.regexp_extract(F.col("tags")["RG"], "^Z:(.*)$", 1).alias("rg")).filter("rg <> ''").distinct()
    extra = tagged.unionByName(tagged.select(F.concat("rg", F.lit("x")).alias("rg")))
    return merge.merge_headers(own.unionByName(extra.select("rg", F.lit(1).alias("source"), F.lit("tagged").alias("sample"))), "rg")


def merge_remap(spark, sf_dir):
    """Numbers of the record's and its mate's sequence in the merged header."""
    ids = table(spark, sf_dir, "contigs").select(F.col("name").alias("_n"), F.col("sequence_id").alias("_i"))
    mate = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    df = reads(spark, sf_dir).select("row_id", "rname", mate.alias("mate"))
    df = df.join(ids, F.col("rname") == F.col("_n"), "left").select("row_id", "mate", F.coalesce("_i", F.lit(-1)).alias("ref_id"))
    return df.join(ids, F.col("mate") == F.col("_n"), "left").select("row_id", "ref_id", F.coalesce("_i", F.lit(-1)).alias("mate_ref_id"))


def _latest(spark, sf_dir):
    copy = table(spark, sf_dir, "reads_copy")
    rows = copy.groupBy("row_id").agg(F.max_by(F.struct(*FIELDS), "copied_at").alias("x"))
    return rows.select("row_id", "x.*")


LATEST = "(SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY copied_at DESC) AS k FROM reads_copy) WHERE k = 1)"


def _streams(spark, sf_dir, fields=FIELDS, **kw):
    return compare.compare_streams(reads(spark, sf_dir), _latest(spark, sf_dir), "row_id", fields, **kw)


def _streams_sql(unequal):
    rules = " UNION ALL ".join(f"SELECT counter, '{f}' AS field, {_shown('a.' + f)} AS value1, {_shown('b.' + f)} AS value2 FROM j WHERE a.row_id IS NOT NULL AND b.row_id IS NOT NULL AND ({cond})" for f, cond in unequal.items())
    return f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY row_id) AS counter FROM reads), b AS (SELECT *, row_number() OVER (ORDER BY row_id) AS counter FROM {LATEST}),
    j AS (SELECT coalesce(a.counter, b.counter) AS counter, a, b FROM a FULL JOIN b ON a.counter = b.counter)
    {rules} UNION ALL SELECT counter, 'PREMATURE', '!NULL!', '!NULL!' FROM j WHERE a.row_id IS NULL OR b.row_id IS NULL"""


def _shown(e):
    return f"CASE WHEN {e} IS NULL THEN '!NULL!' WHEN length(CAST({e} AS VARCHAR)) > 40 THEN CAST({e} AS VARCHAR)[1:40] || '...' ELSE CAST({e} AS VARCHAR) END"


PLAIN = {f: f"a.{f} IS DISTINCT FROM b.{f}" for f in FIELDS}


def diff_records(spark, sf_dir):
    return _streams(spark, sf_dir)


def diff_tlen_tolerance(spark, sf_dir):
    return _streams(spark, sf_dir, ["tlen"], tolerance={"tlen": TOLERANCE})


def diff_ignore_flags(spark, sf_dir):
    return _streams(spark, sf_dir, ["flag"], masks={"flag": DUPLICATE})


def diff_summary(spark, sf_dir):
    return compare.summary(_streams(spark, sf_dir), FIELDS)


def diff_limited(spark, sf_dir, most: int = 20):
    """The first discrepancies of the report, by counter and field."""
    return _streams(spark, sf_dir).orderBy("counter", "field").limit(most)


def diff_tags(spark, sf_dir):
    """Tags in which the members of a pair differ, without RG."""
    tags = reads(spark, sf_dir).select(F.col("row_id").alias("_id"), "tags")
    pairs = _mated(spark, sf_dir).filter("mate_rn > rn").select("row_id", "mate_row_id")
    a = pairs.join(tags, F.col("row_id") == F.col("_id")).select("row_id", "mate_row_id", F.col("tags").alias("a"))
    both = a.join(tags, F.col("mate_row_id") == F.col("_id")).select("row_id", "mate_row_id", "a", F.col("tags").alias("b"))
    return both.select("row_id", "mate_row_id", F.explode(compare.compare_tags(F.col("a"), F.col("b"), ignored=["RG"])).alias("tag"))


DIFF_TAGS_SQL = f"""
WITH t AS (SELECT row_id, unnest(map_entries(tags)) AS e FROM reads WHERE tags IS NOT NULL),
p AS (SELECT row_id, mate_row_id FROM {MATED} WHERE mate_rn > rn),
k AS (SELECT DISTINCT p.row_id, mate_row_id, e.key AS tag FROM p JOIN t ON t.row_id IN (p.row_id, mate_row_id)),
a AS (SELECT k.*, (SELECT any_value(e.value) FROM t WHERE t.row_id = k.row_id AND e.key = tag) x, (SELECT any_value(e.value) FROM t WHERE t.row_id = k.mate_row_id AND e.key = tag) y FROM k)
SELECT row_id, mate_row_id, tag FROM a WHERE x IS DISTINCT FROM y AND tag <> 'RG'
"""


QUERIES = {
    "merge_kway": merge_kway, "merge_region": merge_region, "merge_names": merge_names, "merge_collisions": merge_collisions, "merge_headers": merge_headers, "merge_remap": merge_remap,
    "diff_records": diff_records, "diff_tlen_tolerance": diff_tlen_tolerance, "diff_ignore_flags": diff_ignore_flags, "diff_summary": diff_summary, "diff_limited": diff_limited, "diff_tags": diff_tags,
}
SQL = {
    "merge_kway": _merged_sql("reads"),
    "merge_region": _merged_sql(f"(SELECT * FROM {SPANNED} WHERE rname = '{REGION.name}' AND pos >= {REGION.start} AND \"end\" <= {REGION.end})"),
    "merge_names": "SELECT row_id, concat_ws('.', rg, qname) AS qname FROM reads",
    "merge_collisions": "SELECT file_id, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN id || row_number() OVER (PARTITION BY id ORDER BY file_id) ELSE id END AS id FROM (SELECT DISTINCT file_id, split_part(file_id, '_', 1) AS id FROM reads WHERE file_id IS NOT NULL)",
    "merge_headers": "WITH t AS (SELECT DISTINCT tags['RG'][3:] AS rg FROM reads WHERE tags['RG'] LIKE 'Z:_%'), e AS (SELECT rg, 0 AS source, sample FROM read_groups UNION ALL SELECT rg, 1, 'tagged' FROM t UNION ALL SELECT rg || 'x', 1, 'tagged' FROM t) SELECT rg, min(source) AS source, arg_min(sample, source) AS sample FROM e GROUP BY rg",
    "merge_remap": "SELECT row_id, coalesce(a.sequence_id, -1) AS ref_id, coalesce(b.sequence_id, -1) AS mate_ref_id FROM reads r LEFT JOIN contigs a ON a.name = r.rname LEFT JOIN contigs b ON b.name = CASE WHEN rnext = '=' THEN rname ELSE rnext END",
    "diff_records": _streams_sql(PLAIN),
    "diff_tlen_tolerance": _streams_sql({"tlen": f"NOT (coalesce(abs(CAST(a.tlen AS BIGINT) - b.tlen) <= {TOLERANCE}, false) OR (a.tlen IS NULL AND b.tlen IS NULL))"}),
    "diff_ignore_flags": _streams_sql({"flag": f"a.flag & ~{DUPLICATE} IS DISTINCT FROM b.flag & ~{DUPLICATE}"}),
    "diff_summary": f"SELECT field, count(*) AS n, CAST(coalesce(list_position({FIELDS}, field), {len(FIELDS) + 1}) AS INT) AS place FROM ({_streams_sql(PLAIN)}) GROUP BY field",
    "diff_limited": f"SELECT * FROM ({_streams_sql(PLAIN)}) ORDER BY counter, field LIMIT 20",
    "diff_tags": DIFF_TAGS_SQL,
}

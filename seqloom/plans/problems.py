"""Queries of the general data problems, p1, p2, p3 and p5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.cigar import is_cigar, reference_span
from seqloom.operators.differences import copy_differences
from seqloom.operators.hotkeys import heavy_keys, key_profile
from seqloom.operators.intervals import stretches_and_gaps
from seqloom.operators.orphans import orphan_references
from seqloom.plans.shared import table

MAX_GAP = 1000
HEAVY_PERCENT = 3


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copy_differences(table(spark, sf_dir, "reads"), table(spark, sf_dir, "reads_copy"), "row_id", ["qname", "flag", "qual", "tlen"], ("reads", "copy"), (None, "copied_at"))
    return found.select(F.col("key").alias("row_id"), "field")


P1_SQL = """
WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY copied_at DESC) rn FROM reads_copy) WHERE rn = 1),
j AS (SELECT r.row_id a, c.row_id b, r.qname q1, c.qname q2, r.flag f1, c.flag f2, r.qual u1, c.qual u2, r.tlen t1, c.tlen t2 FROM reads r FULL JOIN c ON r.row_id = c.row_id)
SELECT a AS row_id, 'missing_in_copy' AS field FROM j WHERE b IS NULL
UNION ALL SELECT b, 'missing_in_reads' FROM j WHERE a IS NULL
UNION ALL SELECT a, 'qname' FROM j WHERE a = b AND q1 IS DISTINCT FROM q2
UNION ALL SELECT a, 'flag' FROM j WHERE a = b AND f1 IS DISTINCT FROM f2
UNION ALL SELECT a, 'qual' FROM j WHERE a = b AND u1 IS DISTINCT FROM u2
UNION ALL SELECT a, 'tlen' FROM j WHERE a = b AND t1 IS DISTINCT FROM t2
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "reads").select("row_id", "qname", "flag", "rname", "pos", "rnext", "pnext", "load_day", F.col("loaded_at").alias("t"))
    n = table(spark, sf_dir, "reads").count()
    contig = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    refs = reads.filter("rnext is not null and rnext <> '*'").withColumn("name", contig).filter("name is not null and name <> '*'")
    contigs = table(spark, sf_dir, "contigs").filter("name is not null").select("name", F.col("added_at").alias("t"), F.col("withdrawn_at").alias("until"), F.lit(None).cast("bigint").alias("row_id"))
    to_contigs = orphan_references(refs.select("row_id", "load_day", "t", "name", F.lit(False).alias("own")), contigs, ["name"], n)
    pairs = refs.filter("(flag & 1) = 1 and qname is not null and pnext > 0").select("row_id", "load_day", "t", "qname", "name", F.col("pnext").alias("at"), ((F.col("rname") == F.col("name")) & (F.col("pos") == F.col("pnext"))).alias("own"))
    pairs = pairs.withColumn("own", F.coalesce("own", F.lit(False)))
    mates = reads.filter("qname is not null and rname is not null and rname <> '*' and pos > 0").select("row_id", "t", F.lit(None).cast("timestamp_ntz").alias("until"), "qname", F.col("rname").alias("name"), F.col("pos").alias("at"))
    to_mates = orphan_references(pairs, mates, ["qname", "name", "at"], 2 * n)
    cols = lambda target: [F.lit(target).alias("target"), F.col("load_day").cast("bigint").alias("load_day"), "row_id", "reason"]
    return to_contigs.select(*cols("contigs")).unionByName(to_mates.select(*cols("reads")))


P2_SQL = """
WITH r AS (SELECT *, CASE WHEN rnext = '=' THEN rname ELSE rnext END AS name FROM reads WHERE rnext IS NOT NULL AND rnext <> '*'),
refs AS (SELECT * FROM r WHERE name IS NOT NULL AND name <> '*'),
c AS (SELECT refs.row_id, refs.load_day, CASE WHEN k.name IS NULL THEN 'missing' WHEN k.withdrawn_at <= refs.loaded_at THEN 'withdrawn' WHEN k.added_at > refs.loaded_at THEN 'later' END AS reason
  FROM refs LEFT JOIN contigs k ON k.name = refs.name),
m AS (SELECT a.row_id, any_value(a.load_day) load_day, any_value(a.loaded_at) t, count(b.row_id) n, min(b.loaded_at) first
  FROM refs a LEFT JOIN reads b ON b.qname = a.qname AND b.rname = a.name AND b.pos = a.pnext AND b.row_id <> a.row_id
  WHERE (a.flag & 1) = 1 AND a.qname IS NOT NULL AND a.pnext > 0 GROUP BY a.row_id)
SELECT 'contigs' AS target, CAST(load_day AS BIGINT) AS load_day, row_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT 'reads', CAST(load_day AS BIGINT), row_id, CASE WHEN n = 0 THEN 'missing' ELSE 'later' END FROM m WHERE n = 0 OR first > t
"""


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per target table, load day and reason."""
    return p2_found(spark, sf_dir).groupBy("target", "load_day", "reason").agg(F.count("*").alias("n_rows"))


P2_REPORT_SQL = f"SELECT target, load_day, reason, count(*) AS n_rows FROM ({P2_SQL}) GROUP BY ALL"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(table(spark, sf_dir, "reads"), "rname", "mapq", HEAVY_PERCENT).filter("key is not null and key <> '*'").select(F.col("key").alias("rname"))


P3_SQL = f"SELECT rname FROM reads WHERE rname IS NOT NULL AND rname <> '*' GROUP BY rname HAVING count(*) * 100 >= {HEAVY_PERCENT} * (SELECT count(*) FROM reads)"


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, modes and percentiles of MAPQ, TLEN and POS per RNAME."""
    return key_profile(table(spark, sf_dir, "reads"), "rname", ["mapq", "tlen", "pos"]).drop("share").withColumnRenamed("key", "rname")


P3_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT rname, '{f}' AS field, count(*) AS n_rows, count(*) - count({f}) AS n_nulls, count(DISTINCT {f}) AS n_distinct,
(SELECT CAST(v AS BIGINT) FROM (SELECT {f} v, count(*) c FROM reads x WHERE x.rname IS NOT DISTINCT FROM o.rname AND {f} IS NOT NULL GROUP BY 1) ORDER BY c DESC, v LIMIT 1) AS mode,
(SELECT max(c) FROM (SELECT count(*) c FROM reads x WHERE x.rname IS NOT DISTINCT FROM o.rname AND {f} IS NOT NULL GROUP BY x.{f})) AS mode_n,
CAST(quantile_disc({f}, 0.5) AS BIGINT) AS p50, CAST(quantile_disc({f}, 0.9) AS BIGINT) AS p90, (SELECT count(*) FROM reads) AS all_rows FROM reads o GROUP BY rname"""
    for f in ("mapq", "tlen", "pos")
)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "reads").select("rname", F.col("pos").cast("bigint").alias("pos"), "cigar").filter("rname is not null and rname <> '*' and pos >= 1").filter(is_cigar(F.col("cigar")))
    placed = placed.select("rname", "pos", F.try_add(F.col("pos") - 1, reference_span(F.col("cigar"))).alias("end"))
    found = stretches_and_gaps(placed, "rname", "pos", "end")
    return found.filter(f"kind = 'covered' or end_pos - start_pos < {MAX_GAP}").select(F.col("entity").alias("rname"), "kind", "start_pos", "end_pos")


P5_SQL = f"""
WITH c AS (SELECT rname, CAST(pos AS BIGINT) s, pos - 1 + list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))) e
  FROM reads WHERE rname IS NOT NULL AND rname <> '*' AND pos >= 1 AND regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+')),
m AS (SELECT rname, s, e, max(e) OVER (PARTITION BY rname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) top FROM c WHERE e >= s),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rname ORDER BY s, e ROWS UNBOUNDED PRECEDING) grp FROM m),
t AS (SELECT rname, grp, min(s) s, max(e) e FROM g GROUP BY ALL),
l AS (SELECT rname, e + 1 AS s, lead(s) OVER (PARTITION BY rname ORDER BY s) - 1 AS e FROM t)
SELECT rname, 'covered' AS kind, CAST(s AS BIGINT) AS start_pos, CAST(e AS BIGINT) AS end_pos FROM t
UNION ALL SELECT rname, 'gap', CAST(s AS BIGINT), CAST(e AS BIGINT) FROM l WHERE e - s < {MAX_GAP}
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_profile": p3_profile, "p5_found": p5_found}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_report": P2_REPORT_SQL, "p3_found": P3_SQL, "p3_profile": P3_PROFILE_SQL, "p5_found": P5_SQL}

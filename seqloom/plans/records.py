"""Queries at record grain: flags, regions, selection, names, batches and mates; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import flags, region, selector, sequence
from seqloom.functions.cigar import is_cigar, reference_span
from seqloom.operators import pairing
from seqloom.plans.shared import table

BATCH = 500
REGION = region.Region.parse("lg1:20000-60000")
CORE = "row_id, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, rg"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reads")


def spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads with span (reference bases, 0 where the CIGAR is none) and end (last base)."""
    df = reads(spark, sf_dir).withColumn("span", F.when(is_cigar(F.col("cigar")), reference_span(F.col("cigar"))).otherwise(0)).withColumn("span", F.coalesce("span", F.lit(0)))
    return df.withColumn("end", region.last_base())


SPAN = "CASE WHEN regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') THEN coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), lambda x: CAST(x AS BIGINT))), 0) ELSE 0 END"
SPANNED = f"(SELECT *, CASE WHEN span > 0 THEN pos + span - 1 ELSE pos END AS \"end\" FROM (SELECT *, CAST({SPAN} AS BIGINT) AS span FROM reads))"
BATCHED = f"(SELECT *, (rn - 1) // {BATCH} AS batch FROM (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY pos, row_id) AS rn FROM (SELECT * REPLACE (coalesce(rname, '*') AS rname, CASE WHEN coalesce(rname, '*') = '*' THEN 0 ELSE coalesce(pos, 0) END AS pos) FROM reads)))"
PAIRED = f"(SELECT *, (row_number() OVER (PARTITION BY rname, batch, qname ORDER BY rn) - 1) // 2 AS pair FROM {BATCHED})"
IN_PAIR = "PARTITION BY rname, batch, qname, pair ORDER BY rn"
MATED = f"(SELECT *, CASE WHEN qname IS NOT NULL THEN coalesce(lead(row_id) OVER ({IN_PAIR}), lag(row_id) OVER ({IN_PAIR})) END AS mate_row_id, CASE WHEN qname IS NOT NULL THEN coalesce(lead(rn) OVER ({IN_PAIR}), lag(rn) OVER ({IN_PAIR})) END AS mate_rn FROM {PAIRED})"
TAGS = "array_to_string(list_sort(list_transform({}, lambda e: e.key || ':' || e.value)), chr(9))"


def scan_reads(spark, sf_dir):
    return reads(spark, sf_dir).select(*CORE.split(", "))


def flag_required_any(spark, sf_dir):
    return reads(spark, sf_dir).filter(flags.required(F.col("flag"), 0x42)).select("row_id", "flag")


def flag_filter_out(spark, sf_dir):
    return reads(spark, sf_dir).filter(flags.filtered(F.col("flag"), 0x904)).select("row_id", "flag")


def _region(kind, r=REGION):
    return lambda spark, sf_dir: region.query(spanned(spark, sf_dir), r, kind).select("row_id", "rname", "pos", "end")


def _region_sql(where):
    return f"SELECT row_id, rname, pos, \"end\" FROM {SPANNED} WHERE rname = '{REGION.name}' AND {where}"


def region_compat(spark, sf_dir):
    return region.compatible(reads(spark, sf_dir), REGION, ["pos", "row_id"]).select("row_id", "pos")


def unmapped_reads(spark, sf_dir):
    return reads(spark, sf_dir).filter("rname = '*'").select("row_id", "flag")


def count_only(spark, sf_dir):
    return reads(spark, sf_dir).filter(flags.required(F.col("flag"), 0x1) & flags.filtered(F.col("flag"), 0x4)).agg(F.count("*").alias("n_rows"))


def count_all(spark, sf_dir):
    return reads(spark, sf_dir).agg(F.count("*").alias("n_rows"))


def count_per_rname(spark, sf_dir):
    found = region.query(spanned(spark, sf_dir).filter(flags.filtered(F.col("flag"), 0x400)), REGION, "overlapping")
    return found.groupBy("rname").agg(F.count("*").alias("n_rows"))


def _select(spec):
    return lambda spark, sf_dir: selector.select(reads(spark, sf_dir), spec, ["row_id"])


def tsv_projection(spark, sf_dir):
    return selector.tsv(reads(spark, sf_dir), "QNAME:FLAG:POS:SEQ/*:NM", ["row_id"])


def enumerate_skip_limit(spark, sf_dir, skip: int = 100, limit: int = 50):
    """The counter includes the skipped rows. Only the first skip + limit rows are ever gathered."""
    from pyspark.sql import Window

    top = reads(spark, sf_dir).select("row_id", "qname").orderBy("row_id").limit(skip + limit)
    return top.withColumn("counter", F.row_number().over(Window.orderBy("row_id")).cast("bigint")).filter(F.col("counter") > skip)


def tag_capture_all(spark, sf_dir, ignored=("NM", "MD", "RG", "BC")):
    kept = F.map_filter("tags", lambda k, v: ~k.isin(*ignored))
    return reads(spark, sf_dir).filter("tags is not null").select("row_id", selector.tag_text(kept).alias("tags"))


def tag_capture_list(spark, sf_dir, captured=("AS", "XT", "NM")):
    """The list of ignored tags doesn't hold here: NM is captured if it is listed."""
    kept = F.map_filter("tags", lambda k, v: k.isin(*captured))
    return reads(spark, sf_dir).filter("tags is not null").select("row_id", selector.tag_text(kept).alias("tags"))


def contig_variants(spark, sf_dir):
    names = reads(spark, sf_dir).filter("rnext is not null and rnext not in ('*', '=')").select(F.col("rnext").alias("name"))
    names = names.unionByName(names.select(F.concat(F.lit("chr"), F.col("name")).alias("name"))).unionByName(spark.createDataFrame([("M",), ("MT",), ("chrM",), ("ChrX",)], "name string"))
    return sequence.resolve_names(names, table(spark, sf_dir, "contigs"))


CONTIG_SQL = """
WITH r AS (SELECT DISTINCT rnext n FROM reads WHERE rnext NOT IN ('*', '=')), n AS (SELECT n AS name FROM r UNION SELECT 'chr' || n FROM r UNION SELECT unnest(['M', 'MT', 'chrM', 'ChrX'])),
t AS (SELECT name, 0 k, name c FROM n UNION ALL SELECT name, 1, 'MT' FROM n WHERE name = 'M' UNION ALL SELECT name, 2, 'M' FROM n WHERE name = 'MT'
  UNION ALL SELECT name, 3, CASE WHEN lower(name[1:3]) = 'chr' THEN name[4:] ELSE 'chr' || name END FROM n UNION ALL SELECT name, 4, 'MT' FROM n WHERE name = 'chrM'),
b AS (SELECT t.name, arg_min(c, k) contig FROM t JOIN contigs ON contigs.name = c GROUP BY t.name)
SELECT n.name, contig FROM n LEFT JOIN b USING (name)
"""


def flag_unpack(spark, sf_dir):
    return reads(spark, sf_dir).select("row_id", *flags.unpack(F.col("flag")))


def flag_pack(spark, sf_dir):
    """The word put together from the record's own bits, without those of its mate."""
    own = reads(spark, sf_dir).select("row_id", *flags.unpack(F.col("flag")))
    return own.select("row_id", flags.pack(flags.OWN).alias("flag"))


def revcomp(spark, sf_dir):
    return reads(spark, sf_dir).filter("seq is not null and seq <> '*'").select("row_id", sequence.reverse_complement(F.col("seq")).alias("seq"))


def base_normalise(spark, sf_dir):
    return reads(spark, sf_dir).filter("seq is not null and seq <> '*'").select("row_id", sequence.normalise(F.col("seq")).alias("seq"), sequence.is_strict(F.col("seq")).cast("int").alias("strict"))


def _mated(spark, sf_dir):
    return pairing.batch_mates(pairing.batched(reads(spark, sf_dir).select("row_id", "qname", "flag", "rname", "pos", "cigar"), BATCH), ["row_id", "rn"])


def mate_pairs(spark, sf_dir):
    return _mated(spark, sf_dir).select("row_id", "mate_row_id", F.col("mate_row_id").isNull().cast("int").alias("detached"))


def next_fragment_distance(spark, sf_dir):
    df = _mated(spark, sf_dir)
    return df.select("row_id", pairing.to_next(df).alias("distance")).filter("distance is not null")


def mate_restore(spark, sf_dir):
    df = _mated(spark, sf_dir)
    return pairing.restore_mates(df.withColumn("distance", pairing.to_next(df)).select("row_id", "rname", "rn", "distance"))


def readname_regen(spark, sf_dir):
    """Detached records keep their names; the others get the smaller number of their pair."""
    df = _mated(spark, sf_dir)
    made = F.concat_ws(".", "rname", F.least("rn", "mate_rn").cast("string"))
    return df.select("row_id", F.when(F.col("mate_rn").isNull(), F.col("qname")).otherwise(made).alias("name"))


def insert_size(spark, sf_dir):
    """Of the pairs of a batch; ends are one beyond the last base, without skipped regions."""
    df = reads(spark, sf_dir).select("row_id", "qname", "flag", "rname", "pos", "cigar").filter(is_cigar(F.col("cigar")) & F.col("rname").isNotNull() & (F.col("rname") != "*") & (F.col("pos") > 0))
    width = F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MD=X]"), F.lit(1)), lambda x: x.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    df = pairing.batch_mates(pairing.batched(df.withColumn("stop", F.col("pos") + width), BATCH), ["row_id", "rn", "pos", "stop", "flag"])
    rev = lambda c: flags.has(F.col(c), "reverse")
    size = pairing.insert_size(F.col("pos"), F.col("stop"), rev("flag"), F.col("mate_pos"), F.col("mate_stop"), rev("mate_flag"))
    unmapped = flags.has(F.col("flag"), "unmapped") | flags.has(F.col("mate_flag"), "unmapped")
    return df.filter("mate_rn > rn").select("row_id", "mate_row_id", F.when(unmapped, 0).otherwise(size).cast("bigint").alias("insert_size"))


INSERT_SQL = f"""
WITH c AS (SELECT row_id, qname, flag, rname, pos, pos + coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MD=X]', 1), lambda x: CAST(x AS BIGINT))), 0) AS stop FROM reads
  WHERE regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') AND rname <> '*' AND pos > 0),
b AS (SELECT *, (rn - 1) // {BATCH} AS batch FROM (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY pos, row_id) AS rn FROM c)),
p AS (SELECT *, (row_number() OVER (PARTITION BY rname, batch, qname ORDER BY rn) - 1) // 2 AS pair FROM b WHERE qname IS NOT NULL),
m AS (SELECT a.row_id, b.row_id AS mate_row_id, a.flag | b.flag AS f, CASE WHEN a.flag & 16 > 0 THEN a.stop ELSE a.pos END x, CASE WHEN b.flag & 16 > 0 THEN b.stop ELSE b.pos END y FROM p a JOIN p b USING (rname, batch, qname, pair) WHERE a.rn < b.rn)
SELECT row_id, mate_row_id, CAST(CASE WHEN f & 4 > 0 THEN 0 ELSE y - x + CASE WHEN y >= x THEN 1 ELSE -1 END END AS BIGINT) AS insert_size FROM m
"""


def query_mate(spark, sf_dir):
    return pairing.query_mates(reads(spark, sf_dir))


QUERY_MATE_SQL = """
WITH e AS (SELECT row_id, qname, CASE WHEN flag & 192 = 64 THEN 1 ELSE 2 END k FROM reads WHERE flag & 1 = 1 AND qname IS NOT NULL AND flag & 192 IN (64, 128))
SELECT a.row_id, count(b.row_id) AS n_mates, CASE WHEN count(b.row_id) = 1 THEN min(b.row_id) END AS mate_row_id FROM e a LEFT JOIN e b ON a.qname = b.qname AND a.k <> b.k GROUP BY a.row_id
"""


def loose_mate_info(spark, sf_dir):
    return pairing.loose_mate_info(spanned(spark, sf_dir))


LOOSE_SQL = f"""
WITH p AS (SELECT * FROM {SPANNED} WHERE qname IS NOT NULL AND flag & 1 = 1 AND flag & 2304 = 0),
q AS (SELECT qname FROM p GROUP BY 1 HAVING count(*) = 2 AND count_if(flag & 64 > 0) = 1 AND count_if(flag & 128 > 0) = 1 AND count_if(flag & 192 = 192) = 0),
j AS (SELECT a.row_id ai, b.row_id bi, a.flag & 4 > 0 au, b.flag & 4 > 0 bu, a.flag & 16 > 0 ar, b.flag & 16 > 0 br, a.rname an, b.rname bn, a.pos ap, b.pos bp, a."end" ae, b."end" be, a.mapq am, b.mapq bm
  FROM q JOIN p a ON a.qname = q.qname AND a.flag & 64 > 0 JOIN p b ON b.qname = q.qname AND b.flag & 128 > 0),
k AS (SELECT *, CASE WHEN ar THEN ae ELSE ap END x, CASE WHEN br THEN be ELSE bp END y FROM j),
s AS (SELECT *, CASE WHEN au OR bu OR an IS DISTINCT FROM bn OR an IS NULL THEN 0 WHEN ap < bp THEN y - x + CASE WHEN y >= x THEN 1 ELSE -1 END ELSE -(x - y + CASE WHEN x >= y THEN 1 ELSE -1 END) END t FROM k)
SELECT ai AS row_id, CASE WHEN au AND bu THEN '*' ELSE bn END AS rnext, CASE WHEN au AND bu THEN 0 ELSE bp END AS pnext, CAST(br AS INT) AS mate_reverse, CAST(bu AS INT) AS mate_unmapped, CASE WHEN NOT au AND NOT bu THEN bm END AS mq, CAST(t AS BIGINT) AS tlen FROM s
UNION ALL SELECT bi, CASE WHEN au AND bu THEN '*' ELSE an END, CASE WHEN au AND bu THEN 0 ELSE ap END, CAST(ar AS INT), CAST(au AS INT), CASE WHEN NOT au AND NOT bu THEN am END, CAST(-t AS BIGINT) FROM s
"""


def batch_split(spark, sf_dir):
    df = pairing.batched(reads(spark, sf_dir).select("row_id", "rname", "pos"), BATCH)
    return df.groupBy("rname", "batch").agg(F.count("*").alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def delta_pos(spark, sf_dir):
    return pairing.position_deltas(pairing.batched(reads(spark, sf_dir).select("row_id", "rname", "pos"), BATCH)).select("row_id", "delta")


def delta_restore(spark, sf_dir):
    deltas = pairing.position_deltas(pairing.batched(reads(spark, sf_dir).select("row_id", "rname", "pos"), BATCH))
    return pairing.restore_positions(deltas.drop("pos")).select("row_id", "pos")


QUERIES = {
    "scan_reads": scan_reads, "flag_required_any": flag_required_any, "flag_filter_out": flag_filter_out, "region_contained": _region("contained"), "region_overlapping": _region("overlapping"),
    "region_starting_at": _region("starting_at", region.Region("lg1", 16608, -1)), "region_compat": region_compat, "unmapped_reads": unmapped_reads, "count_only": count_only, "count_all": count_all, "count_per_rname": count_per_rname,
    "select_star_but": _select("*:SEQ:QUAL/*:NM"), "select_fields_tags": _select("SEQ:RNAME:NM:AS"), "tsv_projection": tsv_projection, "enumerate_skip_limit": enumerate_skip_limit, "tag_capture_all": tag_capture_all,
    "tag_capture_list": tag_capture_list, "contig_variants": contig_variants, "flag_unpack": flag_unpack, "flag_pack": flag_pack, "revcomp": revcomp, "base_normalise": base_normalise, "mate_pairs": mate_pairs,
    "next_fragment_distance": next_fragment_distance, "mate_restore": mate_restore, "readname_regen": readname_regen, "insert_size": insert_size, "query_mate": query_mate, "loose_mate_info": loose_mate_info,
    "batch_split": batch_split, "delta_pos": delta_pos, "delta_restore": delta_restore,
}
_TAG = TAGS.format("list_filter(map_entries(tags), lambda e: {})")
SQL = {
    "scan_reads": f"SELECT {CORE} FROM reads",
    "flag_required_any": "SELECT row_id, flag FROM reads WHERE flag & 66 <> 0",
    "flag_filter_out": "SELECT row_id, flag FROM reads WHERE flag & 2308 = 0",
    "region_contained": _region_sql(f"pos >= {REGION.start} AND \"end\" <= {REGION.end}"),
    "region_overlapping": _region_sql(f"\"end\" >= {REGION.start} AND pos <= {REGION.end}"),
    "region_starting_at": _region_sql("pos = 16608"),
    "region_compat": f"SELECT row_id, pos FROM reads WHERE rname = 'lg1' AND pos BETWEEN {REGION.start} AND {REGION.end} UNION ALL (SELECT row_id, pos FROM reads WHERE rname = 'lg1' AND pos > {REGION.end} ORDER BY pos, row_id LIMIT 1)",
    "unmapped_reads": "SELECT row_id, flag FROM reads WHERE rname = '*'",
    "count_only": "SELECT count(*) AS n_rows FROM reads WHERE flag & 1 <> 0 AND flag & 4 = 0",
    "count_all": "SELECT count(*) AS n_rows FROM reads",
    "count_per_rname": f"SELECT rname, count(*) AS n_rows FROM {SPANNED} WHERE rname = 'lg1' AND flag & 1024 = 0 AND \"end\" >= {REGION.start} AND pos <= {REGION.end} GROUP BY rname",
    "select_star_but": f"SELECT row_id, qname, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, coalesce({_TAG.format('e.key <> $$NM$$')}, '') AS tags FROM reads",
    "select_fields_tags": f"SELECT row_id, rname, seq, coalesce({_TAG.format('e.key IN ($$NM$$, $$AS$$)')}, '') AS tags FROM reads",
    "tsv_projection": f"SELECT row_id, concat_ws(chr(9), coalesce(qname, '*'), flag, coalesce(CAST(pos AS VARCHAR), '*'), coalesce(seq, '*'), nullif(t, '')) AS line FROM (SELECT *, {_TAG.format('e.key <> $$NM$$')} AS t FROM reads)",
    "enumerate_skip_limit": "SELECT * FROM (SELECT row_id, qname, row_number() OVER (ORDER BY row_id) AS counter FROM reads) WHERE counter BETWEEN 101 AND 150",
    "tag_capture_all": f"SELECT row_id, {_TAG.format('e.key NOT IN ($$NM$$, $$MD$$, $$RG$$, $$BC$$)')} AS tags FROM reads WHERE tags IS NOT NULL",
    "tag_capture_list": f"SELECT row_id, {_TAG.format('e.key IN ($$AS$$, $$XT$$, $$NM$$)')} AS tags FROM reads WHERE tags IS NOT NULL",
    "contig_variants": CONTIG_SQL,
    "flag_unpack": "SELECT row_id, " + ", ".join(f"CAST(flag & {b} > 0 AS INT) AS {n}" for n, b in flags.BITS.items()) + " FROM reads",
    "flag_pack": f"SELECT row_id, flag & {sum(flags.BITS[n] for n in flags.OWN)} AS flag FROM reads",
    "revcomp": "SELECT row_id, reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS seq FROM reads WHERE seq <> '*'",
    "base_normalise": "SELECT row_id, regexp_replace(upper(seq), '[^ACGTN]', 'N', 'g') AS seq, CAST(NOT regexp_matches(upper(seq), '[^ACGTN]') AS INT) AS strict FROM reads WHERE seq <> '*'",
    "mate_pairs": f"SELECT row_id, mate_row_id, CAST(mate_row_id IS NULL AS INT) AS detached FROM {MATED}",
    "next_fragment_distance": f"SELECT row_id, mate_rn - rn - 1 AS distance FROM {MATED} WHERE mate_rn > rn",
    "mate_restore": f"SELECT row_id, mate_row_id FROM {MATED} WHERE mate_row_id IS NOT NULL",
    "readname_regen": f"SELECT row_id, CASE WHEN mate_rn IS NULL THEN qname ELSE rname || '.' || least(rn, mate_rn) END AS name FROM {MATED}",
    "insert_size": INSERT_SQL, "query_mate": QUERY_MATE_SQL, "loose_mate_info": LOOSE_SQL,
    "batch_split": f"SELECT rname, batch, count(*) AS n_rows, min(pos) AS first_pos, max(pos) AS last_pos FROM {BATCHED} GROUP BY ALL",
    "delta_pos": f"SELECT row_id, pos - coalesce(lag(pos) OVER (PARTITION BY rname, batch ORDER BY rn), pos) AS delta FROM {BATCHED}",
    "delta_restore": f"SELECT row_id, pos FROM {BATCHED}",
}

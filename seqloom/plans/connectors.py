"""Queries through the text formats and streams, written and read again, and SQL over views; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators.alignment import placed as placed_reads
from seqloom.plans.bases import COVERAGE_SQL, HEX, LETTERS, PLACED, REBUILD_SQL
from seqloom.plans.records import SPANNED, reads
from seqloom.plans.shared import scratch, spread, table
from seqloom.sources import binary, container, crai, fasta, fastq, sam
from seqloom.streaming import mates

TEXT = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


REGION = ("lg1", 20_000, 60_000)


def _tagged(spark, sf_dir):
    """reads with XI, the row_id, among their tags; names that no format holds are left out."""
    kept = F.coalesce(F.map_filter("tags", lambda k, v: k.rlike("^[A-Za-z][A-Za-z0-9]$") & (k != "XI") & v.isNotNull()), F.create_map().cast("map<string,string>"))
    return reads(spark, sf_dir).withColumn("tags", F.map_concat(kept, F.create_map(F.lit("XI"), F.concat(F.lit("i:"), "row_id"))))


def _back(df):
    """All fields of the records that came back, tags as one text."""
    rest = F.map_filter("tags", lambda k, v: k != "XI")
    text = F.array_join(F.array_sort(F.transform(F.map_entries(rest), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), " ")
    return df.select(F.expr("cast(substring(tags['XI'], 3) as bigint)").alias("row_id"), *TEXT, text.alias("tags"))


TAGS_SQL = "coalesce(array_to_string(list_sort(list_transform(list_filter(map_entries(tags), lambda e: e.value IS NOT NULL AND e.key <> 'XI' AND regexp_full_match(e.key, '[A-Za-z][A-Za-z0-9]')), lambda e: e.key || ':' || e.value)), ' '), '') AS tags"
_KNOWN = "coalesce(rname IN (SELECT name FROM contigs), false)"
RNEXT_SQL = f"CASE WHEN rnext = '=' THEN CASE WHEN {_KNOWN} THEN '=' ELSE '*' END WHEN rnext = rname AND {_KNOWN} THEN '=' WHEN rnext IN (SELECT name FROM contigs) THEN rnext ELSE '*' END AS rnext"


def sam_roundtrip(spark, sf_dir):
    """All records through SAM text; nulls come back as sentinels."""
    path = scratch(spark, "sam")
    sam.write_sam(_tagged(spark, sf_dir), path)
    return _back(sam.read_sam(spark, path))


def sam_file(spark, sf_dir):
    """Kinds of lines of SAM files that begin with their header, and their number."""
    path = scratch(spark, "sam")
    header = sam.header_lines(table(spark, sf_dir, "contigs"), table(spark, sf_dir, "read_groups"))
    sam.write_sam(_tagged(spark, sf_dir), path, header=header)
    lines = spark.read.text(path)
    kind = F.when(F.col("value").startswith("@"), F.substring("value", 1, 3)).otherwise("record")
    files = len(binary.files_below(path))
    return lines.groupBy(kind.alias("kind")).agg(F.count_distinct("value").alias("n_distinct"), F.count("*").alias("_n")).select("kind", "n_distinct", (F.col("_n") / F.when(F.col("kind") == "record", 1).otherwise(files)).cast("bigint").alias("n_each"))


def bam_roundtrip(spark, sf_dir):
    """All records through the binary format. What it can't hold comes back as sentinels."""
    path = scratch(spark, "bam")
    binary.write_bam(spread(_tagged(spark, sf_dir)), table(spark, sf_dir, "contigs"), path)
    binary.register(spark)
    return _back(spark.read.format("seqloom_bam").option("split", 200_000).load(path))


def bam_region(spark, sf_dir):
    """Records of a region, read through the index files of sorted files."""
    path, contigs = scratch(spark, "bam"), table(spark, sf_dir, "contigs")
    binary.write_bam(binary.sorted_for_index(_tagged(spark, sf_dir), contigs), contigs, path)
    binary.index_bam(spark, path)
    found = spark.read.format("seqloom_bam").option("region", "{}:{}-{}".format(*REGION)).load(path)
    return _back(found).select("row_id", "pos", "cigar")


def _written_cram(spark, sf_dir, df=None, most=None):
    df = _tagged(spark, sf_dir) if df is None else df
    ends = placed_reads(df).groupBy("rname").agg(F.max(F.col("pos") + F.col("span")).alias("e"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.expr("(e - 1) div 32")), lambda k: F.translate(F.md5(F.concat("rname", F.lit("|"), k.cast("string"))), HEX, LETTERS)), "")
    at = scratch(spark, "reference")
    fasta.write_fasta(ends.select("rname", text.alias("seq")).coalesce(1), at)
    (file,) = binary.files_below(at)
    path = scratch(spark, "cram")
    container.write_cram(df, table(spark, sf_dir, "contigs"), file, path, groups=table(spark, sf_dir, "read_groups"), most=most)
    binary.register(spark)
    return spark.read.format("seqloom_cram").option("reference", file), path


def cram_roundtrip(spark, sf_dir):
    """All records with all their fields and tags through reference-compressed containers."""
    reader, path = _written_cram(spark, sf_dir)
    return _back(reader.load(path))


def cram_region(spark, sf_dir):
    """Records of a region: only containers that the index beside a file names are read."""
    reader, path = _written_cram(spark, sf_dir)
    return _back(reader.option("region", "{}:{}-{}".format(*REGION)).load(path)).select("row_id", "pos", "mapq")


def fasta_roundtrip(spark, sf_dir):
    """Distinct names and bases of the first delivery of each record of an end, as FASTA."""
    df = reads(spark, sf_dir).filter("seq is not null and seq <> '*'").select(F.col("row_id").cast("string").alias("rname"), "seq")
    path = scratch(spark, "fasta")
    fasta.write_fasta(df, path, 50)
    return fasta.read_fasta(spark, path).select(F.col("rname").cast("bigint").alias("row_id"), "seq")


def fasta_lines(spark, sf_dir):
    df = reads(spark, sf_dir).filter("seq is not null and seq <> '*'").select(F.col("row_id").cast("string").alias("rname"), "seq")
    return fasta.fasta_lines(df, 40).select(F.col("rname").cast("bigint").alias("row_id"), "line_no", "value")


def fasta_subrange(spark, sf_dir):
    """Bases 11 to 31 of each sequence: the asked length of 20 and one more."""
    df = reads(spark, sf_dir).filter("seq is not null and seq <> '*'")
    return fasta.sub_ranges(df, "seq", 11, 20).select("row_id", "seq")


def fai_offsets(spark, sf_dir):
    """Bytes of bases 100 to 200 of each contig."""
    df = table(spark, sf_dir, "contigs").withColumns({"s": F.lit(100), "e": F.lit(200)})
    return fasta.byte_range(df, "s", "e").select("name", "first_byte", "last_byte")


def fastq_roundtrip(spark, sf_dir):
    path = scratch(spark, "fastq")
    df = reads(spark, sf_dir).filter("seq <> '*' and qual <> '*' and qual <> ''").withColumn("qname", F.col("row_id").cast("string"))
    fastq.write_fastq(df, path)
    return fastq.read_fastq(spark, path).select(F.col("qname").cast("bigint").alias("row_id"), "seq", "qual")


def crai_roundtrip(spark, sf_dir):
    path = scratch(spark, "crai")
    crai.write_crai(table(spark, sf_dir, "slice_index"), path)
    return crai.read_crai(spark, path)


def header_lines(spark, sf_dir):
    return sam.header_lines(table(spark, sf_dir, "contigs"), table(spark, sf_dir, "read_groups")).select("part", "place", "value")


def sql_view(spark, sf_dir):
    """SQL over the records, the sequences and the read groups as views."""
    for name in ("reads", "contigs", "read_groups"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"v_{name}")
    return spark.sql("SELECT g.sample, c.sequence_id, count(*) AS n_rows, count(DISTINCT r.qname) AS n_names FROM v_reads r JOIN v_contigs c ON c.name = r.rname JOIN v_read_groups g ON g.rg = r.rg WHERE r.mapq >= 20 GROUP BY g.sample, c.sequence_id")


def _stream(spark, sf_dir, batches=3):
    """The records as a stream of at least three micro-batches, in the order of row_id."""
    df, path = reads(spark, sf_dir), scratch(spark, "stream")
    low, high = df.agg(F.min("row_id"), F.max("row_id")).first()
    files = max(1, df.rdd.getNumPartitions() // batches)
    edges = [low + (high - low + 1) * i // batches for i in range(batches + 1)]
    for a, b in zip(edges, edges[1:]):
        df.filter((F.col("row_id") >= a) & (F.col("row_id") < b)).repartition(files, "row_id").write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_pileup(spark, sf_dir):
    """Coverage of all records, added up over the micro-batches of a stream."""
    path = scratch(spark, "pileup")
    mates.stream_pileup(_stream(spark, sf_dir), path, path + "-checkpoint").awaitTermination()
    return mates.read_pileup(spark, path)


def stream_mates(spark, sf_dir):
    """Mates by name in the order of row_id, through a stateful stream; those still waiting are no rows."""
    path = scratch(spark, "mates")
    out = mates.stream_mates(_stream(spark, sf_dir))
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(mates.PAIRS).parquet(path)


def stream_counts(spark, sf_dir):
    """Records per rname and day of loading, late ones within the watermark included."""
    path = scratch(spark, "counts")
    out = mates.stream_counts(_stream(spark, sf_dir).filter("rname is not null"), late="3650 days")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema("start timestamp, rname string, n_rows bigint, batch int").parquet(path).groupBy("start", "rname").agg(F.max_by("n_rows", "batch").alias("n_rows"))
    return last.select(F.date_format("start", "yyyyMMdd").cast("bigint").alias("day"), "rname", "n_rows")


def fixture_counts(spark, sf_dir):
    """The same filters over records made from lineitem: per rname, with region and flags."""
    q, h = F.col("q"), F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").alias("q"), h.alias("h"))
    flag = F.when(q == 50, 4).otherwise(0) + F.when(F.col("l_returnflag") == "R", 16).otherwise(0) + F.when(q == 13, 256).otherwise(0)
    made = df.select(flag.alias("flag"), F.when(q == 50, "*").otherwise(F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("string"))).alias("rname"), F.when(q == 50, 0).otherwise(1 + (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 5000).alias("pos"))
    return made.filter("flag & 256 = 0 and pos between 1000 and 3000").groupBy("rname").agg(F.count("*").alias("n_rows"), F.sum("pos").alias("sum_pos"))


QUERIES = {
    "sam_roundtrip": sam_roundtrip, "sam_file": sam_file, "bam_roundtrip": bam_roundtrip, "bam_region": bam_region, "cram_roundtrip": cram_roundtrip, "cram_region": cram_region, "fasta_roundtrip": fasta_roundtrip, "fasta_lines": fasta_lines, "fasta_subrange": fasta_subrange, "fai_offsets": fai_offsets, "fastq_roundtrip": fastq_roundtrip, "crai_roundtrip": crai_roundtrip,
    "header_lines": header_lines, "sql_view": sql_view, "stream_pileup": stream_pileup, "stream_mates": stream_mates, "stream_counts": stream_counts, "fixture_counts": fixture_counts,
}
SQL = {
    "sam_roundtrip": f"SELECT row_id, coalesce(qname, '*') AS qname, flag, coalesce(rname, '*') AS rname, coalesce(pos, 0) AS pos, coalesce(mapq, 0) AS mapq, coalesce(cigar, '*') AS cigar, coalesce(rnext, '*') AS rnext, coalesce(pnext, 0) AS pnext, coalesce(tlen, 0) AS tlen, coalesce(seq, '*') AS seq, coalesce(qual, '*') AS qual, {TAGS_SQL} FROM reads",
    "sam_file": "SELECT '@HD' AS kind, CAST(1 AS BIGINT) AS n_distinct, CAST(1 AS BIGINT) AS n_each UNION ALL SELECT '@SQ', count(*), count(*) FROM contigs UNION ALL SELECT '@RG', count(*), count(*) FROM read_groups UNION ALL SELECT 'record', count(*), count(*) FROM reads",
    "bam_roundtrip": f"""SELECT row_id, coalesce(qname, '*') AS qname, flag, CASE WHEN {_KNOWN} THEN rname ELSE '*' END AS rname, coalesce(pos, 0) AS pos, CASE WHEN mapq BETWEEN 0 AND 255 THEN mapq ELSE 255 END AS mapq, {RNEXT_SQL}, coalesce(pnext, 0) AS pnext, coalesce(tlen, 0) AS tlen, CASE WHEN regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') THEN cigar ELSE '*' END AS cigar,
      CASE WHEN coalesce(seq, '') IN ('', '*') THEN '*' ELSE regexp_replace(upper(seq), '[^=ACGMRSVTWYHKDBN]', 'N', 'g') END AS seq, CASE WHEN coalesce(seq, '*') <> '*' AND qual <> '*' AND qual <> '' AND length(qual) = length(seq) THEN regexp_replace(qual, '[\\x00-\\x20]', '!', 'g') ELSE '*' END AS qual, {TAGS_SQL} FROM reads""",
    "bam_region": f"SELECT row_id, pos, CASE WHEN regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') THEN cigar ELSE '*' END AS cigar FROM {SPANNED} WHERE rname = 'lg1' AND pos BETWEEN 1 AND 60000 AND \"end\" >= 20000",
    "cram_roundtrip": f"""SELECT row_id, coalesce(qname, '*') AS qname, CASE WHEN m THEN flag ELSE flag | 4 END AS flag, CASE WHEN k THEN rname ELSE '*' END AS rname, CASE WHEN k THEN coalesce(pos, 0) ELSE 0 END AS pos, {RNEXT_SQL}, coalesce(pnext, 0) AS pnext, coalesce(tlen, 0) AS tlen,
      CASE WHEN NOT m THEN 0 WHEN coalesce(mapq, 0) BETWEEN 0 AND 255 THEN coalesce(mapq, 0) ELSE 255 END AS mapq, CASE WHEN m THEN c ELSE '*' END AS cigar, CASE WHEN coalesce(seq, '') IN ('', '*') THEN '*' ELSE upper(seq) END AS seq,
      CASE WHEN coalesce(seq, '') IN ('', '*') OR coalesce(qual, '*') = '*' OR length(qual) <> length(seq) THEN '*' ELSE regexp_replace(regexp_replace(qual, '[\\x00-\\x20]', '!', 'g'), '[^!-~]', '~', 'g') END AS qual, {TAGS_SQL}
      FROM (SELECT r.*, b.cigar AS c, {_KNOWN} AS k, b.row_id IS NOT NULL AND flag & 4 = 0 AND {_KNOWN} AS m FROM reads r LEFT JOIN ({REBUILD_SQL}) b ON b.row_id = r.row_id)""",
    "cram_region": f"""SELECT row_id, pos, CAST(CASE WHEN coalesce(mapq, 0) BETWEEN 0 AND 255 THEN coalesce(mapq, 0) ELSE 255 END AS INT) AS mapq FROM {SPANNED} r WHERE rname = 'lg1' AND pos BETWEEN 1 AND 60000 AND CASE WHEN flag & 4 = 0 AND row_id IN (SELECT row_id FROM {PLACED}) THEN "end" ELSE pos END >= 20000 AND flag & 4 = 0 AND row_id IN (SELECT row_id FROM {PLACED})
      UNION ALL SELECT row_id, pos, 0 FROM reads WHERE rname = 'lg1' AND pos BETWEEN 20000 AND 60000 AND NOT (flag & 4 = 0 AND row_id IN (SELECT row_id FROM {PLACED}))""",
    "fasta_roundtrip": "SELECT row_id, seq FROM reads WHERE seq IS NOT NULL AND seq <> '*'",
    "fasta_lines": "SELECT row_id, CAST(i AS INT) AS line_no, CASE WHEN i = 0 THEN '>' || row_id ELSE substr(seq, CAST((i - 1) * 40 + 1 AS INT), 40) END AS value FROM (SELECT row_id, seq, unnest(range(0, CAST(ceil(length(seq) / 40.0) AS INT) + 1)) AS i FROM reads WHERE seq IS NOT NULL AND seq <> '*')",
    "fasta_subrange": "SELECT row_id, substr(seq, 11, 21) AS seq FROM reads WHERE seq IS NOT NULL AND seq <> '*'",
    "fai_offsets": "SELECT name, byte_offset + (99 // line_bases) * line_width + 99 % line_bases AS first_byte, byte_offset + (199 // line_bases) * line_width + 199 % line_bases AS last_byte FROM contigs",
    "fastq_roundtrip": "SELECT row_id, seq, qual FROM reads WHERE seq <> '*' AND qual <> '*' AND qual <> '' AND flag & 2304 = 0",
    "crai_roundtrip": "SELECT sequence_id, alignment_start, alignment_span, container_start_offset, slice_offset, slice_size FROM slice_index",
    "header_lines": "SELECT 0 AS part, CAST(0 AS BIGINT) AS place, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' AS value UNION ALL SELECT 1, sequence_id, concat_ws(chr(9), '@SQ', 'SN:' || name, 'LN:' || length) FROM contigs UNION ALL SELECT 2, row_number() OVER (ORDER BY rg), concat_ws(chr(9), '@RG', 'ID:' || rg, 'SM:' || sample, 'LB:' || library, 'PL:' || platform) FROM read_groups",
    "sql_view": "SELECT g.sample, c.sequence_id, count(*) AS n_rows, count(DISTINCT r.qname) AS n_names FROM reads r JOIN contigs c ON c.name = r.rname JOIN read_groups g ON g.rg = r.rg WHERE r.mapq >= 20 GROUP BY g.sample, c.sequence_id",
    "stream_mates": "SELECT qname, row_id, mate_row_id FROM (SELECT qname, row_id, lead(row_id) OVER w AS mate_row_id, row_number() OVER w AS k FROM reads WHERE qname IS NOT NULL WINDOW w AS (PARTITION BY qname ORDER BY row_id)) WHERE k % 2 = 1 AND mate_row_id IS NOT NULL",
    "fixture_counts": "SELECT rname, count(*) AS n_rows, CAST(sum(pos) AS BIGINT) AS sum_pos FROM (SELECT CASE WHEN l_quantity = 50 THEN 4 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END + CASE WHEN l_quantity = 13 THEN 256 ELSE 0 END AS flag, CASE WHEN l_quantity = 50 THEN '*' ELSE 'chr' || (l_suppkey % 5 + 1) END AS rname, CASE WHEN l_quantity = 50 THEN 0 ELSE 1 + (l_partkey * 37 + l_linenumber * 11) % 5000 END AS pos FROM lineitem) WHERE flag & 256 = 0 AND pos BETWEEN 1000 AND 3000 GROUP BY rname",
    "stream_pileup": COVERAGE_SQL, "stream_counts": "SELECT CAST(strftime(loaded_at, '%Y%m%d') AS BIGINT) AS day, rname, count(*) AS n_rows FROM reads WHERE rname IS NOT NULL GROUP BY 1, 2",
}

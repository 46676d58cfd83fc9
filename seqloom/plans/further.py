"""Queries of headers, formats, lossy storage and smaller checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import quality
from seqloom.operators import alignment as al
from seqloom.operators import compare, index, merge, storage, validate
from seqloom.plans.bases import FEATURES_SQL, HEX, LETTERS, MEANING, PLACED, _policy_sql, placed, scored
from seqloom.plans.connectors import _back, _tagged, _written_cram
from seqloom.plans.records import SPANNED, reads, spanned
from seqloom.plans.sets import FIELDS, LATEST, PLAIN, UNPLACED, _latest, _shown, _with_source
from seqloom.plans.shared import cut, scratch, spread, table
from seqloom.plans.stored import RULES, VALIDATE_SQL
from seqloom.sources import binary, cipher, container, detect, fasta, files, masks, sam

SPEC = "N40-D8"


def _ruled(spark, sf_dir):
    rules = quality.parse_policies(SPEC)
    return quality.apply_policies(scored(spark, sf_dir, quality.needs_tracks(rules)), rules)


def policy_features(spark, sf_dir):
    """Read features of placed records and, after those of the same place, the scores that the rules N40-D8 keep."""
    own = al.features(placed(spark, sf_dir)).select("row_id", F.posexplode("features").alias("i", "f")).select("row_id", "f.*", F.lit(0).alias("z"), "i")
    kept = quality.kept_as_features(_ruled(spark, sf_dir)).withColumns({"z": F.lit(1), "i": F.lit(0)})
    each = F.array_sort(F.collect_list(F.struct("pos", "z", "i", "op", "text")))
    return own.drop("len").unionByName(kept.drop("len")).groupBy("row_id").agg(F.array_join(F.transform(each, lambda x: F.concat(x["pos"].cast("string"), x["op"], x["text"])), " ").alias("features"))


_BARE = _policy_sql("policy_N40_D8").replace("SELECT row_id, CAST(bool_or(f) AS INT)", "SELECT row_id, list(s ORDER BY j) AS kept, CAST(bool_or(f) AS INT)")
POLICY_FEATURES_SQL = f"""
WITH p AS ({_BARE}), q AS (SELECT row_id, unnest(kept) AS s, generate_subscripts(kept, 1) AS pos FROM p WHERE forced = 0),
f AS (SELECT row_id, pos, CASE WHEN op IN ('X', 'B', 'i', 'S') THEN 1 ELSE 0 END AS i, 0 AS z, op, text FROM ({FEATURES_SQL}) UNION ALL SELECT row_id, pos, 0, 1, 'Q', CAST(s AS VARCHAR) FROM q WHERE s >= 0)
SELECT row_id, string_agg(CAST(pos AS VARCHAR) || op || text, ' ' ORDER BY pos, z, i) AS features FROM f GROUP BY row_id
"""


def cram_lossy(spark, sf_dir):
    """Scores under the rules N40-D8, through containers that store only what the rules keep."""
    ruled = _ruled(spark, sf_dir).select("row_id", "scores", "forced", quality.as_text(F.col("restored")).alias("_qual"))
    df = _tagged(spark, sf_dir).join(ruled, "row_id", "left").withColumn("qual", F.coalesce("_qual", F.lit("*"))).withColumn("forced", F.coalesce("forced", F.lit(False))).drop("_qual")
    reader, path = _written_cram(spark, sf_dir, df)
    return _back(reader.load(path)).select("row_id", "qual")


CRAM_LOSSY_SQL = f"""
WITH p AS ({_policy_sql("policy_N40_D8")})
SELECT r.row_id, CASE WHEN p.row_id IS NULL THEN '*' WHEN forced = 1 THEN p.qual WHEN n_kept > 0 AND r.flag & 4 = 0 AND r.row_id IN (SELECT row_id FROM {PLACED}) THEN p.qual ELSE '*' END AS qual FROM reads r LEFT JOIN p ON p.row_id = r.row_id
"""


def cram_limited(spark, sf_dir):
    """How many records of the first 1,000 that are written come back."""
    reader, path = _written_cram(spark, sf_dir, most=1000)
    return reader.load(path).agg(F.count("*").alias("n_rows"))


def cram_heads(spark, sf_dir):
    """What the headers of containers say, by sequence: records, bases and the range of records counted through all files."""
    _, path = _written_cram(spark, sf_dir)
    heads = [(p, h.sequence, h.records, h.bases, h.counter) for p in files.files_below(path, ".cram") for h in container.container_heads(p) if h.records]
    df = spark.createDataFrame(heads, "path string, sequence int, records bigint, bases bigint, counter bigint")
    return df.groupBy("sequence").agg(F.sum("records").alias("n_rows"), F.sum("bases").alias("n_bases"), F.min("counter").alias("first"), F.max(F.col("counter") + F.col("records")).alias("last"))


CRAM_HEADS_SQL = """
WITH s AS (SELECT coalesce(sequence_id, -1) AS sequence, count(*) AS n_rows, CAST(sum(CASE WHEN coalesce(seq, '*') = '*' THEN 0 ELSE length(seq) END) AS BIGINT) AS n_bases FROM reads LEFT JOIN contigs ON name = rname GROUP BY 1)
SELECT CAST(sequence AS INT) AS sequence, n_rows, n_bases, CAST(sum(n_rows) OVER w - n_rows AS BIGINT) AS first, CAST(sum(n_rows) OVER w AS BIGINT) AS last FROM s WINDOW w AS (ORDER BY CASE WHEN sequence < 0 THEN 2147483647 ELSE sequence END ROWS UNBOUNDED PRECEDING)
"""


def format_kinds(spark, sf_dir):
    """What the files of each writer, written and read by all tasks, are taken for by their first bytes, and how many records each kind gives back."""
    df, contigs, out = spread(_tagged(spark, sf_dir)), table(spark, sf_dir, "contigs"), None
    plain, packed, small = (scratch(spark, x) for x in ("sam", "bam", "sam"))
    sam.write_sam(df, plain)
    sam.write_sam(df, small, gzip=True)
    binary.write_bam(df, contigs, packed)
    for path in (plain, small, packed):
        one = detect.read_reads(spark, path).agg(F.count("*").alias("n_rows")).select(F.lit(detect.kind_below(path)).alias("kind"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def validate_severities(spark, sf_dir):
    """Errors per severity and type over all rules of records."""
    out = None
    for rule in RULES:
        out = rule(spark, sf_dir) if out is None else out.unionByName(rule(spark, sf_dir))
    return validate.with_severity(out).groupBy("severity", "type").agg(F.count("*").alias("n"))


def _lines(spark, sf_dir):
    """Header lines of three sources: all sequences, read groups and a program; a part of them with other text; comments."""
    contigs, groups = table(spark, sf_dir, "contigs"), table(spark, sf_dir, "read_groups")
    line = lambda df, source, kind, id, place, rest: df.select(F.lit(source).alias("source"), F.concat(F.lit("s"), F.lit(source).cast("string")).alias("name"), F.lit(kind).alias("kind"), id.alias("id"), place.cast("bigint").alias("place"), F.concat_ws("\t", F.lit(f"@{kind}"), *rest).alias("value"))
    named = lambda key, c: F.concat(F.lit(f"{key}:"), c.cast("string"))
    one, c, g = spark.range(1), F.col("name"), F.col("rg")
    at = F.substring("rg", 3, 9).cast("bigint")
    out = line(contigs, 0, "SQ", c, F.col("sequence_id"), [named("SN", c), named("LN", F.col("length"))])
    more = [
        line(contigs.filter("sequence_id > 100"), 1, "SQ", c, F.col("sequence_id"), [named("SN", c), F.lit("LN:1")]), line(contigs, 2, "SQ", F.concat(c, F.lit("_b")), F.col("sequence_id"), [named("SN", F.concat(c, F.lit("_b"))), F.lit("LN:2")]),
        line(groups, 1, "RG", g, at, [named("ID", g), named("SM", F.col("sample"))]), line(groups, 2, "RG", g, at, [named("ID", g), F.lit("SM:later")]),
        *[line(one, s, "PG", F.lit(i), F.lit(p), [F.lit(f"ID:{i}"), F.lit(f"VN:{s}")]) for s, i, p in ((0, "align", 1), (1, "align", 1), (1, "sort", 2))],
        *[line(one, s, "CO", F.lit(None).cast("string"), F.lit(p), [F.lit(t)]) for s, p, t in ((0, 1, "first"), (2, 1, "third"), (2, 2, "third"))],
    ]
    for x in more:
        out = out.unionByName(x)
    return out


def merge_header_lines(spark, sf_dir):
    return merge.merge_header_lines(_lines(spark, sf_dir))


MERGE_LINES_SQL = r"""
WITH l AS (
  SELECT 0 AS source, 'SQ' AS kind, name AS id, sequence_id AS place, concat_ws(chr(9), '@SQ', 'SN:' || name, 'LN:' || length) AS value FROM contigs
  UNION ALL SELECT 1, 'SQ', name, sequence_id, concat_ws(chr(9), '@SQ', 'SN:' || name, 'LN:1') FROM contigs WHERE sequence_id > 100 UNION ALL SELECT 2, 'SQ', name || '_b', sequence_id, concat_ws(chr(9), '@SQ', 'SN:' || name || '_b', 'LN:2') FROM contigs
  UNION ALL SELECT 1, 'RG', rg, CAST(rg[3:] AS BIGINT), concat_ws(chr(9), '@RG', 'ID:' || rg, 'SM:' || sample) FROM read_groups UNION ALL SELECT 2, 'RG', rg, CAST(rg[3:] AS BIGINT), concat_ws(chr(9), '@RG', 'ID:' || rg, 'SM:later') FROM read_groups
  UNION ALL SELECT s, 'PG', i, p, concat_ws(chr(9), '@PG', 'ID:' || i, 'VN:' || s) FROM (VALUES (0, 'align', 1), (1, 'align', 1), (1, 'sort', 2)) v(s, i, p)),
k AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY source, place) AS r FROM l)
SELECT CAST(CASE kind WHEN 'SQ' THEN 1 WHEN 'RG' THEN 2 ELSE 3 END AS INT) AS part, row_number() OVER (PARTITION BY kind ORDER BY source, place) AS place, value FROM k WHERE r = 1
UNION ALL SELECT 4, p, '@CO' || chr(9) || t FROM (VALUES (1, 'first'), (2, 'third'), (3, 'third')) v(p, t) UNION ALL SELECT 5, 1, '@CO' || chr(9) || 'Merged from: s0 s1 s2'
"""


def validate_header_lines(spark, sf_dir):
    """The lines of three headers, unmerged, read as one: programs and read groups given twice, and a version that isn't known."""
    path = scratch(spark, "header")
    top = spark.createDataFrame([("@HD\tVN:9.9",)], "value string")
    _lines(spark, sf_dir).select("value").unionByName(top).write.text(path)
    return validate.header_cells(sam.read_header(spark, path))


def discrepancy_dump(spark, sf_dir):
    """The comparison as a written table of ten columns; the records of the second stream have no tags."""
    df = reads(spark, sf_dir).select("row_id", *FIELDS, F.map_filter("tags", lambda k, v: k == "XX").alias("tags"))
    return cut(compare.dump(df, _latest(spark, sf_dir), "row_id", FIELDS), "discrepancies")


def _record_sql(x, tags):
    cells = [f"coalesce(CAST({x}.{f} AS VARCHAR), '*')" for f in ["row_id", *FIELDS]]
    return f"CASE WHEN {x}.row_id IS NOT NULL THEN concat_ws(chr(9), {', '.join(cells)}, {tags}) END"


_XX = "CASE WHEN a.tags['XX'] IS NOT NULL THEN 'XX:' || a.tags['XX'] WHEN a.tags IS NOT NULL THEN '' END"
DUMP_SQL = f"""
WITH a AS (SELECT *, row_number() OVER (ORDER BY row_id) AS counter FROM reads), b AS (SELECT *, row_number() OVER (ORDER BY row_id) AS counter FROM {LATEST}),
j AS (SELECT coalesce(a.counter, b.counter) AS counter, a, b, a.qname AS name1, b.qname AS name2, {_record_sql("a", _XX)} AS record1, {_record_sql("b", "NULL")} AS record2 FROM a FULL JOIN b ON a.counter = b.counter)
{" UNION ALL ".join(f"SELECT counter, '{f}' AS field, CAST(NULL AS VARCHAR) AS tag, 0 AS premature, {_shown('a.' + f)} AS value1, {_shown('b.' + f)} AS value2, name1, name2, record1, record2 FROM j WHERE a.row_id IS NOT NULL AND b.row_id IS NOT NULL AND ({c})" for f, c in PLAIN.items())}
UNION ALL SELECT counter, 'TAG', 'XX', 0, a.tags['XX'], '!NULL!', name1, name2, record1, record2 FROM j WHERE b.row_id IS NOT NULL AND a.tags['XX'] IS NOT NULL
UNION ALL SELECT counter, 'PREMATURE', NULL, CASE WHEN a.row_id IS NULL THEN 1 ELSE 2 END, NULL, NULL, name1, name2, record1, record2 FROM j WHERE a.row_id IS NULL OR b.row_id IS NULL
"""


def pairs_descending(spark, sf_dir):
    """Per read group its MAPQ values with their counts, the most frequent first, ties by value."""
    counts = reads(spark, sf_dir).filter("mapq is not null").groupBy("rg", "mapq").agg(F.count("*").alias("n"))
    pairs = counts.groupBy("rg").agg(F.array_sort(F.collect_list(F.struct("mapq", "n"))).alias("p"))
    return pairs.select("rg", F.array_join(F.transform(storage.pairs_descending(F.col("p"), "n"), lambda x: F.concat(x["mapq"].cast("string"), F.lit(":"), x["n"].cast("string"))), " ").alias("pairs"))


POSITIONS = 100


def index_random(spark, sf_dir):
    """A hundred random positions of the twenty largest sequences, looked up through the slice index."""
    number = F.expr("cast(conv(substring(md5(cast(id as string)), 1, 7), 16, 10) as bigint)")
    largest = table(spark, sf_dir, "contigs").orderBy(F.desc("length"), "sequence_id").limit(20).select("sequence_id", "length", (F.row_number().over(_by_length()) - 1).alias("k"))
    places = spark.range(POSITIONS).select(F.col("id").alias("region"), number.alias("h")).join(F.broadcast(largest), F.col("region") % 20 == F.col("k")).select("region", "sequence_id", (F.col("h") % F.col("length") + 1).alias("at"))
    ids = table(spark, sf_dir, "contigs").select(F.col("name").alias("rname"), "sequence_id")
    records = spanned(spark, sf_dir).filter("rname <> '*' and pos >= 1").select("rname", "pos", "end").join(ids, "rname")
    return index.random_checks(table(spark, sf_dir, "slice_index"), records, places)


def _by_length():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("length"), "sequence_id")


INDEX_RANDOM_SQL = f"""
WITH c AS (SELECT sequence_id, length, row_number() OVER (ORDER BY length DESC, sequence_id) - 1 AS k FROM contigs),
p AS (SELECT region, sequence_id, CAST('0x' || substr(md5(CAST(region AS VARCHAR)), 1, 7) AS BIGINT) % length + 1 AS at_ FROM (SELECT unnest(range(0, {POSITIONS})) AS region) JOIN c ON k = region % 20),
s AS (SELECT region, alignment_start AS a, alignment_start + alignment_span - 1 AS b FROM p JOIN slice_index i ON i.sequence_id = p.sequence_id AND alignment_start <= at_ AND greatest(alignment_start + alignment_span - 1, alignment_start) >= at_),
h AS (SELECT region, pos, EXISTS (SELECT 1 FROM s WHERE s.region = p.region AND pos BETWEEN a AND b) AS inside FROM {SPANNED} r JOIN contigs g ON g.name = rname JOIN p ON p.sequence_id = g.sequence_id AND pos <= at_ AND r."end" >= at_ WHERE rname <> '*' AND pos >= 1)
SELECT region, (SELECT count(*) FROM s WHERE s.region = p.region) AS n_slices, (SELECT count(*) FROM h WHERE h.region = p.region) AS n_found, (SELECT count(*) FROM h WHERE h.region = p.region AND NOT inside) AS n_missed FROM p
"""


def mask_files(spark, sf_dir):
    """Masks of lower-case bases through files of either form, known by their first line: how many positions each gives, and how many records have position 5 masked."""
    df, out = reads(spark, sf_dir).filter("seq <> '*' and rlike(seq, '[a-z]')"), None
    marks = F.regexp_replace(F.regexp_replace("seq", "[a-z]", "x"), "[^x]", "_")
    for form, line in (("marks", marks), ("numbers", F.array_join(masks.parse_marks(marks), " "))):
        path = scratch(spark, "mask")
        df.select(line.alias("value")).write.text(path)
        one = masks.read_masks(spark, path).agg(F.sum(F.size("mask")).alias("n_masked"), F.count_if(masks.is_masked(F.col("mask"), F.lit(5))).alias("n_fifth"), F.count_if(F.get(masks.dense(F.col("mask")), F.lit(4)) == 1).alias("n_dense"))
        out = one.select(F.lit(form).alias("form"), "*") if out is None else out.unionByName(one.select(F.lit(form).alias("form"), "*"))
    return out


MASK_FILES_SQL = " UNION ALL ".join(f"SELECT '{f}' AS form, CAST(sum(length(regexp_replace(seq, '[^a-z]', '', 'g'))) AS BIGINT) AS n_masked, CAST(count_if(seq[5] BETWEEN 'a' AND 'z') AS BIGINT) AS n_fifth, CAST(count_if(seq[5] BETWEEN 'a' AND 'z') AS BIGINT) AS n_dense FROM reads WHERE seq <> '*' AND regexp_matches(seq, '[a-z]')" for f in ("marks", "numbers"))


def reference_md5(spark, sf_dir):
    """Sequences of a FASTA file against the M5 of a header that is wrong for every third and lacks every fifth."""
    path, df = scratch(spark, "fasta"), reads(spark, sf_dir).filter("seq is not null and seq <> '*' and seq <> ''").select(F.col("row_id").cast("string").alias("name"), "seq", "row_id")
    fasta.write_fasta(df.select(F.col("name").alias("rname"), "seq"), path)
    given = F.when(F.col("row_id") % 5 > 0, F.when(F.col("row_id") % 3 == 0, F.md5("name")).otherwise(F.upper(F.md5(F.upper("seq")))))
    checked = fasta.check_md5(fasta.read_fasta(spark, path), df.select("name", given.alias("m5")))
    return checked.select(F.col("name").cast("bigint").alias("row_id"), F.coalesce(F.col("ok").cast("int"), F.lit(-1)).alias("ok"))


def region_parse(spark, sf_dir):
    """Regions in text form, one per sequence and form, parsed by the readers."""
    from seqloom.functions.region import Region

    texts = [f"{r['name']}{t}" for r in table(spark, sf_dir, "contigs").select("name").collect() for t in ("", ":17", ":17-", ":5-90")]
    found = [(t, (r := Region.parse(t)).name, r.start, r.end) for t in texts]
    return spark.createDataFrame(found, "region string, name string, start bigint, end bigint")


def merge_written(spark, sf_dir):
    """The merge, written in the order of the sequences and numbered as it is read back: 0 records that are out of order within a file or between files."""
    df = merge.merged_order(_with_source(reads(spark, sf_dir).select("row_id", "rname", "pos", "rg"), spark, sf_dir))
    path = scratch(spark, "merged")
    contigs = table(spark, sf_dir, "contigs")
    merge.written_in_order(df, contigs).write.parquet(path)
    ids = contigs.select(F.col("name").alias("rname"), "sequence_id")
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i")).join(F.broadcast(ids), "rname", "left")
    key = F.coalesce("sequence_id", F.lit(2**31 - 1)).cast("bigint") * 2**32 + F.col("ord")
    return back.withColumn("key", key).select("row_id", "file", "i", "key").groupBy("file").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b"), F.count_distinct("key").alias("d"), F.max_by("key", "i").alias("z"), F.min_by("key", "i").alias("y")).agg(F.sum("n").alias("n_rows"), F.count_if(F.expr("a <> y or b <> z or d <> n")).alias("n_unordered"))


def cipher_roundtrip(spark, sf_dir):
    """Names and bases of all records through an encrypted file and back."""
    plain, hidden, back = (scratch(spark, x) for x in ("plain", "hidden", "back"))
    reads(spark, sf_dir).select(F.concat_ws("\t", "row_id", F.coalesce("seq", F.lit("*"))).alias("value")).coalesce(2).write.text(plain)
    there = cipher.encrypt(spark, files.files_below(plain), hidden, "a password")
    cipher.decrypt(spark, there, back, "a password")
    cells = F.split("value", "\t")
    return spark.read.text(back).select(cells[0].cast("bigint").alias("row_id"), cells[1].alias("seq"))


QUERIES = {
    "cipher_roundtrip": cipher_roundtrip,
    "policy_features": policy_features, "cram_lossy": cram_lossy, "cram_limited": cram_limited, "cram_heads": cram_heads, "format_kinds": format_kinds, "validate_severities": validate_severities, "merge_header_lines": merge_header_lines, "validate_header_lines": validate_header_lines,
    "discrepancy_dump": discrepancy_dump, "pairs_descending": pairs_descending, "index_random": index_random, "mask_files": mask_files, "reference_md5": reference_md5, "region_parse": region_parse, "merge_written": merge_written,
}
SQL = {
    "cipher_roundtrip": "SELECT row_id, coalesce(seq, '*') AS seq FROM reads",
    "policy_features": POLICY_FEATURES_SQL, "cram_lossy": CRAM_LOSSY_SQL, "cram_limited": "SELECT least(count(*), 1000) AS n_rows FROM reads", "cram_heads": CRAM_HEADS_SQL,
    "format_kinds": "SELECT k AS kind, (SELECT count(*) FROM reads) AS n_rows FROM (VALUES ('sam'), ('gzip_sam'), ('bam')) v(k)",
    "validate_severities": "SELECT CASE WHEN type IN ('MISSING_TAG_NM', 'E2_BASE_EQUALS_PRIMARY_BASE') THEN 'warning' ELSE 'error' END AS severity, type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM ({VALIDATE_SQL[r.__name__]})" for r in RULES) + ") GROUP BY 1, 2",
    "merge_header_lines": MERGE_LINES_SQL,
    "validate_header_lines": "SELECT 'INVALID_VERSION_NUMBER' AS type, '9.9' AS id UNION ALL SELECT 'DUPLICATE_PROGRAM_GROUP_ID', 'align' UNION ALL SELECT 'DUPLICATE_READ_GROUP_ID', rg FROM read_groups",
    "discrepancy_dump": DUMP_SQL,
    "pairs_descending": "SELECT rg, string_agg(mapq || ':' || n, ' ' ORDER BY n DESC, mapq) AS pairs FROM (SELECT rg, mapq, count(*) AS n FROM reads WHERE mapq IS NOT NULL GROUP BY ALL) GROUP BY rg",
    "index_random": INDEX_RANDOM_SQL, "mask_files": MASK_FILES_SQL,
    "reference_md5": "SELECT row_id, CASE WHEN row_id % 5 = 0 THEN -1 ELSE CAST(row_id % 3 <> 0 AS INT) END AS ok FROM reads WHERE seq IS NOT NULL AND seq <> '*' AND seq <> ''",
    "region_parse": "SELECT name || t AS region, name, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\" FROM contigs, (VALUES ('', 0, 2147483647), (':17', 17, 2147483647), (':17-', 17, 2147483647), (':5-90', 5, 90)) v(t, s, e)",
    "merge_written": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_unordered FROM reads JOIN (SELECT DISTINCT rg FROM read_groups) USING (rg)",
}

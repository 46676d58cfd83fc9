"""Queries on storage: slices, indexes, codes, columns and validation; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import encoding, region, tags
from seqloom.operators import alignment as al
from seqloom.operators import index, pairing, storage, validate
from seqloom.plans.bases import NM_SQL, OPS, REFB, chunk_letters, placed
from seqloom.plans.records import BATCH, BATCHED, SPAN, SPANNED, reads, spanned
from seqloom.plans.shared import cut, table

EACH = 4
WANTED = [(1, "lg1", 20_000, 60_000), (2, "lg2", 1, 30_000), (3, "lg2", 16_384, 16_385), (4, "scf_1665", 1, 100_000_000)]


def _slices(spark, sf_dir) -> DataFrame:
    size = F.coalesce(F.length("seq"), F.lit(0)) + F.coalesce(F.length("qual"), F.lit(0))
    df = spanned(spark, sf_dir).select("row_id", "rname", "pos", "span", F.coalesce(F.length("seq"), F.lit(0)).alias("n_bases"), size.alias("bytes"))
    df = pairing.batched(df, BATCH).withColumn("end", region.last_base())
    return index.slice_stats(df)


SLICES = f"""(SELECT rname, batch, CAST(min(pos) AS BIGINT) AS alignment_start, CAST(max(CASE WHEN span > 0 THEN pos + span - 1 ELSE pos END) AS BIGINT) AS alignment_end, count(*) AS n_records, CAST(sum(coalesce(length(seq), 0)) AS BIGINT) AS n_bases,
  CAST(sum(coalesce(length(seq), 0) + coalesce(length(qual), 0)) AS BIGINT) AS slice_size FROM (SELECT *, CAST({SPAN} AS BIGINT) AS span FROM {BATCHED}) GROUP BY rname, batch)"""


def slice_stats(spark, sf_dir):
    return _slices(spark, sf_dir)


def container_stats(spark, sf_dir):
    return index.container_stats(_slices(spark, sf_dir), EACH)


def crai_rows(spark, sf_dir):
    return index.slice_offsets(_slices(spark, sf_dir), table(spark, sf_dir, "contigs"), EACH)


CRAI_SQL = f"""
WITH s AS (SELECT x.*, sequence_id, coalesce(sequence_id, 2147483647) AS k FROM {SLICES} x LEFT JOIN contigs ON name = rname),
o AS (SELECT *, CAST(sum(slice_size) OVER (ORDER BY k, batch) - slice_size AS BIGINT) AS o FROM s),
c AS (SELECT *, min(o) OVER (PARTITION BY rname, batch // {EACH}) AS c FROM o)
SELECT sequence_id, alignment_start, alignment_end - alignment_start + 1 AS alignment_span, c AS container_start_offset, o - c AS slice_offset, slice_size FROM c WHERE sequence_id IS NOT NULL
"""


def crai_find(spark, sf_dir):
    regions = spark.createDataFrame(WANTED, "region int, name string, start bigint, end bigint").join(table(spark, sf_dir, "contigs").select("name", "sequence_id"), "name").drop("name")
    return index.find_slices(table(spark, sf_dir, "slice_index"), regions).select("region", "sequence_id", "alignment_start", "container_start_offset", "slice_offset")


CRAI_FIND_SQL = f"SELECT region, i.sequence_id, alignment_start, container_start_offset, slice_offset FROM (VALUES {', '.join(map(str, WANTED))}) w(region, nm, s, e) JOIN contigs c ON c.name = nm JOIN slice_index i ON i.sequence_id = c.sequence_id AND alignment_start <= e AND greatest(alignment_start + alignment_span - 1, alignment_start) >= s"


def slice_reads(spark, sf_dir):
    """Records per slice of the given index that overlap it: a range join of all records with all slices."""
    ids = table(spark, sf_dir, "contigs").select(F.col("name").alias("rname"), "sequence_id")
    at = spanned(spark, sf_dir).filter("rname <> '*' and pos >= 1").select(F.col("row_id").alias("region"), "rname", F.col("pos").alias("start"), "end").join(ids, "rname").drop("rname")
    hits = index.find_slices(table(spark, sf_dir, "slice_index"), at)
    return hits.groupBy("container_start_offset", "slice_offset").agg(F.count("*").alias("n_reads"))


SLICE_READS_SQL = f"SELECT container_start_offset, slice_offset, count(*) AS n_reads FROM {SPANNED} r JOIN contigs c ON c.name = rname JOIN slice_index i ON i.sequence_id = c.sequence_id AND alignment_start <= r.\"end\" AND greatest(alignment_start + alignment_span - 1, alignment_start) >= r.pos WHERE rname <> '*' AND pos >= 1 GROUP BY ALL"


def crai_leftmost(spark, sf_dir):
    return index.leftmost(table(spark, sf_dir, "slice_index")).select("sequence_id", "alignment_start")


def slice_sizes(spark, sf_dir):
    return index.sizes_from_offsets(table(spark, sf_dir, "slice_index")).select("container_start_offset", "slice_offset", "gap")


def reg2bin(spark, sf_dir):
    df = spanned(spark, sf_dir).filter("rname <> '*' and pos >= 1")
    return df.select("row_id", index.slice_bin(F.col("pos"), F.col("span")).alias("bin"))


def _bin_sql(b, e):
    out = "0"
    for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = f"CASE WHEN ({b}) >> {shift} = ({e} - 1) >> {shift} THEN {offset} + (({b}) >> {shift}) ELSE {out} END"
    return f"CAST({out} AS INT)"


def bai_bins(spark, sf_dir):
    return index.bin_chunks(table(spark, sf_dir, "slice_index"))


def bai_linear(spark, sf_dir):
    return index.linear_index(table(spark, sf_dir, "slice_index"))


BAI_LINEAR_SQL = """
WITH t AS (SELECT sequence_id, w AS win, min(container_start_offset) o FROM (SELECT *, unnest(range((alignment_start - 1) >> 14, ((alignment_start + greatest(alignment_span, 1) - 2) >> 14) + 1)) w FROM slice_index) GROUP BY ALL),
a AS (SELECT sequence_id, unnest(range(0, max(win) + 1)) AS win FROM t GROUP BY sequence_id)
SELECT sequence_id, win AS "window", coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY sequence_id ORDER BY win ROWS UNBOUNDED PRECEDING), 0) AS offset FROM a LEFT JOIN t USING (sequence_id, win)
"""


def ref_counts(spark, sf_dir):
    un = F.col("flag").bitwiseAND(4) != 0
    df = reads(spark, sf_dir).select(F.coalesce("rname", F.lit("*")).alias("rname"), "flag", "pos")
    return df.groupBy("rname").agg(F.count_if(~un).alias("n_aligned"), F.count_if(un).alias("n_unaligned"), F.count_if(F.coalesce("pos", F.lit(0)) <= 0).alias("n_no_coordinate"))


def slice_ref_md5(spark, sf_dir):
    """MD5 of the reference under the base-level records of each slice; 32 zeros for slices without any."""
    order = pairing.batched(reads(spark, sf_dir).select("row_id", "rname", "pos"), BATCH).select("row_id", "rname", "batch")
    df = al.placed(reads(spark, sf_dir))
    spans = df.drop("rname").join(order, "row_id").groupBy("rname", "batch").agg(F.min("pos").cast("bigint").alias("s"), F.max(F.col("pos") + F.col("span")).alias("e"))
    every = order.select("rname", "batch").distinct().join(spans, ["rname", "batch"], "left")
    touched = spans.select("rname", F.explode(F.expr(f"sequence((s - 1) div {al.CHUNK}, (e - 2) div {al.CHUNK})")).alias("chunk")).distinct()
    return al.range_md5(every.select("rname", "batch", "s", "e"), chunk_letters(touched), ["rname", "batch"])


REF_MD5_SQL = f"""
WITH b AS (SELECT row_id, batch FROM {BATCHED}), p AS (SELECT rname, batch, min(fp) AS s, max(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN fp + len ELSE fp END) AS e FROM (SELECT * FROM __OPS__) JOIN b USING (row_id) GROUP BY ALL),
t AS (SELECT rname, batch, md5(string_agg({REFB.format('(s + i)')}, '' ORDER BY i)) AS md5 FROM (SELECT *, unnest(range(0, e - s)) AS i FROM p) GROUP BY ALL)
SELECT a.rname, a.batch, coalesce(md5, repeat('0', 32)) AS md5 FROM (SELECT DISTINCT rname, batch FROM {BATCHED}) a LEFT JOIN t USING (rname, batch)
"""


def _series(spark, sf_dir) -> DataFrame:
    """Non-negative integer series of all records: (series, value). The series place has more values than a dictionary may, but fewer than a byte."""
    df = pairing.position_deltas(pairing.batched(reads(spark, sf_dir).select("row_id", "rname", "pos", "flag", "mapq", "seq", "tlen", "tags"), BATCH))
    cells = {"flag": F.col("flag"), "mapq": F.greatest("mapq", F.lit(0)), "length": F.length("seq"), "delta": F.col("delta"), "tlen": F.abs(F.col("tlen").cast("bigint")), "tags": F.size("tags"), "place": F.col("row_id") % 150}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), c.cast("bigint").alias("value")) for n, c in cells.items()]))
    return df.select(each.alias("x")).select("x.*").filter("value >= 0")


SERIES = f"""(SELECT series, CAST(value AS BIGINT) AS value FROM (SELECT unnest([{{'series': 'flag', 'value': CAST(flag AS BIGINT)}}, {{'series': 'mapq', 'value': greatest(CAST(mapq AS BIGINT), 0)}}, {{'series': 'length', 'value': length(seq)}},
  {{'series': 'delta', 'value': CAST(pos - coalesce(lag(pos) OVER (PARTITION BY rname, batch ORDER BY rn), pos) AS BIGINT)}}, {{'series': 'tlen', 'value': abs(CAST(tlen AS BIGINT))}}, {{'series': 'tags', 'value': coalesce(CAST(cardinality(tags) AS BIGINT), -1)}}, {{'series': 'place', 'value': row_id % 150}}], recursive := true) FROM {BATCHED}) WHERE value >= 0)"""
HISTOGRAM_SQL = f"SELECT series, value, count(*) AS n FROM {SERIES} GROUP BY ALL"


def series_histogram(spark, sf_dir):
    return storage.histogram(_series(spark, sf_dir))


def series_frequencies(spark, sf_dir):
    """Per series: distinct values, the largest, the count, and whether a dictionary would be kept."""
    h = series_histogram(spark, sf_dir)
    return h.groupBy("series").agg(F.count("*").alias("n_distinct"), F.max("value").alias("largest"), F.sum("n").alias("n"), (F.count("*") < encoding.DICTIONARY).cast("int").alias("dictionary"))


def huffman_lengths(spark, sf_dir):
    """Code length of each value of the series that a dictionary code is tried for."""
    return storage.huffman_codes(series_histogram(spark, sf_dir))


def huffman_bits(spark, sf_dir):
    """Bits of the whole series in its dictionary code."""
    return huffman_lengths(spark, sf_dir).groupBy("series").agg(F.sum(F.col("n") * F.col("bits")).alias("bits"))


# The two lightest of a sorted queue are merged until one is left; each merge makes the codes of its values a bit longer.
HUFFMAN_SQL = f"""
WITH RECURSIVE h AS ({HISTOGRAM_SQL}), c AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY series) AS d FROM h),
s AS (SELECT series, list_sort(list({{'w': CAST(n AS BIGINT), 'i': CAST(i AS BIGINT), 'm': [value]}})) AS q, count(*) AS turn, CAST([] AS BIGINT[]) AS log FROM c WHERE d < 99 GROUP BY series
  UNION ALL SELECT series, list_sort(list_append(q[3:], {{'w': q[1].w + q[2].w, 'i': turn, 'm': list_concat(q[1].m, q[2].m)}})), turn + 1, list_concat(log, list_concat(q[1].m, q[2].m)) FROM s WHERE len(q) > 1),
l AS (SELECT series, v AS value, count(*) AS bits FROM (SELECT series, unnest(log) AS v FROM s WHERE len(q) = 1) GROUP BY ALL)
SELECT series, value, n, coalesce(bits, 0) AS bits FROM c LEFT JOIN l USING (series, value) WHERE d < 99
"""


def _cost(name, cost):
    return lambda spark, sf_dir: storage.code_costs(series_histogram(spark, sf_dir), {name: cost})


def encoding_cost_beta(spark, sf_dir):
    return storage.beta_costs(series_histogram(spark, sf_dir))


def best_encoding(spark, sf_dir):
    return storage.best_codes(cut(series_histogram(spark, sf_dir), "histogram"))


def best_encoding_plain(spark, sf_dir):
    """The choice without dictionary codes."""
    h = cut(series_histogram(spark, sf_dir), "histogram")
    costs = storage.code_costs(h, encoding.CHOICES).unionByName(storage.beta_costs(h))
    return costs.groupBy("series").agg(F.min("bits").alias("bits"))


_LOG = "(length(bin({})) - 1)"
_COSTS = {
    "gamma1": f"2 * (1 + {_LOG.format('value + 1')}) - 1", **{f"subexp{k}": f"CASE WHEN value < {1 << k} THEN {k + 1} ELSE 2 * {_LOG.format('value')} - {k} + 2 END" for k in (2, 3, 4)},
    **{f"golomb{m}": f"value // {m} + 1 + CASE WHEN value % {m} < {(1 << m.bit_length()) - m} THEN {m.bit_length() - 1} ELSE {m.bit_length()} END" for m in (3, 10)},
    "golomb_rice2": "(value >> 2) + 3", "golomb_rice5": "(value >> 5) + 6", "unary": "value + 1",
    "itf8": "8 * CASE WHEN value >= 268435456 THEN 5 WHEN value < 128 THEN 1 WHEN value < 16384 THEN 2 WHEN value < 2097152 THEN 3 ELSE 4 END",
    "ltf8": "8 * CASE " + " ".join(f"WHEN value < {1 << (7 * n)} THEN {n}" for n in range(1, 9)) + " ELSE 9 END",
}
_BETA = f"SELECT series, 'beta' AS code, CAST(CASE WHEN max(value) <= 0 THEN 0 ELSE length(bin(max(value))) END * count(*) AS BIGINT) AS bits FROM {SERIES} GROUP BY series"


def _cost_sql(name):
    return f"SELECT series, '{name}' AS code, CAST(sum({_COSTS[name]}) AS BIGINT) AS bits FROM {SERIES} GROUP BY series"


def _best_sql():
    each = [f"SELECT *, {i} AS k FROM ({_cost_sql(n)})" for i, n in enumerate(("gamma1", "subexp2", "subexp3", "subexp4"))] + [f"SELECT *, 4 AS k FROM ({_BETA})", f"SELECT series, 'huffman', CAST(sum(n * bits) AS BIGINT), 5 FROM ({HUFFMAN_SQL}) GROUP BY series"]
    return f"SELECT series, code, bits FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY bits, k) AS r FROM ({' UNION ALL '.join(each)})) WHERE r = 1"


def tagset_dictionary(spark, sf_dir):
    return storage.tag_sets(reads(spark, sf_dir).select("tags"))


TAGSET_SQL = "SELECT ids, n, CAST(row_number() OVER (ORDER BY length(ids), ids) - 1 AS INT) AS idx FROM (SELECT coalesce(array_to_string(list_sort(list_transform(map_entries(tags), lambda e: e.key || coalesce(e.value, 'Z')[1])), ''), '') AS ids, count(*) AS n FROM reads GROUP BY 1)"


def tag_type_infer(spark, sf_dir):
    """Tags with the type letter that their value is stored with."""
    each = reads(spark, sf_dir).select("row_id", F.explode(F.map_entries("tags")).alias("e"))
    kind = tags.value_type(F.col("e.value"))
    return each.select("row_id", F.col("e.key").alias("tag"), kind.alias("type"), tags.id_number(F.col("e.key"), kind).alias("id"))


TAG_TYPE_SQL = """
WITH t AS (SELECT row_id, e.key AS tag, e.value[1] AS g, TRY_CAST(e.value[3:] AS BIGINT) AS v FROM (SELECT row_id, unnest(map_entries(tags)) AS e FROM reads)),
k AS (SELECT row_id, tag, CASE WHEN g <> 'i' THEN g WHEN v > 4294967295 OR v < -2147483648 THEN NULL WHEN v > 2147483647 THEN 'I' WHEN v > 65535 THEN 'i' WHEN v > 32767 THEN 'S' WHEN v > 255 THEN 's' WHEN v > 127 THEN 'C' WHEN v >= -128 THEN 'c' WHEN v >= -32768 THEN 's' ELSE 'i' END AS type FROM t)
SELECT row_id, tag, type, ascii(tag[1]) * 65536 + ascii(tag[2]) * 256 + ascii(type) AS id FROM k
"""

CELLS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def _cells(spark, sf_dir):
    return storage.decompose(reads(spark, sf_dir), {c: F.col(c) for c in CELLS})


def decompose_stats(spark, sf_dir):
    n = reads(spark, sf_dir).agg(F.sum(F.length("seq"))).first()[0] or 0
    return storage.column_sizes(_cells(spark, sf_dir), n)


def decompose_cells(spark, sf_dir):
    """Distinct cells per column of the decomposition."""
    return _cells(spark, sf_dir).groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))


CELLS_SQL = "(" + " UNION ALL ".join([f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), '*') AS value FROM reads" for c in CELLS] + ["SELECT e.key, coalesce(e.value, '*') FROM (SELECT unnest(map_entries(tags)) AS e FROM reads)"]) + ")"


def fastq_lines(spark, sf_dir):
    from seqloom.sources.fastq import fastq_records

    return fastq_records(reads(spark, sf_dir)).select("row_id", "file", "record")


FASTQ_SQL = """SELECT row_id, CASE WHEN flag & 1 = 0 THEN 0 WHEN flag & 64 > 0 THEN 1 ELSE 2 END AS file, '@' || coalesce(qname, '*') || chr(10) || coalesce(seq, '*') || chr(10) || '+' || chr(10) || coalesce(qual, '*') AS record FROM reads WHERE flag & 2304 = 0"""


def mask_intlist(spark, sf_dir):
    """The masked positions of each contig's slices, from mask lines."""
    from seqloom.sources.masks import parse_positions

    lines = table(spark, sf_dir, "slice_index").groupBy("sequence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("alignment_start")), lambda x: x.cast("string")), " ").alias("line"))
    return lines.select("sequence_id", F.explode(parse_positions(F.col("line"))).alias("pos"))


def mask_fasta(spark, sf_dir):
    """Masked positions of lower-case bases: lines of x and _."""
    from seqloom.sources.masks import parse_marks

    line = F.regexp_replace(F.regexp_replace("seq", "[a-z]", "x"), "[^x]", "_")
    return reads(spark, sf_dir).filter("seq <> '*'").select("row_id", F.explode(parse_marks(line)).alias("pos"))


def mask_stats(spark, sf_dir):
    from seqloom.sources.masks import mask_statistics, parse_marks

    line = F.regexp_replace(F.regexp_replace("seq", "[a-z]", "x"), "[^x]", "_")
    return mask_statistics(reads(spark, sf_dir).filter("seq <> '*'").select("row_id", parse_marks(line).alias("mask")))


MASK_SQL = "(SELECT row_id, i AS pos FROM (SELECT row_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM reads WHERE seq <> '*') WHERE seq[i] BETWEEN 'a' AND 'z')"


def validate_read_groups(spark, sf_dir):
    return validate.read_groups(reads(spark, sf_dir), table(spark, sf_dir, "read_groups"))


def validate_tags(spark, sf_dir):
    """All records, every fiftieth with a tag beside its own: one in ten of them too large, or too small, for any type."""
    number = F.col("row_id")
    planted = F.when(number % 500 == 0, F.concat(F.lit("i:"), F.when(number % 1000 == 0, "4294967296").otherwise("-2147483649"))).otherwise(F.concat(F.lit("i:"), F.when(number % 100 == 0, "4294967295").otherwise("-2147483648")))
    made = F.map_from_arrays(F.array(F.lit("XL")), F.array(planted))
    return validate.tag_values(reads(spark, sf_dir).withColumn("tags", F.when(number % 50 == 0, made).otherwise(F.col("tags"))))


def _own_tags(spark, sf_dir):
    return validate.tag_values(reads(spark, sf_dir))


def validate_cigar(spark, sf_dir):
    return validate.cigars(reads(spark, sf_dir))


def validate_values(spark, sf_dir):
    return validate.values(reads(spark, sf_dir))


def validate_sort_order(spark, sf_dir):
    return validate.sort_order(reads(spark, sf_dir), table(spark, sf_dir, "contigs"))


def validate_nm(spark, sf_dir):
    return validate.nm_tags(reads(spark, sf_dir), al.md_and_nm(placed(spark, sf_dir)).select("row_id", "nm"))


def validate_mates(spark, sf_dir):
    return validate.mates(reads(spark, sf_dir))


def validate_unmatched(spark, sf_dir):
    return validate.unmatched(reads(spark, sf_dir))


def validate_header_dups(spark, sf_dir):
    """The header tables, given twice as two merged headers would."""
    c, g = table(spark, sf_dir, "contigs"), table(spark, sf_dir, "read_groups")
    return validate.header(c.unionByName(c.filter("sequence_id < 9")), g.unionByName(g.filter("insert_size is null")))


def validate_e2u2(spark, sf_dir):
    """With the reversed read as second bases, and the qualities as second qualities."""
    df = reads(spark, sf_dir).filter("seq <> '*' and qual <> '*'")
    made = F.map_from_arrays(F.array(F.lit("E2"), F.lit("U2")), F.array(F.concat(F.lit("Z:"), F.reverse("seq")), F.concat(F.lit("Z:"), F.col("qual"))))
    return validate.second_bases(df.withColumn("tags", made))


def _own_second_bases(spark, sf_dir):
    return validate.second_bases(reads(spark, sf_dir))


RULES = [validate_read_groups, _own_tags, validate_cigar, validate_values, validate_sort_order, validate_mates, validate_unmatched, validate_nm, _own_second_bases]


def validate_summary(spark, sf_dir):
    """Errors per type over all rules of records, without MATE_NOT_FOUND."""
    out = None
    for rule in RULES:
        out = rule(spark, sf_dir) if out is None else out.unionByName(rule(spark, sf_dir))
    return validate.summary(out, ["MATE_NOT_FOUND"])


def _rules_sql(rows, **rules):
    return " UNION ALL ".join(f"SELECT '{n}' AS type, row_id FROM {rows} WHERE {c}" for n, c in rules.items())


_OK = "coalesce(regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+'), false)"
_READ_SPAN = "coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT))), 0)"
_PAIRS = "(SELECT *, CASE WHEN rnext = '=' THEN rname ELSE rnext END AS ref FROM reads WHERE flag & 1 > 0 AND flag & 2304 = 0 AND qname IS NOT NULL)"
_TWO = f"(SELECT a, b FROM (SELECT p AS a, lead(p) OVER (PARTITION BY qname ORDER BY p.row_id) AS b, row_number() OVER (PARTITION BY qname ORDER BY p.row_id) AS k FROM (SELECT qname, {{'row_id': row_id, 'flag': flag, 'rname': rname, 'pos': pos, 'ref': ref, 'pnext': pnext}} AS p FROM {_PAIRS})) WHERE k % 2 = 1 AND b IS NOT NULL)"


def _mates_sql():
    out = []
    for x, y in (("a", "b"), ("b", "a")):
        rules = {"MISMATCH_MATE_ALIGNMENT_START": f"{x}.pnext IS DISTINCT FROM {y}.pos", "MISMATCH_FLAG_MATE_NEG_STRAND": f"({x}.flag & 32 > 0) <> ({y}.flag & 16 > 0)", "MISMATCH_MATE_REF_INDEX": f"{x}.ref IS DISTINCT FROM {y}.rname", "MISMATCH_FLAG_MATE_UNMAPPED": f"({x}.flag & 8 > 0) <> ({y}.flag & 4 > 0)"}
        if x == "a":
            rules["MATES_ARE_SAME_END"] = "a.flag & 64 = b.flag & 64"
        out += [f"SELECT '{n}' AS type, {x}.row_id AS row_id FROM {_TWO} WHERE {c}" for n, c in rules.items()]
    return " UNION ALL ".join(out)


VALIDATE_SQL = {
    "validate_read_groups": _rules_sql("(SELECT row_id, coalesce(regexp_extract(tags['RG'], '^Z:(.*)$', 1), '') AS g FROM reads)", MISSING_READ_GROUP="g = ''", READ_GROUP_NOT_FOUND="g <> '' AND g NOT IN (SELECT rg FROM read_groups)"),
    "validate_tags": "SELECT 'TAG_VALUE_TOO_LARGE' AS type, row_id FROM reads WHERE row_id % 500 = 0",
    "_own_tags": _rules_sql("reads", TAG_VALUE_TOO_LARGE="len(list_filter(map_values(tags), lambda v: v LIKE 'i:%' AND coalesce(TRY_CAST(v[3:] AS HUGEINT) NOT BETWEEN -2147483648 AND 4294967295, length(v) > 20))) > 0"),
    "validate_cigar": _rules_sql("reads", INVALID_CIGAR=f"flag & 4 = 0 AND NOT {_OK}", MISMATCH_READ_LENGTH_AND_CIGAR=f"flag & 4 = 0 AND {_OK} AND seq <> '*' AND {_READ_SPAN} <> length(seq)"),
    "validate_values": _rules_sql("reads", INVALID_MAPPING_QUALITY="mapq NOT BETWEEN 0 AND 255", MISMATCH_QUAL_AND_SEQ_LENGTH="seq <> '*' AND qual <> '*' AND length(seq) <> length(qual)", INVALID_FLAG_PROPER_PAIR="flag & 1 = 0 AND flag & 2 > 0", MAPPED_READ_WITHOUT_POSITION="flag & 4 = 0 AND (coalesce(pos, 0) <= 0 OR coalesce(rname, '*') = '*')", MISSING_READ_NAME="coalesce(qname, '*') = '*'"),
    "validate_sort_order": "SELECT 'RECORD_OUT_OF_ORDER' AS type, row_id FROM (SELECT row_id, k, lag(k) OVER (PARTITION BY file_id ORDER BY row_id) AS b FROM (SELECT row_id, file_id, coalesce(sequence_id, 2147483647) * 4294967296 + coalesce(pos, 0) AS k FROM reads LEFT JOIN contigs ON name = rname)) WHERE b > k",
    "validate_nm": f"WITH g AS (SELECT row_id, TRY_CAST(tags['NM'][3:] AS BIGINT) AS given FROM reads WHERE flag & 4 = 0), n AS ({NM_SQL}) SELECT 'MISSING_TAG_NM' AS type, row_id FROM g WHERE given IS NULL UNION ALL SELECT 'INVALID_TAG_NM', row_id FROM g JOIN n USING (row_id) WHERE given <> nm",
    "validate_mates": _mates_sql(),
    "validate_unmatched": f"SELECT 'MATE_NOT_FOUND' AS type, max(row_id) AS row_id FROM {_PAIRS} GROUP BY qname HAVING count(*) % 2 = 1",
    "_own_second_bases": """WITH t AS (SELECT row_id, CASE WHEN coalesce(seq, '*') = '*' THEN '' ELSE seq END AS s, tags['E2'][3:] AS e, tags['U2'][3:] AS u FROM reads)
      SELECT 'MISMATCH_READ_LENGTH_AND_E2_LENGTH' AS type, row_id FROM t WHERE length(e) <> length(s) UNION ALL SELECT 'MISMATCH_READ_LENGTH_AND_U2_LENGTH', row_id FROM t WHERE length(u) <> length(s)
      UNION ALL SELECT DISTINCT 'E2_BASE_EQUALS_PRIMARY_BASE', row_id FROM (SELECT row_id, upper(s) AS s, upper(e) AS e, unnest(range(1, length(s) + 1)) AS i FROM t WHERE e IS NOT NULL) WHERE s[i] = e[i] AND s[i] NOT IN ('N', '.')""",
}

QUERIES = {
    "slice_stats": slice_stats, "container_stats": container_stats, "crai_rows": crai_rows, "crai_find": crai_find, "slice_reads": slice_reads, "crai_leftmost": crai_leftmost, "slice_sizes": slice_sizes, "reg2bin": reg2bin, "bai_bins": bai_bins, "bai_linear": bai_linear,
    "ref_counts": ref_counts, "slice_ref_md5": slice_ref_md5, "series_histogram": series_histogram, "series_frequencies": series_frequencies, "huffman_lengths": huffman_lengths, "huffman_bits": huffman_bits, "encoding_cost_beta": encoding_cost_beta,
    **{f"encoding_cost_{n}": _cost(n, c) for n, c in {**encoding.CHOICES, **encoding.OTHERS}.items()}, "best_encoding": best_encoding, "best_encoding_plain": best_encoding_plain, "tagset_dictionary": tagset_dictionary, "tag_type_infer": tag_type_infer,
    "decompose_stats": decompose_stats, "decompose_cells": decompose_cells, "fastq_lines": fastq_lines, "mask_intlist": mask_intlist, "mask_fasta": mask_fasta, "mask_stats": mask_stats,
    "validate_read_groups": validate_read_groups, "validate_tags": validate_tags, "validate_cigar": validate_cigar, "validate_values": validate_values, "validate_sort_order": validate_sort_order, "validate_nm": validate_nm,
    "validate_mates": validate_mates, "validate_unmatched": validate_unmatched, "validate_header_dups": validate_header_dups, "validate_e2u2": validate_e2u2, "validate_summary": validate_summary,
}
SQL = {
    "slice_stats": f"SELECT * FROM {SLICES}",
    "container_stats": f"SELECT rname, batch // {EACH} AS container, min(alignment_start) AS alignment_start, max(alignment_end) AS alignment_end, CAST(sum(n_records) AS BIGINT) AS n_records, CAST(sum(n_bases) AS BIGINT) AS n_bases, count(*) AS n_slices, CAST(sum(slice_size) AS BIGINT) AS container_size FROM {SLICES} GROUP BY 1, 2",
    "crai_rows": CRAI_SQL, "crai_find": CRAI_FIND_SQL, "slice_reads": SLICE_READS_SQL, "crai_leftmost": "SELECT sequence_id, min(alignment_start) AS alignment_start FROM slice_index GROUP BY 1",
    "slice_sizes": "SELECT container_start_offset, slice_offset, lead(slice_offset) OVER (PARTITION BY container_start_offset ORDER BY slice_offset) - slice_offset AS gap FROM slice_index",
    "reg2bin": f"SELECT row_id, {_bin_sql('CAST(pos - 1 AS BIGINT)', '(pos - 1 + greatest(span, 1))')} AS bin FROM {SPANNED} WHERE rname <> '*' AND pos >= 1",
    "bai_bins": f"SELECT sequence_id, {_bin_sql('CAST(alignment_start - 1 AS BIGINT)', '(alignment_start - 1 + greatest(alignment_span, 1))')} AS bin, container_start_offset, min(slice_offset) AS first_offset, max(slice_offset) AS last_offset, count(*) AS n_slices FROM slice_index GROUP BY 1, 2, 3",
    "bai_linear": BAI_LINEAR_SQL,
    "ref_counts": "SELECT coalesce(rname, '*') AS rname, CAST(count_if(flag & 4 = 0) AS BIGINT) AS n_aligned, CAST(count_if(flag & 4 > 0) AS BIGINT) AS n_unaligned, CAST(count_if(coalesce(pos, 0) <= 0) AS BIGINT) AS n_no_coordinate FROM reads GROUP BY 1",
    "slice_ref_md5": REF_MD5_SQL.replace("__OPS__", OPS), "series_histogram": HISTOGRAM_SQL,
    "series_frequencies": f"SELECT series, count(DISTINCT value) AS n_distinct, max(value) AS largest, count(*) AS n, CAST(count(DISTINCT value) < 99 AS INT) AS dictionary FROM {SERIES} GROUP BY series",
    "encoding_cost_beta": _BETA, **{f"encoding_cost_{n}": _cost_sql(n) for n in _COSTS},
    "best_encoding_plain": "SELECT series, min(bits) AS bits FROM (" + " UNION ALL ".join([_cost_sql(n) for n in encoding.CHOICES] + [_BETA]) + ") GROUP BY series",
    "huffman_lengths": HUFFMAN_SQL, "huffman_bits": f"SELECT series, CAST(sum(n * bits) AS BIGINT) AS bits FROM ({HUFFMAN_SQL}) GROUP BY series", "best_encoding": _best_sql(),
    "tagset_dictionary": TAGSET_SQL, "tag_type_infer": TAG_TYPE_SQL,
    "decompose_stats": f"SELECT \"column\", count(*) AS n_values, CAST(sum(strlen(value) + 1) AS BIGINT) AS n_bytes, CAST(sum(strlen(value) + 1) AS BIGINT) * 8.0::DOUBLE / (SELECT sum(length(seq)) FROM reads) AS bits_per_base FROM {CELLS_SQL} GROUP BY 1",
    "decompose_cells": f"SELECT \"column\", count(DISTINCT value) AS n_distinct FROM {CELLS_SQL} GROUP BY 1", "fastq_lines": FASTQ_SQL,
    "mask_intlist": "SELECT sequence_id, alignment_start AS pos FROM slice_index", "mask_fasta": f"SELECT row_id, CAST(pos AS INT) AS pos FROM {MASK_SQL}",
    "mask_stats": f"SELECT r.row_id, CAST(count(m.pos) AS INT) AS n_masked, CAST(min(m.pos) AS INT) AS first_pos, CAST(max(m.pos) AS INT) AS last_pos FROM reads r LEFT JOIN {MASK_SQL} m ON m.row_id = r.row_id WHERE seq <> '*' GROUP BY r.row_id",
    **{n: q for n, q in VALIDATE_SQL.items() if not n.startswith("_")},
    "validate_header_dups": "SELECT 'DUPLICATE_SEQUENCE' AS type, name AS id FROM contigs WHERE sequence_id < 9 UNION ALL SELECT 'DUPLICATE_READ_GROUP_ID', rg FROM read_groups WHERE insert_size IS NULL UNION ALL SELECT 'DUPLICATE_BARCODE', barcode FROM (SELECT * FROM read_groups UNION ALL SELECT * FROM read_groups WHERE insert_size IS NULL) WHERE platform IS NOT NULL GROUP BY barcode HAVING count(*) > 1",
    "validate_e2u2": "SELECT 'MISMATCH_READ_LENGTH_AND_U2_LENGTH' AS type, row_id FROM reads WHERE seq <> '*' AND qual <> '*' AND length(seq) <> length(qual) UNION ALL SELECT DISTINCT 'E2_BASE_EQUALS_PRIMARY_BASE', row_id FROM (SELECT row_id, upper(seq) AS s, upper(reverse(seq)) AS e, unnest(range(1, length(seq) + 1)) AS i FROM reads WHERE seq <> '*' AND qual <> '*') WHERE s[i] = e[i] AND s[i] NOT IN ('N', '.')",
    "validate_summary": "SELECT type, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT * FROM ({VALIDATE_SQL[r.__name__]})" for r in RULES) + ") WHERE type <> 'MATE_NOT_FOUND' GROUP BY type",
}

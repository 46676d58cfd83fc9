"""Queries at base grain: alignment, pileups, features and quality rules; and their SQL.

The test tables hold no reference sequence. Its letter at (name, p) is digit (p - 1) % 32 of
md5(name|(p - 1) // 32), read as ACGT four times over: the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import quality
from seqloom.operators import alignment as al
from seqloom.operators import pairing
from seqloom.plans.records import BATCH, BATCHED, SPANNED, reads, spanned
from seqloom.plans.shared import spread

HEX, LETTERS = "0123456789abcdef", "ACGTACGTACGTACGT"
MIN_HITS = 2


def chunk_letters(touched: DataFrame) -> DataFrame:
    """Chunks (rname, chunk) with their letters, made by the rule above."""
    letters = f"array_join(transform(sequence(0, {(al.CHUNK + al.OVERLAP) // 32 - 1}), k -> translate(md5(concat(rname, '|', cast(chunk * {al.CHUNK // 32} + k as string))), '{HEX}', '{LETTERS}')), '')"
    return touched.select("rname", "chunk", F.expr(letters).alias("seq"))


def made_reference(placed: DataFrame) -> DataFrame:
    """The chunks that the reads touch."""
    size = al.CHUNK
    return chunk_letters(placed.select("rname", F.explode(F.expr(f"sequence((pos - 1L) div {size}, (pos + span + n - 2) div {size})")).alias("chunk")).distinct())


def placed(spark, sf_dir, *keep) -> DataFrame:
    df = al.placed(reads(spark, sf_dir), *keep)
    return al.with_reference(df, made_reference(df))


PLACED = "(SELECT *, length(seq) AS n FROM (SELECT * REPLACE (upper(seq) AS seq) FROM reads) WHERE regexp_full_match(cigar, '([0-9]+[MIDNSHP=X])+') AND rname <> '*' AND pos >= 1 AND seq <> '*' AND coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1), lambda x: CAST(x AS BIGINT))), 0) = length(seq))"
_SUM = "CAST(coalesce(sum(CASE WHEN op IN ({}) THEN len ELSE 0 END) OVER w, 0) AS BIGINT)"
OPS = f"""(SELECT *, 1 + {_SUM.format("'M','I','S','=','X'")} AS rp, pos + {_SUM.format("'M','D','N','=','X'")} AS fp, {_SUM.format("'M','=','X'")} AS mp
  FROM (SELECT row_id, rname, pos, seq, qual, n, k, CAST(t[:-2] AS BIGINT) AS len, t[-1] AS op FROM (SELECT *, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS t, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) AS k FROM {PLACED}))
  WINDOW w AS (PARTITION BY row_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
REFB = f"substr(translate(md5(rname || '|' || CAST(({{0}} - 1) // 32 AS VARCHAR)), '{HEX}', '{LETTERS}'), CAST(({{0}} - 1) % 32 + 1 AS INT), 1)"
BASES = f"(SELECT row_id, rname, pos, op, n, k, rp + i AS rpos, fp + i AS refpos, mp + i AS m, substr(seq, CAST(rp + i AS INT), 1) AS base, {REFB.format('(fp + i)')} AS refb FROM (SELECT *, unnest(range(0, len)) AS i FROM {OPS} WHERE op IN ('M', 'I', 'S', '=', 'X')))"
ALIGNED = f"(SELECT * FROM {BASES} WHERE op IN ('M', '=', 'X'))"


def ref_join_mismatch(spark, sf_dir):
    """Aligned and mismatched bases per record."""
    each = al.bases(placed(spark, sf_dir))
    return each.groupBy("row_id").agg(F.count("*").alias("n_aligned"), F.count_if(F.col("base") != F.col("refb")).alias("n_mismatch"))


def alignment_end(spark, sf_dir):
    """One beyond the last reference base, from the features of a record."""
    df = al.features(placed(spark, sf_dir))
    return df.select("row_id", (F.col("pos") + al.feature_span(F.col("features"), F.col("n"))).alias("stop"))


def coverage(spark, sf_dir):
    df = spanned(spark, sf_dir).filter("rname <> '*' and pos >= 1")
    return al.coverage_runs(df)


COVERAGE_SQL = f"""
WITH e AS (SELECT rname, p, sum(d) d FROM (SELECT rname, CAST(pos AS BIGINT) p, 1 d FROM {SPANNED} WHERE rname <> '*' AND pos >= 1 AND span > 0 UNION ALL SELECT rname, pos + span, -1 FROM {SPANNED} WHERE rname <> '*' AND pos >= 1 AND span > 0) GROUP BY ALL HAVING sum(d) <> 0),
c AS (SELECT rname, p AS start_pos, lead(p) OVER (PARTITION BY rname ORDER BY p) - 1 AS end_pos, CAST(sum(d) OVER (PARTITION BY rname ORDER BY p) AS BIGINT) AS depth FROM e)
SELECT * FROM c WHERE depth > 0
"""


def coverage_histogram(spark, sf_dir):
    """Positions per depth."""
    return coverage(spark, sf_dir).groupBy("depth").agg(F.sum(F.expr("end_pos - start_pos + 1")).alias("n_positions"))


def mismatch_pileup(spark, sf_dir):
    df = al.placed(reads(spark, sf_dir))
    return al.mismatches(df, made_reference(df))


def pileup_saturating(spark, sf_dir):
    df = al.placed(reads(spark, sf_dir))
    return al.pileup(df, made_reference(df))


PILEUP_SQL = "SELECT rname, refpos, refb, " + ", ".join(f"CAST(least(count_if(base = '{b}'), 15) AS INT) AS {b.lower()}" for b in "ACGT") + f" FROM {ALIGNED} GROUP BY rname, refpos, refb"


def refmask_should_store(spark, sf_dir):
    return al.should_store(pileup_saturating(spark, sf_dir), MIN_HITS).select("rname", "refpos", "refb")


def substitution_freq(spark, sf_dir):
    return al.substitution_counts(placed(spark, sf_dir))


def substitution_rank(spark, sf_dir):
    return al.substitution_codes(substitution_freq(spark, sf_dir))


def substitution_pack(spark, sf_dir):
    return al.pack_codes(substitution_rank(spark, sf_dir))


def substitution_unpack(spark, sf_dir):
    return al.unpack_codes(substitution_pack(spark, sf_dir))


FREQ_SQL = f"SELECT r AS refb, b AS base, (SELECT count(*) FROM {ALIGNED} x WHERE x.refb = r AND x.base = b) AS n FROM (SELECT unnest(['A','C','G','T','N']) r), (SELECT unnest(['A','C','G','T','N']) b) WHERE r <> b"
RANK_SQL = f"SELECT refb, base, CAST(row_number() OVER (PARTITION BY refb ORDER BY n DESC, instr('ACGTN', base)) - 1 AS INT) AS code FROM ({FREQ_SQL})"
PACK_SQL = f"SELECT refb, CAST(sum(code << CAST(8 - 2 * rn AS INT)) AS INT) AS packed FROM (SELECT *, row_number() OVER (PARTITION BY refb ORDER BY instr('ACGTN', base)) rn FROM ({RANK_SQL})) GROUP BY refb"


def nm_tag(spark, sf_dir):
    return al.md_and_nm(placed(spark, sf_dir)).select("row_id", "nm")


def md_tag(spark, sf_dir):
    return al.md_and_nm(placed(spark, sf_dir)).select("row_id", "md")


EVENTS = f"(SELECT row_id, k, m, refb AS text, 1 AS use FROM {ALIGNED} WHERE base <> refb UNION ALL SELECT row_id, k, mp, '^' || string_agg({REFB.format('(fp + i)')}, '' ORDER BY i), 0 FROM (SELECT *, unnest(range(0, len)) i FROM {OPS} WHERE op = 'D') GROUP BY row_id, k, mp)"
MD_SQL = f"""
WITH e AS (SELECT *, coalesce(lag(m + use) OVER (PARTITION BY row_id ORDER BY k, m), 0) AS was FROM {EVENTS}),
s AS (SELECT row_id, string_agg(CAST(m - was AS VARCHAR) || text, '' ORDER BY k, m) AS s, arg_max(m + use, k * 1000000 + m) AS was FROM e GROUP BY row_id),
t AS (SELECT row_id, CAST(sum(CASE WHEN op IN ('M', '=', 'X') THEN len ELSE 0 END) AS BIGINT) AS aligned FROM {OPS} GROUP BY row_id)
SELECT t.row_id, coalesce(s, '') || CAST(aligned - coalesce(was, 0) AS VARCHAR) AS md FROM t LEFT JOIN s USING (row_id)
"""
NM_SQL = f"SELECT row_id, CAST(sum(x) AS BIGINT) AS nm FROM (SELECT row_id, CASE WHEN base <> refb THEN 1 ELSE 0 END AS x FROM {ALIGNED} UNION ALL SELECT row_id, CASE WHEN op IN ('I', 'D') THEN len ELSE 0 END FROM {OPS}) GROUP BY row_id"


def cigar_features(spark, sf_dir):
    each = al.features(placed(spark, sf_dir)).select("row_id", F.inline("features"))
    return each.select("row_id", "pos", "op", "text", "len")


FEATURES_SQL = f"""
SELECT row_id, rpos AS pos, CASE WHEN instr('ACGTN', base) > 0 AND instr('ACGTN', refb) > 0 THEN 'X' ELSE 'B' END AS op, base AS text, CAST(1 AS BIGINT) AS len FROM {ALIGNED} WHERE base <> refb
UNION ALL SELECT row_id, rpos, 'i', base, 1 FROM {BASES} WHERE op = 'I'
UNION ALL SELECT row_id, rp, 'S', substr(seq, CAST(rp AS INT), CAST(len AS INT)), len FROM {OPS} WHERE op = 'S' AND len > 0
UNION ALL SELECT row_id, rp, op, '', len FROM {OPS} WHERE op IN ('D', 'N', 'H', 'P') AND len > 0
"""


def feature_delta(spark, sf_dir):
    """Steps between the positions of neighbouring features of a record."""
    at = F.transform("features", lambda x: x["pos"])
    steps = F.zip_with(at, F.concat(F.array(F.lit(0).cast("bigint")), at), lambda x, before: x - before)
    df = al.features(placed(spark, sf_dir)).select("row_id", F.posexplode(F.slice(steps, F.lit(1), F.size("features"))).alias("idx", "delta"))
    return df


def cigar_rebuild(spark, sf_dir):
    return al.restored(al.features(placed(spark, sf_dir))).select("row_id", "cigar")


def bases_restore(spark, sf_dir):
    return al.restored(al.features(placed(spark, sf_dir))).select("row_id", "seq")


REBUILD_SQL = f"""
WITH o AS (SELECT row_id, k, len, CASE WHEN op IN ('=', 'X') THEN 'M' ELSE op END AS op FROM {OPS} WHERE len > 0),
g AS (SELECT *, k - row_number() OVER (PARTITION BY row_id, op ORDER BY k) AS g FROM (SELECT row_id, op, len, row_number() OVER (PARTITION BY row_id ORDER BY k) AS k FROM o)),
s AS (SELECT row_id, op, min(k) AS k, sum(len) AS len FROM g GROUP BY row_id, op, g)
SELECT row_id, string_agg(CAST(len AS VARCHAR) || op, '' ORDER BY k) AS cigar FROM s GROUP BY row_id
"""


def _batched(spark, sf_dir, *keep):
    """Placed records with reference, batch and place in it; batches are formed over all records."""
    order = pairing.batched(reads(spark, sf_dir).select("row_id", "rname", "pos"), BATCH).select(F.col("row_id").alias("_id"), "batch", "rn")
    return placed(spark, sf_dir, *keep).join(order, F.col("row_id") == F.col("_id")).drop("_id")


def prefix_coverage(spark, sf_dir):
    """Per record: what its batch had put on the positions pos to pos + n - 1 when it was added."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return al.prefix_tracks(_batched(spark, sf_dir)).select("row_id", total("coverage").alias("sum_coverage"), F.array_max("coverage").alias("max_coverage"), total("mismatches").alias("sum_mismatches"))


ORDER = f"(SELECT row_id, batch, rn FROM {BATCHED})"
TRACKS = f"""(SELECT row_id, i, CAST(coverage AS BIGINT) AS coverage, CAST(mismatches AS BIGINT) AS mismatches FROM (
  SELECT row_id, i, kind, sum(c) OVER w AS coverage, sum(m) OVER w AS mismatches FROM (
    SELECT rname, batch, rn, unnest(range(pos, pos + span)) AS p, 0 AS kind, 1 AS c, 0 AS m, NULL AS row_id, NULL AS i FROM {PLACED} x JOIN (SELECT row_id, span FROM {SPANNED}) USING (row_id) JOIN {ORDER} USING (row_id) WHERE span > 0
    UNION ALL SELECT rname, batch, rn, refpos, 0, 0, 1, NULL, NULL FROM {ALIGNED} JOIN {ORDER} USING (row_id) WHERE base <> refb
    UNION ALL SELECT rname, batch, rn, pos + i, 1, 0, 0, row_id, i FROM (SELECT *, unnest(range(0, n)) AS i FROM {PLACED}) JOIN {ORDER} USING (row_id))
  WINDOW w AS (PARTITION BY rname, batch, p ORDER BY rn, kind ROWS UNBOUNDED PRECEDING)) WHERE kind = 1)"""


def scored(spark, sf_dir, tracks: bool) -> DataFrame:
    """All records with scores for all their bases, placed ones with their alignment."""
    df = spread(reads(spark, sf_dir).select("row_id", "flag", "mapq", "seq", "qual")).filter("qual <> '*' and seq <> '*' and length(qual) = length(seq) and length(qual) > 0").select("row_id", "flag", "mapq", quality.scores(F.col("qual")).alias("q"))
    if tracks:
        at = al.prefix_tracks(_batched(spark, sf_dir), "pos", "cigar", "seq", "ref").withColumn("ops", al.operations(F.col("cigar"), F.col("pos"))).drop("cigar")
    else:
        at = placed(spark, sf_dir).select("row_id", "pos", "seq", "ref", "ops")
    base = at.withColumnRenamed("row_id", "_id").drop("rname", "n", "span")
    return df.join(base, F.col("row_id") == F.col("_id"), "left").drop("_id")


def _policy(spec):
    def query(spark, sf_dir):
        rules = quality.parse_policies(spec)
        df = quality.apply_policies(scored(spark, sf_dir, quality.needs_tracks(rules)), rules)
        return df.select("row_id", F.col("forced").cast("int").alias("forced"), F.size(F.filter("scores", lambda s: s >= 0)).cast("bigint").alias("n_kept"), quality.as_text(F.col("restored")).alias("qual"))

    return query


ILLUMINA_SQL = "CASE WHEN {0} < 2 THEN {0} WHEN {0} < 10 THEN 6 WHEN {0} < 20 THEN 15 WHEN {0} < 25 THEN 22 WHEN {0} < 30 THEN 27 WHEN {0} < 35 THEN 33 WHEN {0} < 40 THEN 37 ELSE 40 END"
NCBI_SQL = "CASE WHEN {0} < 3 THEN {0} WHEN {0} < 15 THEN 9 WHEN {0} < 20 THEN 17 WHEN {0} < 25 THEN 22 WHEN {0} < 30 THEN 28 ELSE 35 END"


QUALITIES = "(SELECT row_id, flag, mapq, length(seq) AS len, unnest(range(0, length(qual))) AS j, ascii(unnest(string_split(qual, ''))) - 33 AS q FROM reads WHERE qual <> '*' AND seq <> '*' AND length(qual) = length(seq) AND length(qual) > 0)"


_MATCH, _MISMATCH, _INSERTION, _FLANK = "base = refb", "base <> refb", "op = 'I'", "d.row_id IS NOT NULL"
_BINNED = ILLUMINA_SQL.format("q")
#: What each set of rules means, in the order of application: the reads, the bases (none: all of them) and the new score.
MEANING = {
    "policy_R8_N40": [("true", _MATCH, _BINNED), ("true", _MISMATCH, "q")],
    "policy_N40_D8": [("true", _FLANK, _BINNED), ("true", _MISMATCH, "q")],
    "policy_m5": [("coalesce(mapq, 0) < 5", None, "q")],
    "policy_R40X10_N40": [("true", f"{_MATCH} OR coverage < 10", "q"), ("true", _MISMATCH, "q")],
    "policy_P3_40": [("true", "mismatches > 3", "q")],
    "policy_U_all": [("true", None, _BINNED), ("flag & 4 <> 0", None, "q")],
    "policy_latch": [("true", f"{_MISMATCH} OR {_INSERTION} OR {_FLANK}", "q")],
    "policy_M10_I8": [("coalesce(mapq, 0) > 10", None, _BINNED), ("true", _INSERTION, _BINNED), ("coalesce(mapq, 0) < 999", None, _BINNED)],
}


def _policy_sql(name):
    rules = MEANING[name]
    tracks = any("coverage" in (b or "") or "mismatches" in (b or "") for _, b, _ in rules)
    joined = f"""SELECT a.*, b.row_id IS NOT NULL AS placed, {', '.join(f'coalesce({b or "true"}, false) AS m{i}' for i, (_, b, _) in enumerate(rules))} FROM {QUALITIES} a LEFT JOIN {BASES} b ON b.row_id = a.row_id AND b.rpos = a.j + 1
      LEFT JOIN (SELECT DISTINCT row_id, j FROM (SELECT row_id, unnest([rp - 1, rp]) AS j FROM {OPS} WHERE op = 'D')) d ON d.row_id = a.row_id AND d.j = a.j""" + (f" LEFT JOIN {TRACKS} t ON t.row_id = a.row_id AND t.i = a.j" if tracks else "")
    state, force = "-1", "false"
    for i, (applies, base, value) in enumerate(rules):
        if base:
            state = f"CASE WHEN {applies} AND placed AND m{i} THEN {value} ELSE {state} END"
            force = f"({force} OR ({applies} AND placed AND h{i} > len // 2))"
        else:
            state, force = f"CASE WHEN {applies} THEN {value} ELSE {state} END", f"CASE WHEN {applies} THEN true ELSE {force} END"
    hits = ", ".join(f"count_if(m{i}) OVER (PARTITION BY row_id) AS h{i}" for i in range(len(rules)))
    return f"""
WITH x AS ({joined}), h AS (SELECT *, {hits} FROM x), s AS (SELECT row_id, j, {state} AS s, {force} AS f FROM h)
SELECT row_id, CAST(bool_or(f) AS INT) AS forced, CAST(count_if(s >= 0) AS BIGINT) AS n_kept, string_agg(chr(CAST(CASE WHEN s < 0 THEN 30 ELSE s END + 33 AS INT)), '' ORDER BY j) AS qual FROM s GROUP BY row_id
"""


def _bin_query(table):
    def query(spark, sf_dir):
        df = reads(spark, sf_dir).filter("qual <> '*' and qual <> ''")
        return df.select("row_id", quality.as_text(F.transform(quality.scores(F.col("qual")), lambda q: quality.binned(q, table))).alias("qual"))

    return query


def _bin_sql(cases):
    return f"SELECT row_id, string_agg(chr(CAST({cases.format('q')} + 33 AS INT)), '' ORDER BY j) AS qual FROM (SELECT row_id, unnest(range(0, length(qual))) AS j, ascii(unnest(string_split(qual, ''))) - 33 AS q FROM reads WHERE qual <> '*' AND qual <> '') GROUP BY row_id"


POLICIES = {"policy_R8_N40": "R8-N40", "policy_N40_D8": "N40-D8", "policy_m5": "m5", "policy_R40X10_N40": "R40X10-N40", "policy_P3_40": "P3_40", "policy_U_all": "U40-*8", "policy_latch": "N40I40D40", "policy_M10_I8": "M10_8-I8-m999_8", "policy_drop_all": ""}
QUERIES = {
    "ref_join_mismatch": ref_join_mismatch, "alignment_end": alignment_end, "coverage": coverage, "coverage_histogram": coverage_histogram, "mismatch_pileup": mismatch_pileup, "pileup_saturating": pileup_saturating,
    "refmask_should_store": refmask_should_store, "substitution_freq": substitution_freq, "substitution_rank": substitution_rank, "substitution_pack": substitution_pack, "substitution_unpack": substitution_unpack, "nm_tag": nm_tag, "md_tag": md_tag,
    "cigar_features": cigar_features, "feature_delta": feature_delta, "cigar_rebuild": cigar_rebuild, "bases_restore": bases_restore, "prefix_coverage": prefix_coverage,
    **{name: _policy(spec) for name, spec in POLICIES.items()}, "qual_bin_illumina": _bin_query(quality.ILLUMINA), "qual_bin_ncbi": _bin_query(quality.NCBI),
}
SQL = {
    "ref_join_mismatch": f"SELECT row_id, count(*) AS n_aligned, CAST(count_if(base <> refb) AS BIGINT) AS n_mismatch FROM {ALIGNED} GROUP BY row_id",
    "alignment_end": f"SELECT row_id, any_value(pos) + CAST(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) AS BIGINT) AS stop FROM {OPS} GROUP BY row_id",
    "coverage": COVERAGE_SQL, "coverage_histogram": f"SELECT depth, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS n_positions FROM ({COVERAGE_SQL}) GROUP BY depth",
    "mismatch_pileup": f"SELECT rname, refpos, count(*) AS n FROM {ALIGNED} WHERE base <> refb GROUP BY ALL", "pileup_saturating": PILEUP_SQL,
    "refmask_should_store": f"SELECT rname, refpos, refb FROM ({PILEUP_SQL}) WHERE a + c + g + t <= 10 AND (" + " OR ".join(f"(refb <> '{b}' AND {b.lower()} >= {MIN_HITS})" for b in "ACGT") + ")",
    "substitution_freq": FREQ_SQL, "substitution_rank": RANK_SQL, "substitution_pack": PACK_SQL, "substitution_unpack": RANK_SQL, "nm_tag": NM_SQL, "md_tag": MD_SQL, "cigar_features": FEATURES_SQL,
    "feature_delta": f"SELECT row_id, CAST(row_number() OVER w - 1 AS INT) AS idx, pos - coalesce(lag(pos) OVER w, 0) AS delta FROM (SELECT f.*, CASE WHEN op IN ('X', 'B', 'i', 'S') THEN 1 ELSE 0 END AS z FROM ({FEATURES_SQL}) f) WINDOW w AS (PARTITION BY row_id ORDER BY pos, z)",
    "cigar_rebuild": REBUILD_SQL, "bases_restore": f"SELECT row_id, seq FROM {PLACED}",
    "prefix_coverage": f"SELECT row_id, CAST(sum(coverage) AS BIGINT) AS sum_coverage, max(coverage) AS max_coverage, CAST(sum(mismatches) AS BIGINT) AS sum_mismatches FROM {TRACKS} GROUP BY row_id",
    **{name: _policy_sql(name) for name in MEANING}, "qual_bin_illumina": _bin_sql(ILLUMINA_SQL), "qual_bin_ncbi": _bin_sql(NCBI_SQL),
    "policy_drop_all": f"SELECT row_id, 0 AS forced, CAST(0 AS BIGINT) AS n_kept, repeat('?', length(qual)) AS qual FROM reads WHERE qual <> '*' AND seq <> '*' AND length(qual) = length(seq) AND length(qual) > 0",
}

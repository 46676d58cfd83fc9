"""Queries p4 and p6 to p10, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import leaks as leaking
from seqloom.llm import percentiles, spans, terms, textstats, tokenizer
from seqloom.plans.shared import cut, table

RARE, COMMON = (2, 1000), (50, 100)
SPAN = 60
PERCENTS = (10, 50, 90)
SHARE_PER_MILLE = 4
HIGH_TLEN, LOW_MAPQ = 1000, 20
PHRASE, LEAST_WORDS = 12, 6
SLACK, IN_PLACE = 1, 90
#: A score of 12 stands for tail probabilities that multiply to one in 160,000.
FAR_OUT = 12.0


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "reads").select("qual", "mapq", "tags")
    fields = {"qual": terms.symbols(F.when(F.col("qual") != "*", F.col("qual"))), "mapq": terms.single(F.col("mapq")), "tag": terms.entries(F.col("tags"))}
    return terms.term_frequencies(reads, fields, RARE, COMMON)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms with their occurrences and records."""
    return _terms(spark, sf_dir).select("field", "term", "n", "n_rows", "mark")


P4_TERMS_SQL = """
WITH t AS (
  SELECT 'qual' AS field, c AS term, row_id, count(*) AS n FROM (SELECT row_id, unnest(string_split(qual, '')) c FROM reads WHERE qual <> '*') WHERE c <> '' GROUP BY ALL
  UNION ALL SELECT 'mapq', CAST(mapq AS VARCHAR), row_id, 1 FROM reads WHERE mapq IS NOT NULL
  UNION ALL SELECT 'tag', e.key || ':' || e.value, row_id, 1 FROM (SELECT row_id, unnest(map_entries(tags)) e FROM reads WHERE tags IS NOT NULL) WHERE e.value IS NOT NULL),
s AS (SELECT field, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_rows FROM t GROUP BY ALL)
SELECT *, CASE WHEN n_rows * 1000 < 2 * (SELECT count(*) FROM reads) THEN 'rare' WHEN n_rows * 100 > 50 * (SELECT count(*) FROM reads) THEN 'common' END AS mark FROM s
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = table(spark, sf_dir, "reads").select("row_id", F.upper("seq").alias("seq")).filter("seq <> '*'")
    return spans.shared_spans(reads, "row_id", "seq", SPAN)


P6_SQL = f"""
WITH w AS (SELECT row_id, i, substr(upper(seq), i, {SPAN}) k FROM (SELECT row_id, seq, unnest(range(1, length(seq) - {SPAN} + 2)) i FROM reads WHERE seq <> '*' AND length(seq) >= {SPAN})),
s AS (SELECT row_id, i FROM (SELECT row_id, i, min(row_id) OVER (PARTITION BY k) a, max(row_id) OVER (PARTITION BY k) b FROM w) WHERE a < b),
g AS (SELECT row_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY row_id ORDER BY i) <= {SPAN} THEN 0 ELSE 1 END new FROM s),
r AS (SELECT row_id, i, sum(new) OVER (PARTITION BY row_id ORDER BY i ROWS UNBOUNDED PRECEDING) run FROM g)
SELECT row_id, min(i) AS span_start, max(i) + {SPAN} - 1 AS span_end FROM r GROUP BY row_id, run
"""


def p6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's maximal repeats, with the place of the representative of their class and the number of records that share them."""
    reads = table(spark, sf_dir, "reads").select("row_id", F.upper("seq").alias("seq")).filter("seq <> '*'")
    return spans.maximal_repeats(reads, "row_id", "seq", SPAN)


P6_REPEATS_SQL = f"""
WITH w AS (SELECT row_id, i, substr(upper(seq), i, {SPAN}) k FROM (SELECT row_id, seq, unnest(range(1, length(seq) - {SPAN} + 2)) i FROM reads WHERE seq <> '*' AND length(seq) >= {SPAN})),
c AS (SELECT k, min(row_id) AS r, arg_min(i, row_id * 100000 + i) AS ri, count(DISTINCT row_id) AS n_rows FROM w GROUP BY k HAVING count(DISTINCT row_id) > 1),
g AS (SELECT row_id, i, r, ri, n_rows, i - row_number() OVER (PARTITION BY row_id, r, ri - i, n_rows ORDER BY i) AS run FROM w JOIN c USING (k))
SELECT row_id, min(i) AS span_start, max(i) + {SPAN} - 1 AS span_end, r AS class_row_id, min(ri) AS class_start, n_rows FROM g GROUP BY row_id, r, ri - i, n_rows, run
"""


def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each record's bases are shared with other records; records without any have 0."""
    reads = table(spark, sf_dir, "reads").filter("seq is not null and seq <> '*'").select("row_id", F.length("seq").cast("bigint").alias("n_bases"))
    shared = p6_found(spark, sf_dir).groupBy("row_id").agg(F.sum(F.col("span_end") - F.col("span_start") + 1).alias("n_shared"))
    return reads.join(shared, "row_id", "left").select("row_id", "n_bases", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared"))


P6_SHARE_SQL = f"SELECT r.row_id, CAST(length(seq) AS BIGINT) AS n_bases, CAST(coalesce(sum(span_end - span_start + 1), 0) AS BIGINT) AS n_shared FROM reads r LEFT JOIN ({P6_SQL}) s ON s.row_id = r.row_id WHERE seq IS NOT NULL AND seq <> '*' GROUP BY r.row_id, seq"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "reads").select("rname", "mapq", "tlen", "load_day").filter("rname is not null and rname <> '*'")


def _percentiles(reads: DataFrame) -> DataFrame:
    tlen = F.abs(F.col("tlen").cast("bigint"))
    fields = {"tlen": F.when(tlen != 0, tlen), "mapq": F.when(F.col("mapq").between(0, 254), F.col("mapq"))}
    by_day = percentiles.value_counts(reads, "rname", fields, ["load_day"])
    return percentiles.bisect_percentiles(percentiles.merge_counts(by_day), PERCENTS)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "reads").count()
    reads = _placed(spark, sf_dir)
    # At most 1000 / SHARE_PER_MILLE groups can reach the share: a proven bound for the broadcast.
    large = cut(reads.groupBy("rname").count().filter(F.col("count") * 1000 >= F.lit(total) * SHARE_PER_MILLE).select("rname"), "large")
    found = _percentiles(reads.join(F.broadcast(large), "rname", "left_semi")).filter(f"field = 'tlen' and value > {HIGH_TLEN} or field = 'mapq' and value < {LOW_MAPQ}")
    return found.select(F.col("grp").alias("rname"), "field", F.col("pct").cast("bigint").alias("pct"))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every RNAME, however small; only p7_found has a least share."""
    return _percentiles(_placed(spark, sf_dir)).select(F.col("grp").alias("rname"), "field", F.col("pct").cast("bigint").alias("pct"), "n", "value")


P7_PERCENTILES_SQL = """
WITH v AS (SELECT rname, 'tlen' AS field, abs(CAST(tlen AS BIGINT)) AS value FROM reads WHERE rname IS NOT NULL AND rname <> '*' AND tlen <> 0
  UNION ALL SELECT rname, 'mapq', mapq FROM reads WHERE rname IS NOT NULL AND rname <> '*' AND mapq BETWEEN 0 AND 254),
k AS (SELECT *, row_number() OVER (PARTITION BY rname, field ORDER BY value) rn, count(*) OVER (PARTITION BY rname, field) n FROM v)
SELECT rname, field, CAST(pct AS BIGINT) AS pct, n, CAST(value AS BIGINT) AS value FROM k, (VALUES (10), (50), (90)) p(pct) WHERE rn = (pct * n + 99) // 100
"""
P7_LARGE_SQL = f"SELECT rname FROM reads GROUP BY rname HAVING count(*) * 1000 >= {SHARE_PER_MILLE} * (SELECT count(*) FROM reads)"
P7_SQL = f"SELECT rname, field, pct FROM ({P7_PERCENTILES_SQL}) WHERE rname IN ({P7_LARGE_SQL}) AND (field = 'tlen' AND value > {HIGH_TLEN} OR field = 'mapq' AND value < {LOW_MAPQ})"


def _vocabulary() -> str:
    return os.path.join(tokenizer.VOCABULARY_DIR, "byte_bpe_50k.tiktoken")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf_dir, "documents"), _vocabulary())


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether decoding its ids gives its text back, null counting as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("given"))
    decoded = tokenizer.decode_corpus(p8_ids(spark, sf_dir), _vocabulary())
    return docs.join(decoded, "doc_id").select("doc_id", (F.col("given") == F.col("text")).cast("bigint").alias("same"))


P8_ROUNDTRIP_SQL = "SELECT doc_id, CAST(1 AS BIGINT) AS same FROM documents"


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaking.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), PHRASE, LEAST_WORDS)


P9_SQL = f"""
WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), {PHRASE}) n FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w FROM eval_items WHERE text IS NOT NULL)),
p AS (SELECT item_id, n, array_to_string(w[j : j + n - 1], ' ') k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) j FROM i WHERE n >= {LEAST_WORDS})),
s AS (SELECT DISTINCT n FROM p),
g AS (SELECT DISTINCT doc_id, n, array_to_string(w[j : j + n - 1], ' ') k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) j FROM d, s WHERE len(w) >= n))
SELECT DISTINCT doc_id, item_id FROM g JOIN p USING (n, k)
"""


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proximity matches: nine tenths of the words of a phrase within a word of their place, and the most that are."""
    return leaking.near_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), PHRASE, LEAST_WORDS, SLACK, IN_PLACE)


P9_NEAR_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, p, w[p] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) p FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w FROM documents WHERE text IS NOT NULL))),
i AS (SELECT item_id, w, least(len(w), {PHRASE}) AS n FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) >= {LEAST_WORDS}),
q AS (SELECT item_id, len(w) AS size, n, q, w[q] AS term FROM (SELECT *, unnest(range(1, len(w) + 1)) q FROM i)),
m AS (SELECT DISTINCT item_id, doc_id, p - q + s AS a, q, size, n FROM q JOIN d USING (term), (SELECT unnest(range(-{SLACK}, {SLACK} + 1)) s)),
c AS (SELECT item_id, doc_id, a, size, n, list(q) AS qs FROM m GROUP BY ALL HAVING count(*) * 100 >= n * {IN_PLACE}),
b AS (SELECT item_id, doc_id, n, len(list_filter(qs, lambda x: x BETWEEN j AND j + n - 1)) AS k FROM (SELECT *, unnest(range(1, size - n + 2)) j FROM c))
SELECT doc_id, item_id, CAST(max(k) AS BIGINT) AS n FROM b WHERE k * 100 >= n * {IN_PLACE} GROUP BY doc_id, item_id
"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(textstats.text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")), "statistics")
    return cut(textstats.outlier_scores(stats), "scored")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.prose(_scored(spark, sf_dir)).select("doc_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts per document, and the outlier score to six decimals."""
    return _scored(spark, sf_dir).select("doc_id", "lang", "words", "n_chars", "n_symbols", "n_lines", "n_ended", "n_common", F.round("outlier_score", 6).alias("outlier_score"))


def p10_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lie far out in their language, by the scores alone."""
    return textstats.outliers(_scored(spark, sf_dir), FAR_OUT).select("doc_id", "lang", F.round("outlier_score", 6).alias("outlier_score"))


P10_COUNTS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lower(split_part(trim(lang), '-', 1)), 'und') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '[ \t\r\n]+'), lambda x: x <> '') AS w, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM t)
SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS words, CAST(length(regexp_replace(t, '[ \t\r\n]+', '', 'g')) AS BIGINT) AS n_chars,
  CAST(length(regexp_replace(t, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(list_filter(l, lambda x: x[-1] IN ('.', '!', '?', '。', '！', '？'))) AS BIGINT) AS n_ended,
  CAST(len(list_filter(w, lambda x: list_contains(cw, x))) AS BIGINT) AS n_common FROM w, (SELECT list(DISTINCT word) AS cw FROM common_words)
"""
P10_SQL = f"SELECT doc_id FROM ({P10_COUNTS_SQL}) WHERE words >= 20 AND n_chars >= 3 * words AND n_chars <= 8 * words AND n_symbols * 10 <= n_chars AND n_ended * 10 >= n_lines AND n_common * 4 >= words"
_TAILS = ", ".join(f"ln(least(1.0, 2.0 * least(count(*) OVER (PARTITION BY lang ORDER BY {s}), count(*) OVER (PARTITION BY lang ORDER BY {s} DESC)) / count(*) OVER (PARTITION BY lang))) AS x{i}" for i, s in enumerate(["a", "b", "c", "d", "e"]))
P10_STATISTICS_SQL = f"""
WITH s AS (SELECT *, CAST(words AS DOUBLE) a, CASE WHEN words > 0 THEN CAST(n_chars AS DOUBLE) / words ELSE 0 END b, CASE WHEN n_chars > 0 THEN CAST(n_symbols AS DOUBLE) / n_chars ELSE 0 END c,
  CASE WHEN n_lines > 0 THEN CAST(n_ended AS DOUBLE) / n_lines ELSE 0 END d, CASE WHEN words > 0 THEN CAST(n_common AS DOUBLE) / words ELSE 0 END e FROM ({P10_COUNTS_SQL})),
p AS (SELECT *, {_TAILS} FROM s)
SELECT doc_id, lang, words, n_chars, n_symbols, n_lines, n_ended, n_common, round(0.0 - x0 - x1 - x2 - x3 - x4, 6) AS outlier_score FROM p
"""

QUERIES = {
    "p4_found": p4_found, "p4_terms": p4_terms, "p6_found": p6_found, "p6_repeats": p6_repeats, "p6_share": p6_share, "p7_found": p7_found, "p7_percentiles": p7_percentiles,
    "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found, "p10_statistics": p10_statistics, "p10_outliers": p10_outliers,
}
SQL = {
    "p4_found": f"SELECT field, term, mark FROM ({P4_TERMS_SQL}) WHERE mark IS NOT NULL", "p4_terms": P4_TERMS_SQL, "p6_found": P6_SQL, "p6_repeats": P6_REPEATS_SQL, "p6_share": P6_SHARE_SQL, "p7_found": P7_SQL, "p7_percentiles": P7_PERCENTILES_SQL,
    "p8_roundtrip": P8_ROUNDTRIP_SQL, "p9_found": P9_SQL, "p9_near": P9_NEAR_SQL, "p10_found": P10_SQL, "p10_statistics": P10_STATISTICS_SQL,
    "p10_outliers": f"SELECT doc_id, lang, outlier_score FROM ({P10_STATISTICS_SQL}) WHERE outlier_score >= {FAR_OUT}",
}

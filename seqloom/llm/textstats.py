"""Text quality statistics per document, and outlier scores from exact per-language ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import broadcast_if_small, cut, spread

# Fixed values of the statistics: what separates words, ASCII punctuation, marks that end a sentence.
SPACE = " \\t\\r\\n"
PUNCTUATION = "[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]"
SENTENCE_END = "[.!?。！？](?=[ \\t\\r]*(?:\\n|\\z))"

#: Common words up to this number become a set inside the expression; more are joined.
SET_WORDS = 20_000
STATISTICS = ("n_words", "mean_word", "symbol_ratio", "ended_ratio", "common_ratio")


def text_statistics(docs: DataFrame, common: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, lang, the counts, and the five statistics as DOUBLE.

    n_words and n_chars count the runs of other than space, tab, CR and LF and their characters;
    n_symbols ASCII punctuation; n_lines lines that are not blank, n_ended those whose last
    character but blanks ends a sentence; n_common words that are in common (a column word), in lower case.
    Null, empty and blank texts have 0 everywhere. lang is brought to lower case without region;
    null is und. Repeated rows stay repeated, other columns are left out.
    """
    common = common.select("word").filter("word is not null and word <> ''").distinct()
    words = [r[0] for r in common.limit(SET_WORDS + 1).collect()]
    docs = spread(docs.select(doc_id, text, lang))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.lower(F.substring_index(F.trim(F.col(lang)), "-", 1)), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # The array of words is used twice; as a column of its own it is made once.
    docs = docs.withColumn("_w", F.split(F.btrim(F.lower("_t"), F.lit(" \t\r\n")), f"[{SPACE}]+"))
    split = F.col("_w")
    counts = [
        F.when(split[0] == "", 0).otherwise(F.size(split)).cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("_t", f"[{SPACE}]+", "")).cast("bigint").alias("n_chars"),
        F.regexp_count("_t", F.lit(PUNCTUATION)).cast("bigint").alias("n_symbols"),
        F.regexp_count("_t", F.lit(f"[^{SPACE}][^\\n]*")).cast("bigint").alias("n_lines"),
        F.regexp_count("_t", F.lit(SENTENCE_END)).cast("bigint").alias("n_ended"),
    ]
    if len(words) <= SET_WORDS:
        known = F.size(F.filter(split, lambda w: w.isin(words))) if words else F.lit(0)
        out = docs.select("doc_id", "lang", *counts, known.cast("bigint").alias("n_common"))
    else:
        each = docs.withColumn("_row", F.struct(F.monotonically_increasing_id(), "doc_id")).select("_row", "doc_id", "lang", *counts, "_w")
        each = cut(each, "words")
        hits = each.select("_row", F.explode("_w").alias("word")).join(broadcast_if_small(cut(common, "common")), "word").groupBy("_row").agg(F.count("*").alias("n_common"))
        out = each.drop("_w").join(hits, "_row", "left").drop("_row").withColumn("n_common", F.coalesce("n_common", F.lit(0).cast("bigint")))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(
        "doc_id", "lang", F.col("n_words").alias("words"), "n_chars", "n_symbols", "n_lines", "n_ended", "n_common", F.col("n_words").cast("double").alias("n_words"),
        ratio("n_chars", "n_words").alias("mean_word"), ratio("n_symbols", "n_chars").alias("symbol_ratio"), ratio("n_ended", "n_lines").alias("ended_ratio"), ratio("n_common", "n_words").alias("common_ratio"),
    )


def exact_ranks(df: DataFrame, group: str, statistics: Sequence[str]) -> DataFrame:
    """Rows (stat, grp, value, n, at_most, total): how many rows of the group have at most this value.

    Distinct values with their counts are range-partitioned over all statistics and groups and
    ranked inside each partition; the counts of earlier partitions are added as offsets. A value
    shared by a third of all rows is one row here.
    """
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in statistics]))
    values = df.select(F.col(group).alias("grp"), each.alias("x")).groupBy("x.stat", "grp", "x.value").agg(F.count("*").alias("n"))
    ranged = cut(values.repartitionByRange("stat", "grp", "value").withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("stat", "grp", "part").agg(F.sum("n").alias("_sum"))
    whole = Window.partitionBy("stat", "grp")
    sums = sums.select("stat", "grp", "part", F.coalesce(F.sum("_sum").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_sum").over(whole).alias("total"))
    local = F.sum("n").over(Window.partitionBy("stat", "grp", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(sums, ["stat", "grp", "part"]).select("stat", "grp", "value", "n", (F.col("_offset") + local).alias("at_most"), "total")


def outlier_scores(stats: DataFrame, group: str = "lang", statistics: Sequence[str] = STATISTICS, row: str = "doc_id") -> DataFrame:
    """stats with outlier_score: minus the sum of the logarithms of the two-sided tail probabilities of its statistics within its group.

    The tail probability of a value is twice the smaller share of the group's rows that lie at
    or below and at or above it, at most 1. Groups and values must not be null. A group of one
    row scores 0; an empty table gives no row.

    Ranks meet the rows by group and value. Values that hold more than a thousandth of the rows,
    at most a thousand per statistic, are broadcast and their rows spread by the column row, so
    that no value, however common, comes together in one task.
    """
    ranks = cut(exact_ranks(stats, group, statistics), "ranks")
    limit = stats.count() // 1000
    out, score = stats, F.lit(0.0)
    for s in statistics:
        tail = F.least(F.lit(1.0), 2 * F.least("at_most", F.col("total") - F.col("at_most") + F.col("n")) / F.col("total"))
        one = ranks.filter(F.col("stat") == s).select(F.col("grp").alias("_g"), F.col("value").alias("_v"), tail.alias("_tail"), "n")
        same = (F.col(group) == F.col("_g")) & (F.col(s) == F.col("_v"))
        heavy = one.filter(F.col("n") > limit).select("_g", "_v", F.col("_tail").alias("_often"))
        light = one.filter(F.col("n") <= limit).select("_g", "_v", F.col("_tail").alias("_seldom"), F.lit(0).cast("bigint").alias("_z"))
        out = out.join(F.broadcast(heavy), same, "left").drop("_g", "_v").withColumn("_part", F.when(F.col("_often").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(row), F.lit(1000))))
        out = out.join(broadcast_if_small(light), same & (F.col("_part") == F.col("_z")), "left").drop("_g", "_v", "_z", "_part")
        out = out.withColumn(f"_{s}", F.coalesce("_often", "_seldom")).drop("_often", "_seldom")
        score = score - F.log(F.col(f"_{s}"))
    return out.withColumn("outlier_score", score).select(*stats.columns, "outlier_score")


def outliers(scored: DataFrame, least: float) -> DataFrame:
    """The rows whose scores lie at least so far out among those of their group: junk of any kind, and whatever else is unlike the rest."""
    return scored.filter(F.col("outlier_score") >= least)


def prose(scored: DataFrame) -> DataFrame:
    """The rows of natural prose, by the fixed bounds on the counts; scored as outlier_scores gives it."""
    bounds = "words >= 20 and n_chars >= 3 * words and n_chars <= 8 * words and n_symbols * 10 <= n_chars and n_ended * 10 >= n_lines and n_common * 4 >= words"
    return scored.filter(bounds)

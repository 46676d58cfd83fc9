"""What columns cost to store: decomposition, histograms, code lengths and the choice of codes."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import encoding


def decompose(df: DataFrame, columns: Mapping[str, Column], tags: str | None = "tags", most: int | None = None) -> DataFrame:
    """Rows (column, value): every field and every tag of a record, or of most records, as text; nulls as *. The form to write partitioned by column."""
    df = df if most is None else df.limit(most)
    cells = [F.struct(F.lit(n).alias("column"), F.coalesce(c.cast("string"), F.lit("*")).alias("value")) for n, c in columns.items()]
    out = F.array(*cells)
    if tags:
        none = F.array().cast("array<struct<column:string,value:string>>")
        out = F.concat(out, F.coalesce(F.transform(F.map_entries(tags), lambda e: F.struct(e["key"].alias("column"), F.coalesce(e["value"], F.lit("*")).alias("value"))), none))
    return df.select(F.inline(out))


def write_columns(cells: DataFrame, path: str) -> None:
    """One folder of text files per column of decomposed cells."""
    cells.select(F.col("column"), "value").write.partitionBy("column").option("compression", "gzip").text(path)


def column_sizes(cells: DataFrame, n_bases: int) -> DataFrame:
    """Rows (column, n_values, n_bytes, bits_per_base) of decomposed cells; a value takes its bytes and a separator."""
    size = F.sum(F.octet_length("value") + 1)
    return cells.groupBy("column").agg(F.count("*").alias("n_values"), size.alias("n_bytes")).withColumn("bits_per_base", F.col("n_bytes") * 8.0 / F.lit(max(n_bases, 1)))


def histogram(values: DataFrame) -> DataFrame:
    """Rows (series, value, n) from (series, value)."""
    return values.groupBy("series", "value").agg(F.count("*").alias("n"))


def code_costs(counts: DataFrame, codes: Mapping) -> DataFrame:
    """Rows (series, code, bits) over non-negative values (series, value, n)."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("code"), (cost(F.col("value")) * F.col("n")).alias("bits")) for name, cost in codes.items()]))
    return counts.select("series", each.alias("x")).groupBy("series", "x.code").agg(F.sum("x.bits").alias("bits"))


def beta_costs(counts: DataFrame) -> DataFrame:
    """Rows (series, code, bits) of the fixed-width code."""
    top = counts.groupBy("series").agg(F.max("value").alias("m"), F.sum("n").alias("n"))
    return top.select("series", F.lit("beta").alias("code"), (encoding.beta_width(F.col("m")) * F.col("n")).alias("bits"))


def huffman_lengths(weights: Iterable[int]) -> list[int]:
    """Code lengths for weights in their order: the two smallest are merged first, ties in order of entry. A single value needs no bit."""
    heap = [(w, i, (i,)) for i, w in enumerate(weights)]
    lengths = [0] * len(heap)
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            lengths[i] += 1
        heapq.heappush(heap, (a[0] + b[0], turn, a[2] + b[2]))
        turn += 1
    return lengths


def huffman_codes(counts: DataFrame, limit: int = encoding.DICTIONARY) -> DataFrame:
    """Rows (series, value, n, bits): dictionary code lengths of series with fewer than limit distinct values; others have none.

    Groups are bounded by limit. The total of n * bits doesn't depend on how ties are broken.
    """
    few = counts.join(counts.groupBy("series").agg(F.count("*").alias("_d")).filter(F.col("_d") < limit), "series").drop("_d")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("value")
        return pdf.assign(bits=huffman_lengths(pdf["n"].tolist()))

    return few.groupBy("series").applyInPandas(run, "series string, value bigint, n bigint, bits bigint")


def best_codes(counts: DataFrame) -> DataFrame:
    """Rows (series, code, bits): the cheapest of gamma and subexponential codes, the fixed-width code if it is cheaper, the dictionary code if that is cheaper still."""
    costs = code_costs(counts, encoding.CHOICES).unionByName(beta_costs(counts)).unionByName(huffman_codes(counts).groupBy("series").agg(F.lit("huffman").alias("code"), F.sum(F.col("n") * F.col("bits")).alias("bits")))
    rank = F.array_position(F.array(*[F.lit(c) for c in [*encoding.CHOICES, "beta", "huffman"]]), F.col("code"))
    return costs.groupBy("series").agg(F.min(F.struct("bits", rank.alias("rank"), "code")).alias("x")).select("series", "x.code", "x.bits")


def tag_sets(tags: DataFrame) -> DataFrame:
    """Rows (ids, n, idx): distinct sets of tag ids (key and type) in key order, with their number by length, then letters. tags: a map column tags; null is the empty set.

    The window runs over the distinct sets, a dictionary by nature.
    """
    none = F.array().cast("array<string>")
    ids = F.array_join(F.array_sort(F.coalesce(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.substring(F.coalesce(e["value"], F.lit("Z")), 1, 1))), none)), "")
    counts = tags.select(ids.alias("ids")).groupBy("ids").agg(F.count("*").alias("n"))
    return counts.withColumn("idx", (F.row_number().over(Window.orderBy(F.length("ids"), "ids")) - 1).cast("int"))


def pairs_descending(pairs: Column, first: str) -> Column:
    """An array of structs by falling values of its field first, ties as they stood."""
    keyed = F.transform(pairs, lambda x, i: F.struct((-x[first].cast("bigint")).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])

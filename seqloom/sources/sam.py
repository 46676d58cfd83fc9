"""SAM text: reader, writer and header tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The mandatory columns in their order.
COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
NUMBERS = {"flag", "pos", "mapq", "pnext", "tlen"}


def _tags(cells: Column) -> Column:
    """Cells key:type:value as a map key -> type:value; what has another form is left out, of equal keys the last counts."""
    fit = F.filter(cells, lambda c: c.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:"))
    pairs = F.transform(fit, lambda c: F.struct(F.substring(c, 1, 2).alias("key"), F.substring(c, F.lit(4), F.length(c)).alias("value")))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(first)


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """Record lines as rows: the mandatory columns, n_cells and tags. A cell that is missing or no number is null; sentinels stay as they are."""
    df = lines.filter(~F.col(line).startswith("@") & (F.col(line) != "")).withColumn("_c", F.split(line, "\t"))
    at = lambda i: F.get("_c", F.lit(i))
    cells = [(at(i).try_cast("int") if c in NUMBERS else at(i)).alias(c) for i, c in enumerate(COLUMNS)]
    return df.select(*cells, F.size("_c").alias("n_cells"), _tags(F.slice("_c", 12, F.greatest(F.size("_c") - 11, F.lit(0)))).alias("tags"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM files, plain or gzipped. A plain file is split among tasks, a gzipped one isn't."""
    return parse(spark.read.text(path))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Rows (kind, key, value, line): the header cells, e.g. SQ, SN, chr1; comments have the kind CO and key null."""
    lines = spark.read.text(path).filter(F.col("value").rlike("^@[A-Z][A-Z](\t|$)"))
    cells = F.split("value", "\t")
    comment = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.substring("value", F.lit(5), F.length("value")).alias("value")))
    named = F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.struct(F.substring_index(c, ":", 1).alias("key"), F.substring(c, F.lit(4), F.length(c)).alias("value")))
    kind = F.substring("value", 2, 2)
    return lines.select(kind.alias("kind"), F.col("value").alias("line"), F.when(kind == "CO", comment).otherwise(named).alias("_x")).select("kind", "line", F.inline("_x"))


def lines(reads: DataFrame, tags: str | None = "tags") -> Column:
    """A record as one line; nulls as the sentinel of their column, tags in key order."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c in NUMBERS else "*")) for c in COLUMNS]
    if tags:
        text = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
        cells.append(F.array_join(F.array_compact(text), "\t"))
    joined = F.concat_ws("\t", *cells)
    return F.regexp_replace(joined, "\t$", "")


def header_lines(contigs: DataFrame, groups: DataFrame | None = None, order: str = "unsorted") -> DataFrame:
    """Rows (place, value) of a header: contigs (sequence_id, name, length) and read groups (rg, sample, library, platform)."""
    spark = contigs.sparkSession
    top = spark.createDataFrame([(0, 0, f"@HD\tVN:1.6\tSO:{order}")], "part int, place bigint, value string")
    out = top.unionByName(contigs.select(F.lit(1).alias("part"), F.col("sequence_id").cast("bigint").alias("place"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), "length")).alias("value")))
    if groups is not None:
        cell = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c)))
        out = out.unionByName(groups.select(F.lit(2).alias("part"), F.row_number().over(Window.orderBy("rg")).cast("bigint").alias("place"), F.concat_ws("\t", F.lit("@RG"), cell("ID", "rg"), cell("SM", "sample"), cell("LB", "library"), cell("PL", "platform")).alias("value")))
    return out


def write_sam(reads: DataFrame, path: str, gzip: bool = False, header: DataFrame | None = None) -> None:
    """One text file per partition. header: rows (part, place, value) as header_lines gives them, which begin each file that has records; their size is that of a header."""
    body = reads.select(lines(reads).alias("value"))
    if header is not None:
        text = "\n".join(r["value"] for r in header.orderBy("part", "place", "value").collect())

        def with_header(batches):
            import pyarrow as pa

            begun = False
            for batch in batches:
                if not begun:
                    yield pa.RecordBatch.from_arrays([pa.array([text], batch.schema.field(0).type)], schema=batch.schema)
                    begun = True
                yield batch

        body = body.mapInArrow(with_header, "value string")
    body.write.option("compression", "gzip" if gzip else "none").text(path)

"""Validation rules as DataFrames of errors (type, row_id)."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import flags
from seqloom.functions.cigar import is_cigar, read_span
from seqloom.plans.shared import carried_forward, row_numbers


def _errors(df: DataFrame, **rules: Column) -> DataFrame:
    """A row for each rule, named by its type, that holds for a row of df."""
    return df.select(F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))).alias("type"), "row_id")


def read_groups(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Records without read group tag, or with one that the header lacks. A broadcast of the header's groups is bounded by the header."""
    own = F.regexp_extract(F.coalesce(F.col("tags")["RG"], F.lit("")), "^Z:(.*)$", 1)
    df = reads.select("row_id", own.alias("rg"))
    known = groups.select(F.col("rg").alias("_rg"), F.lit(True).alias("known")).distinct()
    df = df.join(known, F.col("rg") == F.col("_rg"), "left")
    return _errors(df, MISSING_READ_GROUP=F.col("rg") == "", READ_GROUP_NOT_FOUND=(F.col("rg") != "") & F.col("known").isNull())


def tag_values(reads: DataFrame) -> DataFrame:
    """Integer tags that no 32-bit type holds, once per record."""
    large = F.exists(F.map_values("tags"), lambda v: F.coalesce(F.startswith(v, F.lit("i:")) & F.coalesce((F.substring(v, 3, 40).try_cast("bigint") > 2**32 - 1) | (F.substring(v, 3, 40).try_cast("bigint") < -(2**31)), F.length(v) > 20), F.lit(False)))
    return _errors(reads, TAG_VALUE_TOO_LARGE=large)


def second_bases(reads: DataFrame) -> DataFrame:
    """E2 and U2 tags whose length differs from the read, and second bases that equal the first ones. A read without bases has length 0."""
    seq = F.coalesce(F.nullif(F.col("seq"), F.lit("*")), F.lit(""))
    value = lambda k: F.expr(f"substring(tags['{k}'], 3)")
    e2, u2 = value("E2"), value("U2")
    same = F.exists(F.arrays_zip(F.split(F.upper(seq), "").alias("a"), F.split(F.upper(e2), "").alias("b")), lambda x: x["a"].isNotNull() & (x["a"] == x["b"]) & ~x["a"].isin("N", ".", ""))
    return _errors(reads, MISMATCH_READ_LENGTH_AND_E2_LENGTH=F.length(e2) != F.length(seq), E2_BASE_EQUALS_PRIMARY_BASE=same, MISMATCH_READ_LENGTH_AND_U2_LENGTH=F.length(u2) != F.length(seq))


def cigars(reads: DataFrame) -> DataFrame:
    """Mapped records whose CIGAR is none, or doesn't fit their bases."""
    mapped = ~flags.has(F.col("flag"), "unmapped")
    ok = is_cigar(F.col("cigar"))
    return _errors(reads, INVALID_CIGAR=mapped & ~F.coalesce(ok, F.lit(False)), MISMATCH_READ_LENGTH_AND_CIGAR=mapped & ok & (F.col("seq") != "*") & (read_span(F.col("cigar")) != F.length("seq")))


def values(reads: DataFrame) -> DataFrame:
    """Fields outside their range."""
    unmapped = flags.has(F.col("flag"), "unmapped")
    return _errors(
        reads, INVALID_MAPPING_QUALITY=(F.col("mapq") < 0) | (F.col("mapq") > 255), MISMATCH_QUAL_AND_SEQ_LENGTH=(F.col("seq") != "*") & (F.col("qual") != "*") & (F.length("seq") != F.length("qual")),
        INVALID_FLAG_PROPER_PAIR=~flags.has(F.col("flag"), "paired") & flags.has(F.col("flag"), "proper_pair"), MAPPED_READ_WITHOUT_POSITION=~unmapped & ((F.coalesce("pos", F.lit(0)) <= 0) | (F.coalesce("rname", F.lit("*")) == "*")), MISSING_READ_NAME=F.coalesce("qname", F.lit("*")) == "*",
    )


def sort_order(reads: DataFrame, contigs: DataFrame, part: str = "file_id") -> DataFrame:
    """Records that come before their predecessor in the same part of the stream; the order is that of row_id, * and unknown names last."""
    ids = contigs.select(F.col("name").alias("_n"), "sequence_id").dropDuplicates(["_n"])
    key = F.struct(F.coalesce("sequence_id", F.lit(2**31 - 1)).alias("s"), F.coalesce("pos", F.lit(0)).alias("p"))
    df = reads.select("row_id", "rname", "pos", part).join(ids, F.col("rname") == F.col("_n"), "left").withColumn("key", key)
    df = carried_forward(df, [part], "row_id", F.max_by("key", "row_id"), F.lag("key"), F.last("v"))
    return _errors(df, RECORD_OUT_OF_ORDER=F.coalesce("_within", "_carried") > F.col("key"))


def nm_tags(reads: DataFrame, actual: DataFrame) -> DataFrame:
    """Mapped records without NM, or with one that differs from actual (row_id, nm)."""
    given = F.expr("try_cast(substring(tags['NM'], 3) as bigint)")
    df = reads.filter(~flags.has(F.col("flag"), "unmapped")).select("row_id", given.alias("given")).join(actual, "row_id", "left")
    return _errors(df, MISSING_TAG_NM=F.col("given").isNull(), INVALID_TAG_NM=F.col("given") != F.col("nm"))


def _paired(reads: DataFrame) -> DataFrame:
    flag = F.col("flag")
    return reads.filter(flags.has(flag, "paired") & ((flag.bitwiseAND(0x900)) == 0) & F.col("qname").isNotNull())


def mates(reads: DataFrame) -> DataFrame:
    """Primary paired records against their mate: of each name the first in the order of row_id with the second, the third anew. rnext = stands for the record's own rname."""
    ref = F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))
    fields = ["row_id", "flag", "rname", "pos", "ref", "pnext"]
    pairs = _paired(reads).withColumn("ref", ref).select("qname", *fields)
    # The name * may hold any number of rows.
    pairs = row_numbers(pairs, ["qname"], fields, F.shiftright("row_id", 16), "rn").withColumn("pair", F.expr("(rn - 1) div 2"))
    rec = F.struct(*fields)
    two = pairs.groupBy("qname", "pair").agg(F.count("*").alias("n"), F.min_by(rec, "rn").alias("a"), F.max_by(rec, "rn").alias("b")).filter("n = 2")

    def side(x: str, y: str) -> Column:
        of = lambda f, c: F.col(f"{x}.{f}").eqNullSafe(F.col(f"{y}.{c}"))
        bit = lambda f, c: flags.has(F.col(f"{x}.flag"), f) != flags.has(F.col(f"{y}.flag"), c)
        rules = {"MISMATCH_MATE_ALIGNMENT_START": ~of("pnext", "pos"), "MISMATCH_FLAG_MATE_NEG_STRAND": bit("mate_reverse", "reverse"), "MISMATCH_MATE_REF_INDEX": ~of("ref", "rname"), "MISMATCH_FLAG_MATE_UNMAPPED": bit("mate_unmapped", "unmapped")}
        if x == "a":
            rules["MATES_ARE_SAME_END"] = ~bit("first", "first")
        return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("type"), F.col(f"{x}.row_id").alias("row_id"))) for n, c in rules.items()]))

    return two.select(F.inline(F.concat(side("a", "b"), side("b", "a"))))


def unmatched(reads: DataFrame) -> DataFrame:
    """Primary paired records that mates leaves over: the last of each name with an odd number of such records."""
    return _paired(reads).groupBy("qname").agg(F.count("*").alias("n"), F.max("row_id").alias("row_id")).filter("n % 2 = 1").select(F.lit("MATE_NOT_FOUND").alias("type"), "row_id")


def header(contigs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (type, id) of the header: entries given twice, an empty dictionary, no read groups."""
    twice = lambda df, c, name: df.groupBy(F.col(c).cast("string").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("type"), "id")
    none = lambda df, name: df.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(name).alias("type"), F.lit("").alias("id"))
    return twice(contigs, "name", "DUPLICATE_SEQUENCE").unionByName(twice(groups, "rg", "DUPLICATE_READ_GROUP_ID")).unionByName(twice(groups.filter("platform is not null"), "barcode", "DUPLICATE_BARCODE")).unionByName(none(contigs, "MISSING_SEQUENCE_DICTIONARY")).unionByName(none(groups, "MISSING_READ_GROUPS"))


# The types that are warnings; others are errors. The versions a header may have.
WARNINGS = ("E2_BASE_EQUALS_PRIMARY_BASE", "MISSING_TAG_NM")
VERSIONS = ("1.0", "1.3", "1.4", "1.5", "1.6")


def header_cells(cells: DataFrame) -> DataFrame:
    """Rows (type, id) of header cells (kind, key, value) as they are read: no version, one that isn't known, programs given twice."""
    version = cells.filter("kind = 'HD' and key = 'VN'").agg(F.min("value").alias("id"))
    none = version.filter("id is null").select(F.lit("MISSING_VERSION_NUMBER").alias("type"), F.lit("").alias("id"))
    odd = version.filter(~F.col("id").isin(*VERSIONS)).select(F.lit("INVALID_VERSION_NUMBER").alias("type"), "id")
    twice = lambda kind, name: cells.filter((F.col("kind") == kind) & (F.col("key") == "ID")).groupBy(F.col("value").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(name).alias("type"), "id")
    return none.unionByName(odd).unionByName(twice("PG", "DUPLICATE_PROGRAM_GROUP_ID")).unionByName(twice("RG", "DUPLICATE_READ_GROUP_ID"))


def with_severity(errors: DataFrame) -> DataFrame:
    """errors with severity: warning or error."""
    return errors.withColumn("severity", F.when(F.col("type").isin(*WARNINGS), "warning").otherwise("error"))


def summary(errors: DataFrame, ignored: Collection[str] = (), warnings: bool = True) -> DataFrame:
    """Rows (type, n) without the ignored types, and without those that are warnings where warnings is false."""
    left_out = [*ignored, *(() if warnings else WARNINGS)]
    df = errors.filter(~F.col("type").isin(*left_out)) if left_out else errors
    return df.groupBy("type").agg(F.count("*").alias("n"))


def judged(errors: DataFrame, stringency: str, most: int = 100) -> DataFrame:
    """strict raises with the first errors if there are any, lenient gives them, silent gives none."""
    if stringency == "silent":
        return errors.limit(0)
    if stringency == "strict" and (first := errors.orderBy("type").limit(most).collect()):
        raise ValueError("; ".join(f"{r[0]} at {r[1]}" for r in first))
    return errors

"""Column builders: facts of the formats, and odd values."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import encoding, flags, quality, region, selector, sequence, tags
from seqloom.operators.storage import best_codes, huffman_codes, huffman_lengths
from seqloom.sources import masks


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("_")])
    return df.select(column.alias("x")).first()["x"]


def test_policy_text():
    assert quality.parse_policies("m999_8") == [quality.Policy(("lower", 999), (), "bin")]
    assert quality.parse_policies("R8-N40") == [quality.Policy(None, (("match", 0),), "bin"), quality.Policy(None, (("mismatch", 0),), "preserve")]
    assert quality.parse_policies("N40-D8")[0].bases == (("flanking_deletion", 0),)
    assert quality.parse_policies("m5") == [quality.Policy(("lower", 5), (), "preserve")]
    assert quality.parse_policies("R40X10") == [quality.Policy(None, (("match", 0), ("lower_coverage", 10)), "preserve")]
    assert quality.parse_policies("P3")[0].treatment == "drop" and quality.parse_policies("P3_40")[0].treatment == "preserve"
    assert [p.treatment for p in quality.parse_policies("N40-R8-U0")] == ["drop", "bin", "preserve"]
    assert quality.parse_policies("") == [] and quality.parse_policies("*40") == [quality.Policy(("all", 0), (), "preserve")]
    with pytest.raises(ValueError):
        quality.parse_policies("Z3")


def test_bins(spark):
    df = spark.range(45).select("id", quality.binned(F.col("id")).alias("a"), quality.binned(F.col("id"), quality.NCBI).alias("b"))
    got = {r["id"]: (r["a"], r["b"]) for r in df.collect()}
    assert [got[q][0] for q in (0, 1, 2, 9, 10, 19, 20, 24, 25, 29, 30, 34, 35, 39, 40, 44)] == [0, 1, 6, 6, 15, 15, 22, 22, 27, 27, 33, 33, 37, 37, 40, 40]
    assert [got[q][1] for q in (0, 1, 2, 3, 14, 15, 19, 20, 24, 25, 29, 30, 44)] == [0, 1, 2, 9, 9, 17, 17, 22, 22, 28, 28, 35, 35]


@pytest.mark.parametrize(
    ("spec", "fields", "tags", "but_fields", "but_tags"),
    [("*", set(), set(), True, True), ("SEQ", {"SEQ"}, set(), False, False), ("*:SEQ", {"SEQ"}, set(), True, True), ("*:SEQ:AM", {"SEQ"}, {"AM"}, True, True), ("*:SEQ/*:AM", {"SEQ"}, {"AM"}, True, True), ("SEQ:RNAME/*:NM:AM", {"SEQ", "RNAME"}, {"NM", "AM"}, False, True), ("SEQ:RNAME:NM:AM", {"SEQ", "RNAME"}, {"NM", "AM"}, False, False)],
)
def test_selectors(spec, fields, tags, but_fields, but_tags):
    assert selector.Selector.parse(spec) == selector.Selector(frozenset(fields), frozenset(tags), but_fields, but_tags)


def test_selector_errors():
    for bad in ("seq", "SEQ;POS", "SEQUENCE", "SEQ//NM"):
        with pytest.raises(ValueError):
            selector.Selector.parse(bad)


def test_regions():
    assert region.Region.parse("chr1") == region.Region("chr1", 0, region.END)
    assert region.Region.parse("chr1:5") == region.Region("chr1", 5, region.END)
    assert region.Region.parse("chr1:5-9") == region.Region("chr1", 5, 9)
    with pytest.raises(ValueError):
        region.Region.parse(":5-9")


def test_bins_of_intervals(spark):
    cases = {(0, 1): 4681, (16383, 16384): 4681, (16383, 16385): 585, (0, 1 << 17): 585, (0, (1 << 17) + 1): 73, (1 << 26, (1 << 26) + 1): 4681 + (1 << 12), (0, 1 << 29): 0}
    df = spark.createDataFrame(list(cases), "s int, e int").select("s", "e", region.bin_of(F.col("s"), F.col("e")).alias("b"))
    assert {(r["s"], r["e"]): r["b"] for r in df.collect()} == cases


def test_flags(spark):
    df = spark.createDataFrame([(f,) for f in (0, 99, 147, 4095)], "flag int").select("flag", *flags.unpack(F.col("flag")))
    rows = df.withColumn("all", flags.pack(list(flags.BITS))).withColumn("own", flags.pack(flags.OWN)).collect()
    assert [r["all"] for r in rows] == [r["flag"] for r in rows]
    assert [r["own"] for r in rows] == [0, 67, 147, 4095 - 8 - 32 - 2048]


def test_sequences(spark):
    assert one(spark, sequence.reverse_complement(F.lit("ACGTNacgtn*"))) == "*nacgtNACGT"
    assert one(spark, sequence.normalise(F.lit("acgtnRy="))) == "ACGTNNNN"
    assert one(spark, sequence.normalise(F.lit(None).cast("string"))) is None
    names = spark.createDataFrame([("1",), ("chr2",), ("M",), ("chrM",), ("CHR3",), ("zz",)], "name string")
    contigs = spark.createDataFrame([("chr1",), ("2",), ("MT",), ("3",)], "name string")
    assert {tuple(r) for r in sequence.resolve_names(names, contigs).collect()} == {("1", "chr1"), ("chr2", "2"), ("M", "MT"), ("chrM", "MT"), ("CHR3", "3"), ("zz", None)}


def test_costs(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 3, 4, 20, 255, 9999)], "v bigint")
    got = {r["v"]: r for r in df.select("v", encoding.golomb_rice(F.col("v"), 2).alias("gr"), encoding.gamma(F.col("v")).alias("g"), encoding.subexponential(F.col("v"), 2).alias("s"), encoding.golomb(F.col("v"), 4).alias("go"), encoding.itf8(F.col("v")).alias("i"), encoding.ltf8(F.col("v")).alias("l")).collect()}
    assert [got[v]["gr"] for v in (0, 1, 20, 255)] == [3, 3, 8, 66] and all(got[v]["gr"] == v // 4 + 3 == got[v]["go"] for v in got)
    assert [got[v]["g"] for v in (0, 1, 3, 4)] == [1, 3, 5, 5]
    assert [got[v]["s"] for v in (0, 3, 4, 20)] == [3, 3, 4, 8]
    assert [got[v]["i"] for v in (4, 255, 9999)] == [8, 16, 16] == [got[v]["l"] for v in (4, 255, 9999)]
    assert one(spark, encoding.itf8(F.lit(-1))) == 40 and one(spark, encoding.ltf8(F.lit(-1))) == 72 and one(spark, encoding.itf8(F.lit(1 << 28))) == 40
    assert [one(spark, encoding.beta_width(F.lit(v))) for v in (0, 1, 2, 3, 4, 255, 256)] == [0, 1, 2, 2, 3, 8, 9]


def test_dictionary_codes(spark):
    assert huffman_lengths([]) == [] and huffman_lengths([7]) == [0] and huffman_lengths([1, 1]) == [1, 1]
    assert sorted(huffman_lengths([1, 1, 2, 4])) == [1, 2, 3, 3]
    counts = spark.createDataFrame([("a", 5, 10), ("b", 0, 1), ("b", 1, 1), ("b", 2, 6)] + [("c", v, 1) for v in range(300)], "series string, value bigint, n bigint")
    codes = {(r["series"], r["value"]): r["bits"] for r in huffman_codes(counts).collect()}
    assert codes == {("a", 5): 0, ("b", 0): 2, ("b", 1): 2, ("b", 2): 1}
    best = {r["series"]: (r["code"], r["bits"]) for r in best_codes(counts).collect()}
    assert best["a"] == ("huffman", 0) and best["b"] == ("huffman", 10) and best["c"] == ("beta", 2700)


def test_tags(spark):
    cases = {-(2**31) - 1: None, -(2**31): "i", -32769: "i", -32768: "s", -129: "s", -128: "c", 127: "c", 128: "C", 255: "C", 256: "s", 32767: "s", 32768: "S", 65535: "S", 65536: "i", 2**31 - 1: "i", 2**31: "I", 2**32 - 1: "I", 2**32: None}
    df = spark.createDataFrame([(v,) for v in cases], "v bigint").select("v", tags.integer_type(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == cases
    number = tags.id_number(F.lit("OQ"), F.lit("Z"))
    assert one(spark, number) == (ord("O") << 16 | ord("Q") << 8 | ord("Z")) and one(spark, tags.id_text(number)) == "OQZ"


def test_masks(spark):
    assert one(spark, masks.parse_positions(F.lit("12 40 77"))) == [12, 40, 77] and one(spark, masks.parse_positions(F.lit("12 x"))) == [12] and one(spark, masks.parse_positions(F.lit(""))) == []
    assert one(spark, masks.parse_marks(F.lit("__x__x"))) == [3, 6] and one(spark, masks.dense(masks.parse_marks(F.lit("__x_")))) == [0, 0, 1]
    assert one(spark, masks.is_masked(F.array(F.lit(3)), F.lit(3))) is True and one(spark, masks.dense(F.array().cast("array<int>"))) == []

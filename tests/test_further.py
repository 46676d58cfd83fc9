"""Headers, severities, dumps and other smaller operators: odd cases and empty tables."""

import pytest
from pyspark.sql import functions as F

from seqloom.functions import quality
from seqloom.operators import alignment as al
from seqloom.operators import compare, edits, index, merge, storage, validate
from seqloom.plans import shared
from seqloom.sources import codecs as c
from seqloom.sources import masks


def test_header_cells(spark):
    cells = lambda rows: spark.createDataFrame(rows, "kind string, key string, value string")
    got = lambda rows: sorted(map(tuple, validate.header_cells(cells(rows)).collect()))
    assert got([("HD", "VN", "1.6"), ("PG", "ID", "a"), ("PG", "ID", "b"), ("RG", "ID", "a")]) == []
    assert got([("HD", "VN", "7"), ("PG", "ID", "a"), ("PG", "ID", "a"), ("RG", "ID", "r"), ("RG", "ID", "r"), ("CO", None, "a")]) == [("DUPLICATE_PROGRAM_GROUP_ID", "a"), ("DUPLICATE_READ_GROUP_ID", "r"), ("INVALID_VERSION_NUMBER", "7")]
    assert got([]) == [("MISSING_VERSION_NUMBER", "")]


def test_severities_and_stringency(spark):
    errors = spark.createDataFrame([("MISSING_TAG_NM", 1), ("INVALID_CIGAR", 2), ("INVALID_CIGAR", 3)], "type string, row_id bigint")
    assert {(r["type"], r["severity"]) for r in validate.with_severity(errors).collect()} == {("MISSING_TAG_NM", "warning"), ("INVALID_CIGAR", "error")}
    assert {tuple(r) for r in validate.summary(errors, warnings=False).collect()} == {("INVALID_CIGAR", 2)}
    assert validate.summary(errors, ["INVALID_CIGAR"], False).count() == 0
    assert validate.judged(errors, "silent").count() == 0 and validate.judged(errors, "lenient").count() == 3
    with pytest.raises(ValueError, match="INVALID_CIGAR at 2$|INVALID_CIGAR at 3$"):
        validate.judged(errors, "strict", most=1)
    assert validate.judged(errors.limit(0), "strict").count() == 0


def test_header_merge(spark):
    schema = "source int, name string, kind string, id string, place bigint, value string"
    lines = spark.createDataFrame([(1, "b", "SQ", "x", 1, "x later"), (0, "a", "SQ", "x", 9, "x first"), (1, "b", "SQ", "y", 0, "y"), (0, "a", "CO", None, 1, "same"), (1, "b", "CO", None, 1, "same")], schema)
    got = sorted(map(tuple, merge.merge_header_lines(lines).collect()))
    assert got == [(1, 1, "x first"), (1, 2, "y"), (4, 1, "same"), (4, 2, "same"), (5, 1, "@CO\tMerged from: a b")]
    assert merge.merge_header_lines(lines.limit(0)).count() == 0


def test_dump(spark):
    schema = "id bigint, qname string, v int, tags map<string,string>, counter int"
    a = spark.createDataFrame([(1, "x", 5, {"A": "1", "B": "2"}, 0), (2, None, 7, None, 0)], schema)
    b = spark.createDataFrame([(10, "x", 6, {"B": "3"}, 0)], schema)
    got = {(r["counter"], r["field"], r["tag"], r["premature"], r["value1"], r["value2"], r["name1"], r["name2"]) for r in compare.dump(a, b, "id", ["qname", "v"]).collect()}
    assert got == {(1, "v", None, 0, "5", "6", "x", "x"), (1, "TAG", "A", 0, "1", "!NULL!", "x", "x"), (1, "TAG", "B", 0, "2", "3", "x", "x"), (2, "PREMATURE", None, 2, None, None, None, None)}
    assert compare.dump(b, a, "id", ["v"]).filter("premature = 1").first()["record2"] == "2\t7"
    assert compare.dump(a.limit(0), b.limit(0), "id", ["v"]).count() == 0


def test_kept_scores(spark):
    df = spark.createDataFrame([(1, False, [-1, 7, 40]), (2, True, [5]), (3, False, []), (4, False, None), (5, False, [-1])], "row_id bigint, forced boolean, scores array<int>")
    assert sorted(map(tuple, quality.kept_as_features(df).collect())) == [(1, 2, "Q", "7", 1), (1, 3, "Q", "40", 1)]
    assert quality.kept_as_features(df.limit(0)).count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([(1, [(3, 1), (9, 2), (3, 0)]), (2, []), (3, None)], "i int, p array<struct<a:int,b:int>>")
    assert {r["i"]: r["x"] and [tuple(y) for y in r["x"]] for r in df.select("i", storage.pairs_descending(F.col("p"), "a").alias("x")).collect()} == {1: [(9, 2), (3, 1), (3, 0)], 2: [], 3: None}


def test_random_checks_miss_nothing_and_tell_what_is_missing(spark):
    idx = spark.createDataFrame([(1, 10, 5, 1, 1, 0), (1, 40_000, 10, 2, 1, 0)], "sequence_id int, alignment_start int, alignment_span int, container_start_offset bigint, slice_offset int, slice_size int")
    records = spark.createDataFrame([(1, 10, 12), (1, 11, 14), (1, 11, 14), (1, 40_000, 40_009), (1, 5, 10), (2, 10, 12)], "sequence_id int, pos int, end int")
    places = spark.createDataFrame([(0, 1, 12), (1, 1, 40_001), (2, 1, 20_000), (3, 2, 11), (4, 1, 10)], "region int, sequence_id int, at bigint")
    got = {r["region"]: tuple(r)[1:] for r in index.random_checks(idx, records, places).collect()}
    assert got == {0: (1, 3, 0), 1: (1, 1, 0), 2: (0, 0, 0), 3: (0, 1, 1), 4: (1, 2, 1)}
    assert index.random_checks(idx.limit(0), records.limit(0), places.limit(0)).count() == 0


def test_md5_of_ranges(spark):
    import hashlib

    ref = "ACGTTGCAAC" * 300
    chunks = al.chunks_of(spark.createDataFrame([("c", ref)], "rname string, seq string"))
    ranges = spark.createDataFrame([(1, "c", 1, 4), (2, "c", 1020, 2060), (3, "c", 5, 5), (4, "c", None, None), (5, "d", 1, 3), (6, "c", 2999, 3003)], "k int, rname string, s bigint, e bigint")
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert {r["k"]: r["md5"] for r in al.range_md5(ranges, chunks, ["k"]).collect()} == {1: md5(ref[:3]), 2: md5(ref[1019:2059]), 3: "0" * 32, 4: "0" * 32, 5: md5("NN"), 6: md5(ref[2998:] + "NN")}


def test_masks_by_first_line(spark, tmp_path):
    for name, text, want in (("a", "3 7\n\n12\n", [[3, 7], [], [12]]), ("b", "__x\nx_x\n", [[3], [1, 3]]), ("c", "", [])):
        (tmp_path / name).write_text(text)
        assert [r["mask"] for r in masks.read_masks(spark, str(tmp_path / name)).orderBy("line_no").collect()] == want
    assert [r["mask"] for r in masks.read_masks(spark, str(tmp_path / "b"), form="marks").orderBy("line_no").collect()] == [[3], [1, 3]]


def test_forward_window_over_blocks(spark):
    rows = [(i, "c", p) for i, p in [(1, 5), (70_000, 3), (70_001, 9), (200_000, 1), (200_001, None)]] + [(5, None, 4), (6, None, 1)]
    df = spark.createDataFrame(rows, "row_id bigint, rname string, pos int")
    assert {r["row_id"]: (r["base"], r["in_window"]) for r in edits.forward_window(df, "row_id", 5).collect()} == {1: (5, 1), 70_000: (5, 1), 70_001: (9, 1), 200_000: (9, 0), 200_001: (9, None), 5: (4, 1), 6: (4, 1)}
    contigs = spark.createDataFrame([("c", 0)], "name string, sequence_id int")
    assert [r["row_id"] for r in validate.sort_order(df.withColumn("file_id", F.lit("f")), contigs).collect()] != []
    assert edits.forward_window(df.limit(0), "row_id", 5).count() == 0


def test_null_code_reads_nothing():
    for kind, empty in (("int", 0), ("byte", 0), ("array", b"")):
        assert c.reader(c.NULL, b"", c.BitReader(b""), {}, kind)() == empty


@pytest.mark.parametrize("limit", [-1, 1 << 20])
def test_attach_by_broadcast_and_by_spread_rows(spark, limit, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    df = spark.createDataFrame([(k, v) for k in ["hot", None, "x"] for v in range(50)], "k string, v int")
    facts = spark.createDataFrame([("hot", 1), (None, 2), ("y", 3)], "k string, f int")
    assert sorted((str(r["k"]), r["v"], r["f"]) for r in shared.attach(df, facts, ["k"], ["v"]).collect()) == sorted([("hot", v, 1) for v in range(50)] + [("None", v, 2) for v in range(50)])


def test_scratch_is_removed_at_the_end_of_its_scope(spark):
    with shared.scratch_scope(spark):
        df = shared.cut(spark.range(5), "scoped")
        path = df.inputFiles()[0]
        assert df.count() == 5
    from seqloom.sources import files

    assert not files.exists(path)

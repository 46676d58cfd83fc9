"""Base-level operators on small reads, with nulls, ties, long reads and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import quality
from seqloom.operators import alignment as al
from seqloom.operators import compare, index, merge, pairing

READ = "row_id bigint, qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, ref string, op string, n int"
REF = "ACGTTGCAAC" * 400


def reads(spark, data):
    return spark.createDataFrame([(i, f"q{i}", 0, r, p, 30, c, s, None, "x", "y", 9) for i, (r, p, c, s) in enumerate(data)], READ)


def chunks(spark, *size):
    return al.chunks_of(spark.createDataFrame([("c", REF)], "rname string, seq string"), *size)


def with_ref(spark, data, size=64, overlap=40):
    return al.with_reference(al.placed(reads(spark, data)), chunks(spark, size, overlap), size, overlap)


def made(rng):
    ops, seq, pos = [], [], rng.randrange(1, 300)
    at = pos
    for op, n in [("S", rng.randrange(3)), ("M", rng.randrange(1, 9)), ("I", rng.randrange(3)), ("M", rng.randrange(1, 5)), ("D", rng.randrange(3)), ("X", rng.randrange(1, 4)), ("N", rng.randrange(5)), ("=", rng.randrange(1, 80)), ("H", rng.randrange(2))]:
        if n == 0:
            continue
        ops.append(f"{n}{op}")
        if op in "M=X":
            seq += [c if rng.random() < 0.8 else rng.choice("ACGTNr") for c in REF[at - 1 : at - 1 + n]]
        elif op in "IS":
            seq += rng.choices("ACGTacgt", k=n)
        at += n if op in "MDN=X" else 0
    return "c", pos, "".join(ops), "".join(seq)


def brute(pos, cigar, seq):
    import re

    md, run, nm, at, i = "", 0, 0, pos - 1, 0
    for n, op in ((int(n), o) for n, o in re.findall(r"(\d+)(.)", cigar)):
        if op in "M=X":
            for k in range(n):
                if seq[i + k].upper() == REF[at + k]:
                    run += 1
                else:
                    md, run, nm = md + f"{run}{REF[at + k]}", 0, nm + 1
        elif op == "D":
            md, run = md + f"{run}^{REF[at : at + n]}", 0
        nm += n if op in "ID" else 0
        at += n if op in "MDN=X" else 0
        i += n if op in "MIS=X" else 0
    return md + str(run), nm


def test_md_nm_and_restoration(spark):
    rng = random.Random(1)
    data = [made(rng) for _ in range(80)] + [("c", 3990, "20M", "A" * 20), ("d", 1, "4M", "ACGT"), ("c", 1, f"{3000}M", REF[:3000])]
    df = with_ref(spark, data).cache()
    got = {r["row_id"]: (r["md"], r["nm"]) for r in al.md_and_nm(df).collect()}
    for i, (name, p, c, s) in enumerate(data):
        if name == "c" and p < 3990:
            assert got[i] == brute(p, c, s), (p, c, s)
    assert got[81] == ("0N0N0N0N0", 4)
    back = {r["row_id"]: r for r in al.restored(al.features(df)).collect()}
    assert all(back[i]["seq"] == s.upper() for i, (*_, s) in enumerate(data))
    assert back[82]["cigar"] == "3000M"
    df.unpersist()


def test_unplaced_and_malformed_are_left_out(spark):
    bad = [(None, 1, "1M", "A"), ("*", 1, "1M", "A"), ("c", 0, "1M", "A"), ("c", None, "1M", "A"), ("c", 1, "*", "A"), ("c", 1, None, "A"), ("c", 1, "2M", "A"), ("c", 1, "1M", "*"), ("c", 1, "1M", None), ("c", 1, "1Mx", "A"), ("c", 1, "1M", "")]
    assert al.placed(reads(spark, bad)).count() == 0
    df = with_ref(spark, bad)
    assert al.pileup(al.placed(reads(spark, bad)), chunks(spark)).count() == 0 and al.md_and_nm(df).count() == 0 and al.coverage_runs(df).count() == 0
    assert {r["n"] for r in al.substitution_counts(df).collect()} == {0}


def test_coverage_and_pileup(spark):
    data = [("c", 1, "4M", "ACGT"), ("c", 3, "4M", "GTTT"), ("c", 3, "4M", "GTTT"), ("c", 70000, "2M", "AA"), ("c", 140000, "1M", "C")]
    df = with_ref(spark, data)
    assert sorted(tuple(r) for r in al.coverage_runs(df).collect()) == [("c", 1, 2, 1), ("c", 3, 4, 3), ("c", 5, 6, 2), ("c", 70000, 70001, 1), ("c", 140000, 140000, 1)]
    df = al.placed(reads(spark, data))
    piles = {(r["refpos"], r["refb"]): (r["a"], r["c"], r["g"], r["t"]) for r in al.pileup(df, chunks(spark), most=1).collect()}
    assert piles[3, "G"] == (0, 0, 1, 0) and piles[6, "G"] == (0, 0, 0, 1) and piles[140000, "N"] == (0, 1, 0, 0)
    assert {r["refpos"] for r in al.should_store(al.pileup(df, chunks(spark)), 2).collect()} == {6}


@pytest.mark.parametrize("hot", [0, 3, 50_000])
def test_pileup_of_hot_chunks(spark, hot, monkeypatch):
    """Counted before or after the shuffle, across the ends of chunks, bases come out alike."""
    rng = random.Random(8)
    data = [(n, p + rng.choice([0, 900, 2000]), c, s) for n, p, c, s in (made(rng) for _ in range(60))]
    want = {}
    for _, p, c, s in data:
        at, i = p, 0
        for n, op in ((int(x[:-1]), x[-1]) for x in __import__("re").findall(r"\d+.", c)):
            for k in range(n if op in "M=X" else 0):
                want.setdefault(at + k, []).append(s[i + k].upper())
            at += n if op in "MDN=X" else 0
            i += n if op in "MIS=X" else 0
    monkeypatch.setattr(al, "HOT", hot)
    df = al.placed(reads(spark, data))
    got = {r["refpos"]: (r["refb"], r["a"], r["c"], r["g"], r["t"]) for r in al.pileup(df, chunks(spark)).collect()}
    assert got == {p: (REF[p - 1], *(min(15, v.count(b)) for b in "ACGT")) for p, v in want.items()}
    wrong = {p: sum(b != REF[p - 1] for b in v) for p, v in want.items()}
    assert {r["refpos"]: r["n"] for r in al.mismatches(df, chunks(spark)).collect()} == {p: n for p, n in wrong.items() if n}


def test_substitution_codes(spark):
    counts = spark.createDataFrame([("A", "C", 5), ("A", "G", 9), ("A", "T", 5), ("A", "N", 0)], "refb string, base string, n bigint")
    codes = al.substitution_codes(counts)
    assert {r["base"]: r["code"] for r in codes.collect()} == {"G": 0, "C": 1, "T": 2, "N": 3}
    packed = al.pack_codes(codes)
    assert packed.first()["packed"] == 1 << 6 | 0 << 4 | 2 << 2 | 3
    assert {r["base"]: r["code"] for r in al.unpack_codes(packed).collect()} == {"G": 0, "C": 1, "T": 2, "N": 3}


def test_prefix_tracks_grow_with_the_batch(spark):
    rng = random.Random(5)
    data = sorted((made(rng) for _ in range(60)), key=lambda x: x[1]) + [("d", 9, "2M", "AC")]
    df = with_ref(spark, data).withColumn("batch", F.expr("row_id div 25")).withColumn("rn", F.col("row_id") + 1)
    cover, wrong, want = {}, {}, {}
    for i, (name, p, c, s) in enumerate(data):
        at, k = p, 0
        for n, op in ((int(x[:-1]), x[-1]) for x in __import__("re").findall(r"\d+.", c)):
            for j in range(n):
                here = (name, i // 25, at + j)
                if op in "MDN=X":
                    cover[here] = cover.get(here, 0) + 1
                if op in "M=X" and s[k + j].upper() != (REF[at + j - 1] if name == "c" else "N"):
                    wrong[here] = wrong.get(here, 0) + 1
            at += n if op in "MDN=X" else 0
            k += n if op in "MIS=X" else 0
        places = [(name, i // 25, p + j) for j in range(len(s))]
        want[i] = ([cover.get(x, 0) for x in places], [wrong.get(x, 0) for x in places], s.upper())
    assert {r["row_id"]: (r["coverage"], r["mismatches"], r["seq"]) for r in al.prefix_tracks(df, "seq").collect()} == want
    assert al.prefix_tracks(df.limit(0)).count() == 0


def test_groups_cut_anywhere():
    import pyarrow as pa

    rows = [("a", 1)] * 3 + [("a", 2)] + [("b", 2)] * 2
    for cut in range(len(rows) + 1):
        parts = [pa.RecordBatch.from_pylist([{"k": k, "j": j} for k, j in x], schema=pa.schema([("k", pa.string()), ("j", pa.int64())])) for x in (rows[:cut], rows[cut:])]
        assert [t.num_rows for t in al._groups(iter(parts), ["k", "j"])] == [3, 1, 2]


def test_policy_on_unplaced_read(spark):
    df = spark.createDataFrame([(1, 4, None, [2, 41], None, None, None, None), (2, 0, 3, [2, 41], None, None, None, None)], f"row_id bigint, flag int, mapq int, q array<int>, pos int, seq string, ref string, ops array<{al.OP}>")
    got = {r["row_id"]: (r["scores"], r["forced"], r["restored"]) for r in quality.apply_policies(df, quality.parse_policies("U40-N40-m5_8")).collect()}
    assert got[1] == ([2, 41], True, [2, 41]) and got[2] == ([6, 40], True, [6, 40])


def test_mates_in_a_batch(spark):
    names = ["a", "b", "a", "a", None, None, "b", "a", "c"]
    df = spark.createDataFrame([(i, n, "c", 10 + i) for i, n in enumerate(names)], "row_id bigint, qname string, rname string, pos int")
    mates = pairing.batch_mates(pairing.batched(df, 100), ["row_id", "rn"])
    assert {r["row_id"]: r["mate_row_id"] for r in mates.collect()} == {0: 2, 2: 0, 1: 6, 6: 1, 3: 7, 7: 3, 4: None, 5: None, 8: None}
    assert {r["row_id"]: r["batch"] for r in pairing.batched(df, 4).collect()}[8] == 2
    assert pairing.batch_mates(pairing.batched(df.limit(0), 4), ["rn"]).count() == 0


def test_compare_streams(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, None, 7), (3, "z", 1)], "id bigint, s string, v int")
    b = spark.createDataFrame([(10, "x", 6), (20, None, 17)], "id bigint, s string, v int")
    got = sorted(tuple(r) for r in compare.compare_streams(a, b, "id", ["s", "v"], tolerance={"v": 2}).collect())
    assert got == [(2, "v", "7", "17"), (3, "PREMATURE", "!NULL!", "!NULL!")]
    assert compare.compare_streams(a.limit(0), b.limit(0), "id", ["s"]).count() == 0
    tags = spark.range(1).select(compare.compare_tags(F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("2")), F.create_map(F.lit("B"), F.lit("3"), F.lit("C"), F.lit("4")), ignored=["C"]).alias("t"))
    assert tags.first()["t"] == ["A", "B"]


def test_merge_order_and_collisions(spark):
    df = spark.createDataFrame([(1, "c", 5, 1), (2, "c", 5, 0), (3, "c", 2, 1), (4, "*", 0, 0), (5, None, None, 1)], "row_id bigint, rname string, pos int, source int")
    assert [r["row_id"] for r in merge.merged_order(df).orderBy("rname", "ord").collect()] == [4, 5, 3, 2, 1]
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "source int, id string")
    assert {r["source"]: r["id"] for r in merge.resolve_collisions(ids).collect()} == {0: "a1", 1: "b", 2: "a2"}


@pytest.mark.parametrize("start,end,found", [(1, 1, [1]), (2, 2, [1, 2]), (3, 3, [2, 3]), (5, 9, []), (1, 50_000, [1, 2, 3, 40_000])])
def test_find_slices(spark, start, end, found):
    idx = spark.createDataFrame([(1, 1, 2, 1, 1, 0), (1, 2, 2, 2, 1, 0), (1, 3, 2, 3, 1, 0), (1, 40_000, 9, 4, 1, 0), (2, 1, 9, 5, 1, 0)], "sequence_id int, alignment_start int, alignment_span int, container_start_offset bigint, slice_offset int, slice_size int")
    r = spark.createDataFrame([(1, 1, start, end)], "region int, sequence_id int, start bigint, end bigint")
    assert sorted(x["alignment_start"] for x in index.find_slices(idx, r).collect()) == found


def test_linear_index_fills(spark):
    idx = spark.createDataFrame([(1, 20_000, 10, 100), (1, 60_000, 10, 200)], "sequence_id int, alignment_start int, alignment_span int, container_start_offset bigint")
    assert [(r["window"], r["offset"]) for r in index.linear_index(idx).orderBy("window").collect()] == [(0, 0), (1, 100), (2, 100), (3, 200)]

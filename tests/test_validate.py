"""Validation rules against brute force."""

import random
from collections import Counter

from seqloom.operators import validate
from seqloom.plans import stored


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


PAIRED = "row_id bigint, qname string, flag int, rname string, pos int, rnext string, pnext int"


def brute_mates(data):
    waiting, errors = {}, []
    for r in sorted(data):
        _, name, flag, *_ = r
        if name is None or not flag & 1 or flag & 0x900:
            continue
        if name not in waiting:
            waiting[name] = r
            continue
        a, b = waiting.pop(name), r
        for x, y in ((a, b), (b, a)):
            ref = x[3] if x[5] == "=" else x[5]
            wrong = {"MISMATCH_MATE_ALIGNMENT_START": x[6] != y[4], "MISMATCH_FLAG_MATE_NEG_STRAND": (x[2] & 32 > 0) != (y[2] & 16 > 0), "MISMATCH_MATE_REF_INDEX": ref != y[3], "MISMATCH_FLAG_MATE_UNMAPPED": (x[2] & 8 > 0) != (y[2] & 4 > 0)}
            errors += [(n, x[0]) for n, is_wrong in wrong.items() if is_wrong]
        if a[2] & 64 == b[2] & 64:
            errors.append(("MATES_ARE_SAME_END", a[0]))
    return errors, [("MATE_NOT_FOUND", r[0]) for r in waiting.values()]


def test_mates_of_repeated_names(spark):
    rng = random.Random(5)
    names = [f"q{i}" for i in range(120)] + ["*"] * 60 + [None]
    ids = rng.sample(range(1 << 20), 500)
    data = [(i, rng.choice(names), rng.choice([99, 147, 83, 163, 77, 141, 0, 99 + 256, 147 + 2048]), rng.choice(["a", "b"]), rng.choice([5, 6]), rng.choice(["=", "a", "*"]), rng.choice([5, 6])) for i in ids]
    df = spark.createDataFrame(data, PAIRED)
    errors, left = brute_mates(data)
    assert rows(validate.mates(df)) == sorted(errors, key=repr)
    assert rows(validate.unmatched(df)) == sorted(left, key=repr)
    assert validate.mates(df.limit(0)).count() == validate.unmatched(df.limit(0)).count() == 0


def test_summary_over_all_rules(spark, tmp_path):
    def read(i, cigar="4M", seq="ACGT", flag=0, **tags):
        return (i, f"q{i}", flag, "c", 10, 60, cigar, "*", 0, 0, seq, "*" if seq in (None, "*") else "IIII", {"RG": "Z:g", **tags}, "g", "f")

    data = [
        read(1, NM="i:99"), read(2), read(3, flag=4), read(4, NM="i:98", E2="Z:TGCAT", U2="Z:III"), read(5, NM="i:97", E2="Z:TCNA"),
        read(6, seq="*", NM="i:0", E2="Z:*", U2="Z:I"), read(7, seq=None, NM="i:0", U2="Z:"), read(8, flag=4, E2="Z:NNNN", U2="Z:IIII"),
    ]
    schema = "row_id bigint, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>, rg string, file_id string"
    tables = {"reads": spark.createDataFrame(data, schema), "contigs": spark.createDataFrame([(0, "c", 100)], "sequence_id int, name string, length bigint"), "read_groups": spark.createDataFrame([("g",)], "rg string")}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    want = Counter(MISSING_TAG_NM=1, INVALID_TAG_NM=3, MISMATCH_READ_LENGTH_AND_E2_LENGTH=2, MISMATCH_READ_LENGTH_AND_U2_LENGTH=2, E2_BASE_EQUALS_PRIMARY_BASE=1)
    assert {r["type"]: r["n"] for r in stored.validate_summary(spark, str(tmp_path)).collect()} == want

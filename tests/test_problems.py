"""The general data problems: brute force on small random data, and defined results of the odd cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions.cigar import is_cigar, reference_span
from seqloom.operators.differences import copy_differences
from seqloom.operators.hotkeys import heavy_keys, key_profile
from seqloom.operators.intervals import stretches_and_gaps
from seqloom.operators.orphans import orphan_references

SIDE = "id bigint, a string, b int, v timestamp_ntz, key string, node int"
T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def diff(spark, left, right):
    return rows(copy_differences(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), "id", ["a", "b"], ("l", "r"), (None, "v"), leaf_bits=2, fan_bits=2))


def test_differences_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("xyz"), rng.choice([1, None]), T0, "k", 1) for i in range(-150, 300) if rng.random() < 0.9]
    right = [(i, a if rng.random() < 0.9 else None, b if rng.random() < 0.9 else 2, T0, "k", 1) for i, a, b, *_ in left if rng.random() < 0.9] + [(1000, "q", 1, T0, "k", 1)]
    a, b = ({r[0]: r for r in side} for side in (left, right))
    want = [(i, "missing_in_r") for i in a.keys() - b.keys()] + [(i, "missing_in_l") for i in b.keys() - a.keys()]
    want += [(i, f) for i in a.keys() & b.keys() for f, k in (("a", 1), ("b", 2)) if a[i][k] != b[i][k]]
    assert diff(spark, left, right) == sorted(want, key=repr)


def test_differences_versions_nulls_and_empty(spark):
    one = (1, "x", None, T0, "k", 1)
    later = (1, "x", None, T0 + dt.timedelta(1), "other", 2)
    old = (1, "old", 5, T0, "k", 1)
    assert diff(spark, [one], [old, later, later]) == []
    assert diff(spark, [one, one], [old]) == [(1, "a"), (1, "b")]
    assert diff(spark, [], []) == []
    assert diff(spark, [one], []) == [(1, "missing_in_r")]
    assert diff(spark, [], [one, (None, "n", 1, T0, "k", 1)]) == [(1, "missing_in_l"), (None, "missing_in_l")]
    assert diff(spark, [(None, "n", 1, T0, "k", 1)], [(None, "", 1, T0, "k", 1)]) == [(None, "a")]
    long = "A" * 300_000
    assert diff(spark, [(1, long, 1, T0, "", 1)], [(1, long + "B", 1, T0, "", 1)]) == [(1, "a")]


REF = "row_id bigint, name string, at int, t timestamp_ntz, own boolean, extra string"
TARGET = "row_id bigint, name string, at int, t timestamp_ntz, until timestamp_ntz, extra string"


def hours(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def test_orphans_against_brute_force(spark):
    rng = random.Random(2)
    targets = [(i, rng.choice("abc"), rng.randrange(6), hours(rng.choice([None, *range(0, 100, 7)])), None, "x") for i in range(60)]
    refs = [(r, n, a, hours(rng.choice([None, *range(0, 100, 5)])), True, "y") for r, n, a, *_ in targets[:30]]
    refs += [(100 + i, rng.choice("abcd"), rng.randrange(7), hours(rng.choice([None, *range(0, 100, 5)])), False, "y") for i in range(80)]
    want = []
    for r, n, a, t, _, _ in refs:
        others = [u[3] for u in targets if (u[1], u[2]) == (n, a) and u[0] != r]
        if not others:
            want.append((r, "missing"))
        elif t is not None and all(o is not None and o > t for o in others):
            want.append((r, "later"))
    got = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TARGET), ["name", "at"], 200)
    assert rows(got.select("row_id", "reason")) == sorted(want, key=repr)
    assert "extra" in got.columns


def test_orphans_withdrawn_repeated_and_empty(spark):
    targets = spark.createDataFrame([(None, "a", 1, hours(0), hours(50), ""), (None, "b", 1, hours(30), None, ""), (None, "b", 1, hours(30), None, "")], TARGET)
    refs = spark.createDataFrame([(1, "a", 1, hours(49), False, ""), (2, "a", 1, hours(50), False, ""), (2, "a", 1, hours(50), False, ""), (3, "b", 1, hours(29), False, ""), (4, "b", 1, hours(30), False, ""), (5, "c", 1, None, False, "")], REF)
    assert rows(orphan_references(refs, targets, ["name", "at"], 9).select("row_id", "reason")) == [(2, "withdrawn"), (2, "withdrawn"), (3, "later"), (5, "missing")]
    assert rows(orphan_references(refs.limit(0), targets, ["name", "at"], 9)) == []
    assert {r[1] for r in rows(orphan_references(refs, targets.limit(0), ["name", "at"], 9).select("row_id", "reason"))} == {"missing"}


def test_profile_of_skewed_keys(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", None, "x", ""]), rng.choice([None, *range(-200_000, 200_000, 9_999)]), 1) for _ in range(900)]
    df = spark.createDataFrame(data, "k string, v int, key int")
    got = {r["key"]: r for r in key_profile(df, "k", ["v"], (10, 50)).collect()}
    for k in {x[0] for x in data}:
        all_v = [v for kk, v, _ in data if kk == k]
        v = sorted(x for x in all_v if x is not None)
        counts = {x: v.count(x) for x in v}
        mode = min(counts, key=lambda x: (-counts[x], x))
        rank = lambda p: v[-(-p * len(v) // 100) - 1]
        r = got[k]
        assert (r["n_rows"], r["n_nulls"], r["n_distinct"], r["mode"], r["mode_n"], r["p10"], r["p50"]) == (len(all_v), len(all_v) - len(v), len(counts), mode, counts[mode], rank(10), rank(50))
    assert {r[0] for r in heavy_keys(df, "k", "v", 30).collect()} == {"hot"}
    assert key_profile(df.limit(0), "k", ["v"]).count() == 0
    none = key_profile(spark.createDataFrame([("a", None)], "k string, v int"), "k", ["v"]).first()
    assert (none["n_rows"], none["n_distinct"], none["mode"], none["p50"]) == (1, 0, None, None)


def spans(spark, data, bits=3):
    return rows(stretches_and_gaps(spark.createDataFrame(data, "entity string, s int, e int, pos int, n int"), "entity", "s", "e", bits))


def brute(data):
    out = []
    for k in {d[0] for d in data if d[0] is not None}:
        cover = {p for n, s, e, *_ in data if n == k and s is not None and e is not None for p in range(s, e + 1)}
        edges, run = [], []
        for p in sorted(cover):
            if run and p == run[-1] + 1:
                run[-1] = p
            else:
                edges.append(run)
                run = [p, p]
        edges = [x for x in [*edges, run] if x]
        out += [(k, "covered", *x) for x in edges] + [(k, "gap", a[1] + 1, b[0] - 1) for a, b in zip(edges, edges[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "b", None]), s := rng.choice([None, *range(1, 120)]), None if s is None else s + rng.randrange(-2, 9), 1, 1) for _ in range(25)]
    assert spans(spark, data + data[:5]) == brute(data)


def test_intervals_nested_touching_and_empty(spark):
    assert spans(spark, [("a", 1, 100, 0, 0), ("a", 5, 6, 0, 0), ("a", 101, 101, 0, 0), ("a", 103, 110, 0, 0)]) == [("a", "covered", 1, 101), ("a", "covered", 103, 110), ("a", "gap", 102, 102)]
    assert spans(spark, []) == []
    assert spans(spark, [(None, 1, 2, 0, 0), ("a", 5, 4, 0, 0)]) == []


def test_cigar_text(spark):
    texts = ["10M", "3S4M2I1D5N2=1X7H", "", "*", "M", "10", "10M5", "10Mx", "10M\n", "1M" * 50_000, None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [tuple(r) for r in df.select(is_cigar(F.col("c")), reference_span(F.col("c"))).collect()]
    assert [g[0] for g in got] == [True, True, False, False, False, False, False, False, False, True, None]
    assert [g[1] for g in got][:2] == [10, 4 + 1 + 5 + 2 + 1] and got[9][1] == 50_000

"""Term frequencies, percentiles and text statistics against brute force; odd cases have defined results."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.llm import percentiles, queries, terms, textstats
from seqloom.plans import shared


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms_against_brute_force(spark):
    rng = random.Random(1)
    data = [(i, "".join(rng.choices("ab😀.*$\\", k=rng.randrange(6))) if rng.random() < 0.9 else None, rng.choice([1, 2, None]), {"NM": f"i:{rng.randrange(4)}", "X": None} if rng.random() < 0.8 else None, "x") for i in range(200)]
    data += [(1000, "é" * 50_000 + "q", None, {}, "x"), data[0]]
    df = spark.createDataFrame(data, "id int, q string, m int, tags map<string,string>, term string")
    got = terms.term_frequencies(df, {"q": terms.symbols(F.col("q")), "m": terms.single(F.col("m")), "tag": terms.entries(F.col("tags"))}, (1, 100), (1, 2))
    n, n_rows = Counter(), Counter()
    for _, q, m, tags, _ in data:
        each = [("q", c) for c in q or ""] + ([("m", str(m))] if m is not None else []) + [("tag", f"{k}:{v}") for k, v in (tags or {}).items() if v is not None]
        n.update(each)
        n_rows.update(set(each))
    mark = lambda k: "rare" if n_rows[k] * 100 < len(data) else "common" if n_rows[k] * 2 > len(data) else None
    assert rows(got) == sorted(((*k, n[k], n_rows[k], mark(k)) for k in n), key=repr)
    assert terms.term_frequencies(df.limit(0), {"q": terms.symbols(F.col("q"))}, (1, 100), (1, 2)).count() == 0


def brute_percentile(values, p):
    values = sorted(values)
    return values[-(-p * len(values) // 100) - 1]


def test_percentiles_exact_combined_and_bounded(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(-50, 50), 2**31 - 1, -(2**31)]), rng.randrange(3), 7) for _ in range(1500)] + [("one", 5, 1, 7), ("none", None, 1, 7)]
    df = spark.createDataFrame(data, "g string, v int, day int, value int")
    days = [percentiles.value_counts(df.filter(F.col("day") == d), "g", {"v": F.col("v")}) for d in range(3)]
    counts = percentiles.merge_counts(*days)
    got = {(r["grp"], r["pct"]): r for r in percentiles.bisect_percentiles(counts, (10, 50, 90, 100)).collect()}
    want = {(g, p): brute_percentile([v for k, v, *_ in data if k == g and v is not None], p) for g in {"hot", "b", None, "one"} for p in (10, 50, 90, 100)}
    assert {k: r["value"] for k, r in got.items()} == want
    assert {r["error"] for r in got.values()} == {0}
    rough = percentiles.bisect_percentiles(counts, (50,), tolerance=1000).collect()
    assert all(abs(r["value"] - want[r["grp"], 50]) <= r["error"] <= 1000 for r in rough)
    assert percentiles.bisect_percentiles(counts.limit(0), (50,)).count() == 0


def brute_statistics(text, common):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    lines = [x for x in (line.strip(" \t\r") for line in text.split("\n")) if x]
    symbols = sum(33 <= ord(c) <= 126 and not c.isalnum() for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines), sum(x[-1] in ".!?。！？" for x in lines), sum(w.lower() in common for w in words)


def test_text_statistics(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\r\n", "One. \r\nTwo! ..\n\n。", "a" * 200_000, "the " * 60_000, "x\x0by z.\x85", "😀😀 !?.", ".\n?\n!", "The THE the,"]
    texts += ["".join(rng.choices("aA .,!?\n\r\t。é-the", k=rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, rng.choice(["en", "EN", "en-XX", None, "fr"]), "w") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, words string")
    common = spark.createDataFrame([("the", "en"), ("a", "en"), ("a", "fr"), (None, "fr")], "word string, lang string")
    want = {i: brute_statistics(t, {"the", "a"}) for i, t in enumerate(texts)}
    for limit in (textstats.SET_WORDS, 1):  # as a set, and joined
        try:
            old, textstats.SET_WORDS = textstats.SET_WORDS, limit
            stats = textstats.text_statistics(docs, common)
            got = {r["doc_id"]: tuple(r[c] for c in ("words", "n_chars", "n_symbols", "n_lines", "n_ended", "n_common")) for r in stats.collect()}
        finally:
            textstats.SET_WORDS = old
        assert got == want
    assert {r["lang"] for r in stats.select("lang").distinct().collect()} == {"en", "und", "fr"}
    scored = textstats.outlier_scores(stats).collect()
    assert len(scored) == len(texts)
    by = {r["doc_id"]: r for r in scored}
    for r in scored:
        score = 0.0
        for s in textstats.STATISTICS:
            group = [x[s] for x in by.values() if x["lang"] == r["lang"]]
            score -= math.log(min(1.0, 2 * min(sum(v <= r[s] for v in group), sum(v >= r[s] for v in group)) / len(group)))
        assert math.isclose(score, r["outlier_score"], abs_tol=1e-9)
    twice = textstats.outlier_scores(textstats.text_statistics(docs.unionByName(docs), common))
    assert twice.count() == 2 * len(texts)
    assert textstats.outlier_scores(textstats.text_statistics(docs.limit(0), common.limit(0))).count() == 0


@pytest.mark.parametrize("limit", range(9))
def test_common_words_around_the_limit(spark, limit, monkeypatch):
    """Null and empty entries don't count against the limit, and no word beyond it is lost."""
    monkeypatch.setattr(textstats, "SET_WORDS", limit)
    known = ["aa", "bb", "cc", "dd", "ee", "ff"]
    docs = spark.createDataFrame([(1, " ".join(known), "en"), (2, "aa zz AA", "en"), (3, None, "en")], "doc_id bigint, text string, lang string")
    common = spark.createDataFrame([(w,) for w in [None, "", *known, None, "aa"]], "word string").coalesce(1)
    assert sorted((r["doc_id"], r["n_common"]) for r in textstats.text_statistics(docs, common).collect()) == [(1, 6), (2, 2), (3, 0)]


def _prose(rng):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(rng.randrange(40, 90))) + "."


def test_planted_junk_lies_far_out(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, _prose(rng) if rng.random() < 0.9 else "ok.", "en") for i in range(1500)]
    junk = [";".join(f"a{i}=({i}){{}}" for i in range(400)), "| 1 | 2 | 3 |\n" * 200, "x" * 5_000, "0x" + "af09" * 900 + " !", "--++** " * 900]
    docs += [(10_000 + i, t, "en") for i, t in enumerate(junk)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    stats = textstats.text_statistics(df, spark.createDataFrame([("the",), ("of",), ("and",)], "word string"))
    found = {r["doc_id"] for r in textstats.outliers(textstats.outlier_scores(stats), queries.FAR_OUT).collect()}
    assert len([x for x in found if x >= 10_000]) >= 0.8 * len(junk) and len(found) < 0.03 * len(docs)
    scores = lambda: sorted((r["doc_id"], round(r["outlier_score"], 9)) for r in textstats.outlier_scores(stats).collect())
    small = scores()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)  # the shuffled side of the joins
    assert scores() == small


def test_days_of_reads(spark):
    """Timestamps and clashing names beside the group do no harm."""
    df = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1), 9)], "grp string, n int, lo timestamp_ntz, field int")
    assert [tuple(r) for r in percentiles.bisect_percentiles(percentiles.value_counts(df, "grp", {"n": F.col("n")}, ["lo"]), (50,)).collect()] == [("a", "n", 50, 1, 1, 0)]


def test_percentiles_of_small_groups(spark, tmp_path):
    """p7_percentiles has every RNAME, p7_found those with at least 0.4 percent of all rows."""
    rng = random.Random(4)
    names = ["big"] * 700 + [f"c{i % 300}" for i in range(700)] + [None, "*"] * 5
    data = [(n, rng.choice([None, 0, 7, 255, 60]), rng.choice([None, 0, -2000, 2**31 - 1, -(2**31), 5]), rng.randrange(3)) for n in names]
    spark.createDataFrame(data, "rname string, mapq int, tlen int, load_day int").write.parquet(str(tmp_path / "reads.parquet"))
    values = {}
    for n, mapq, tlen, _ in data:
        if n not in (None, "*"):
            values.setdefault((n, "tlen"), []).extend([abs(tlen)] if tlen else [])
            values.setdefault((n, "mapq"), []).extend([mapq] if mapq is not None and mapq <= 254 else [])
    want = {(n, f, p): (len(v), brute_percentile(v, p)) for (n, f), v in values.items() if v for p in (10, 50, 90)}
    got = {tuple(r)[:3]: (r["n"], r["value"]) for r in queries.p7_percentiles(spark, str(tmp_path)).collect()}
    assert got == want and len({n for n, *_ in got}) > 250
    found = {tuple(r) for r in queries.p7_found(spark, str(tmp_path)).collect()}
    assert found == {k for k, (_, v) in want.items() if k[0] == "big" and (v > 1000 if k[1] == "tlen" else v < 20)}

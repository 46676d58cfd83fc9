"""Shared spans against brute force."""

import random

import numpy as np
import pytest

from seqloom.llm import spans


def brute(data, width):
    where = {}
    for row, text in data:
        if row is not None and text is not None:
            for i in range(len(text) - width + 1):
                where.setdefault(text[i : i + width], set()).add(row)
    out = []
    for row in {r for r, t in data if r is not None}:
        starts = sorted({i for r, t in data if r == row and t for i in range(len(t) - width + 1) if len(where[t[i : i + width]]) > 1})
        runs = []
        for i in starts:
            if runs and i <= runs[-1][1] + width:
                runs[-1][1] = i
            else:
                runs.append([i, i])
        out += [(row, a + 1, b + width) for a, b in runs]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choices("ACGT", k=n))
    source = letters(400)
    data = [(i, letters(rng.randrange(30)) + source[(a := rng.randrange(380)) : a + rng.randrange(60)] + letters(rng.randrange(30))) for i in range(120)]
    data += [(200 + i, "G" * rng.randrange(10, 60)) for i in range(12)] + [(300, None), (301, ""), (302, "N" * 19), (303, source[:20]), (304, source[:20]), (305, letters(40) + "É" + source[50:90])]
    return data


@pytest.mark.parametrize("limit", [5, 20_000])
def test_against_brute_force(spark, limit):
    data = made(limit)
    df = spark.createDataFrame([(r, t, 1, "s") for r, t in data], "id bigint, text string, at int, segment string")
    got = spans.shared_spans(df, "id", "text", 20, group_limit=limit)
    assert sorted(map(tuple, got.collect())) == brute(data, 20)


def test_repeated_rows_nulls_and_empty(spark):
    a, b = "ACGTTGCA" * 10, "TTTTGGGGCCCCAAAATGCATGCA" * 3
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (None, b), (3, None)], "id bigint, text string")
    assert spans.shared_spans(df, "id", "text", 60).count() == 0
    assert spans.shared_spans(df.limit(0), "id", "text", 60).count() == 0


def brute_repeats(data, width):
    where = {}
    for row, text in sorted(d for d in data if d[0] is not None and d[1] is not None):
        for i in range(len(text) - width + 1):
            where.setdefault(text[i : i + width], []).append((row, i))
    out = []
    for row, text in {d for d in data if d[0] is not None and d[1] is not None}:
        before = None
        for i in range(len(text) - width + 1):
            places = where[text[i : i + width]]
            n = len({r for r, _ in places})
            r, j = min(places)
            if n > 1 and before == (r, j - i, n):
                out[-1][2] += 1
            elif n > 1:
                out.append([row, i + 1, i + width, r, j + 1, n])
            before = (r, j - i, n) if n > 1 else None
    return sorted(map(tuple, out))


@pytest.mark.parametrize("limit", [5, 20_000])
def test_repeats_against_brute_force(spark, limit):
    data = made(limit + 1)
    df = spark.createDataFrame([(r, t, 1, "s") for r, t in data], "id bigint, text string, at int, segment string")
    got = sorted(map(tuple, spans.maximal_repeats(df, "id", "text", 20, group_limit=limit).collect()))
    assert got == brute_repeats(data, 20)
    assert spans.maximal_repeats(df.limit(0), "id", "text", 20).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choices("ACGT", k=5000))
    data = [(1, long), (2, long[100:4900]), (3, long[2000:2070])]
    monkeypatch.setattr(spans, "PIECE", 64)
    batch = __import__("pyarrow").RecordBatch.from_pylist([{"row_id": r, "text": t} for r, t in data])
    parts = [x for x in spans._anchored(batch, 60)]
    segments = sorted((int(a), int(r), int(s), t) for anchor, row, at, text in parts for a, r, s, t in zip(anchor, row, at, text))
    out = spans._repeats(*(np.array([s[i] for s in segments], dtype=np.int64) for i in range(3)), [s[3] for s in segments], 60)
    windows = sorted((int(r), w) for r, s, e, *_ in zip(*out) for w in range(s, e + 1))
    assert windows == sorted([(1, w) for w in range(100, 4841)] + [(2, w) for w in range(4741)] + [(3, w) for w in range(11)])


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(spans, "_rolling", lambda codes, width: np.zeros(len(codes) - width + 1, dtype=np.uint64))
    anchor = np.full(4, int(spans._scramble(np.zeros(1, np.uint64)).view(np.int64)[0]))
    out = spans._repeats(anchor, np.array([1, 2, 3, 4]), np.zeros(4, np.int64), ["ACGTA", "TTTTT", "ACGTA", "CCCCC"], 5)
    assert sorted(out[0].tolist()) == [1, 3]

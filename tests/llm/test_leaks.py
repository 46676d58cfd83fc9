"""Leaks of evaluation texts against brute force."""

import random
import re

import pytest

from seqloom.llm import leaks as L
from seqloom.plans import shared

WORD = re.compile("[A-Za-z0-9]+")


def words(text):
    return [w.lower() for w in WORD.findall(text or "")]


def brute(docs, items, length, least):
    out = set()
    for item, text in items:
        w = words(text)
        n = min(len(w), length)
        if item is None or n < least:
            continue
        runs = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        for doc, t in docs:
            d = words(t)
            if doc is not None and any(tuple(d[j : j + n]) in runs for j in range(len(d) - n + 1)):
                out.add((doc, item))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    voc = ["the", "of", "a", "x1", "kap", "Zu", "No"] + [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(voc, k=rng.choice([0, 2, 3, 4, 7, 9])))) for i in range(25)] + [(90, None), (91, "..."), (None, "the of a x1 kap")]
    docs = []
    for i in range(80):
        parts = [rng.choice(["-", "\n", " é", "İ", "K "]).join(rng.choices(voc, k=rng.randrange(12))) for _ in range(3)]
        src = words(rng.choice(items)[1])
        docs.append((i, parts[0] + " // " + " _ ".join(w.upper() for w in src[: rng.randrange(10)]) + "\r\n" + parts[1]))
    docs += [(200, None), (201, ""), (202, "the of " * 30_000 + " ".join(words(items[0][1]))), (203, docs[0][1]), (None, docs[0][1])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, term string, pos int")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, phrase string")
    assert sorted(map(tuple, L.leaks(d, e, 5, 3).collect())) == brute(docs, items, 5, 3)
    assert L.leaks(d.limit(0), e, 5, 3).count() == 0
    assert L.leaks(d, e.limit(0), 5, 3).count() == 0


@pytest.mark.parametrize("least", [1, 2])
def test_short_phrases(spark, least):
    docs = [(1, "foo bar baz"), (2, "bar"), (3, "baz foo"), (4, "x foo x bar")]
    items = [(1, "bar"), (2, "foo, bar"), (3, "foo bar baz"), (4, "none"), (5, "bar bar")]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, L.leaks(d, e, 5, least).collect())) == brute(docs, items, 5, least)


def brute_near(docs, items, length, least, slack, percent):
    out = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), length)
        if n < least:
            continue
        for doc, t in docs:
            d = words(t)
            there = lambda at, term: any(0 <= p < len(d) and d[p] == term for p in range(at - slack, at + slack + 1))
            for at in range(-len(w) - slack, len(d) + slack + 1):
                place = [there(at + q, term) for q, term in enumerate(w)]
                best = max(sum(place[j : j + n]) for j in range(len(w) - n + 1))
                if best * 100 >= n * percent:
                    out[doc, item] = max(best, out.get((doc, item), 0))
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize(("slack", "percent", "least"), [(0, 80, 1), (1, 80, 3), (2, 60, 4), (1, 100, 5)])
def test_near_against_brute_force(spark, slack, percent, least):
    rng = random.Random(slack * 100 + percent)
    voc = ["the", "of", "a"] + [f"w{i}" for i in range(20)]
    items = [(i, " ".join(rng.choices(voc, k=rng.choice([1, 4, 5, 6, 8, 10])))) for i in range(14)] + [(50, "alpha beta gamma delta epsilon zeta")]
    docs = [(500, "x alpha beta y gamma delta epsilon zeta"), (501, "alpha beta gamma delta epsilon eta"), (502, "omega beta gamma delta epsilon zeta"), (503, None)]
    for i in range(40):
        w = words(rng.choice(items)[1])
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w = w[:k] + rng.choices(voc, k=rng.randrange(2)) + w[k + rng.randrange(2) :]
        docs.append((i, " ".join(rng.choices(voc, k=rng.randrange(6)) + w + rng.choices(voc, k=rng.randrange(6)))))
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, L.near_leaks(d, e, 6, least, slack, percent).collect())) == brute_near(docs, items, 6, least, slack, percent)


def test_one_index_for_several_sets(spark, tmp_path, monkeypatch):
    docs = [(1, "one two three four"), (2, "four five six"), (3, "")]
    index = L.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), f"{tmp_path}/index")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)  # the shuffled side of every join
    for items in ([(1, "two three")], [(2, "five six"), (3, "four five six"), (4, "six seven")]):
        known = L.passages(spark.createDataFrame(items, "item_id bigint, text string"), 3, 2)
        assert sorted((r["doc_id"], r["item_id"]) for r in L.find_passages(index, known).collect()) == brute(docs, items, 3, 2)


def test_repeated_document_rows(spark):
    text = "so one two three four five six seven and on"
    d = spark.createDataFrame([(1, text), (1, text), (1, text), (2, text), (3, "one two three four five seven six")], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, "One two, three four five six seven")], "item_id bigint, text string")
    assert sorted(map(tuple, L.leaks(d, e).collect())) == [(1, 7), (2, 7)]

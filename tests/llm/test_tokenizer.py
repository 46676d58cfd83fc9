"""The transducer against the merges and against two public libraries."""

import os
import random

import pytest

from seqloom.llm import tokenizer as T

PATH = os.path.join(T.VOCABULARY_DIR, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def tokens():
    return T.read_ranks(PATH)


@pytest.fixture(scope="module")
def vocabulary(tokens):
    return T.Vocabulary(tokens)


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(5)
    yield from ["", " ", "  a", "a  b\n\n c", "it's we'll I'M", "<|endoftext|> x", "\x1c\x1d a\x85b c　 d", "😀👩‍👩‍👧 é é ß", "\x00\x01﻿", "日本語。 中文", "1234567890 ٣٤ ½²", "=" * 500, " " * 700 + "x", "\r\n\t " * 90, "abc" * 4000, "Ａ _a_ __init__(self):"]
    alphabet = "aeiou rstln\n\t'.,-_{}=+019 éñ日本😀 "
    for _ in range(400):
        yield "".join(rng.choices(alphabet, k=rng.randrange(120)))


def test_transducer_equals_merges(tokens, vocabulary):
    fst, rng = T.Transducer(vocabulary), random.Random(4)
    for i in range(3000):
        word = bytes(rng.choices(b"etaoinshr dlu=-\xc3\xa9\xe6\x97", k=rng.randrange(1, 40)))
        assert list(fst.encode_word(word)) == fst.merge(word)
    for t in rng.sample(tokens, 3000):
        assert list(fst.encode_word(t)) == [fst.rank[t]] == fst.merge(t)


def test_pairs_equal_merges(vocabulary):
    fst, rng = T.Transducer(vocabulary), random.Random(6)
    some = [rng.randrange(len(vocabulary.tokens)) for _ in range(4000)] + [vocabulary.rank[t] for t in (b"a", b"aa", b"aaaa", b" ", b"--", b"----", b"==", b"====") if t in vocabulary.rank] * 20
    rng.shuffle(some)
    for a, b in zip(some, some[1:]):
        assert vocabulary.fits(a, b) == (fst.merge(vocabulary.tokens[a] + vocabulary.tokens[b]) == [a, b])
    assert sum(x < 0 for x in vocabulary.left) == 256  # every other token has its parts


def test_equals_library(vocabulary, library):
    encoder = T.Encoder(vocabulary)
    for text in odd_texts():
        assert encoder.encode(text) == library(text), text


def test_every_character_equals_library(vocabulary, library):
    encoder = T.Encoder(vocabulary)
    wrong = [hex(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and c % 5 == 0 or c < 0x3100 for text in [f"a{chr(c)} {chr(c)}1{chr(c)}\n{chr(c)}"] if encoder.encode(text) != library(text)]
    assert not wrong, wrong[:20]


def test_state_bounds(vocabulary, monkeypatch):
    monkeypatch.setattr(T, "KEPT_STATES", 20)
    monkeypatch.setattr(T, "KEPT_WORDS", 10)
    monkeypatch.setattr(T, "KEPT_PAIRS", 10)
    encoder, full = T.Encoder(vocabulary), T.Transducer(vocabulary)
    for text in odd_texts():
        for w in text.split():
            assert list(encoder.fst.encode_word(w.encode())) == full.merge(w.encode()) if len(w) < 300 else True


def test_long_word_is_linear(tokens, vocabulary):
    encoder = T.Encoder(vocabulary)
    long = "qzxv" * 300_000
    assert T.decode(encoder.encode(long), tokens) == long


def test_incremental_utf8(tokens, vocabulary):
    data = "a😀é日́z".encode() + b"\xff\xe6\x97" + "ok".encode()
    for step in range(1, 8):
        m = T.Utf8Machine()
        assert "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) + m.end() == data.decode("utf-8", "replace")
    encoder = T.Encoder(vocabulary)
    for text in odd_texts():
        assert T.decode(encoder.encode(text), tokens, portion=3) == text


def test_corpus(spark, vocabulary):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x"), (None, "a", "x")], "doc_id bigint, text string, ids string")
    out = T.encode_corpus(df, PATH)
    got = sorted([(r[0], r[1]) for r in out.collect()], key=repr)
    hello = T.Encoder(vocabulary).encode("Hello world")
    assert got == sorted([(1, []), (2, []), (3, hello), (3, hello), (None, T.Encoder(vocabulary).encode("a"))], key=repr)
    assert out.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    assert sorted((r[1] for r in T.decode_corpus(out, PATH).collect())) == ["", "", "Hello world", "Hello world", "a"]
    assert T.encode_corpus(df.limit(0), PATH).count() == 0

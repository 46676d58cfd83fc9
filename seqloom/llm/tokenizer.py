"""Encoding with a public byte-pair vocabulary by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shared import spread

VOCABULARY_DIR = os.environ.get("SEQLOOM_TOKENIZERS", "/opt/tokenizers")

# Fixed values of the vocabulary's pre-splitting: the pattern, with white space as Unicode has it; for ASCII texts the same in ASCII.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^%s\p{L}\p{N}]+|[%s]+(?![^%s])|[%s]+" % ((SPACES,) * 4)
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Bounds of what a worker keeps: words, transducer states, tried token pairs.
KEPT_WORDS, KEPT_STATES, KEPT_PAIRS, WORD_CHARS = 200_000, 200_000, 500_000, 40


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    with open(path, "rb") as f:
        ranks = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


class Vocabulary:
    """Tokens by id, and for each the two tokens that its last merge puts together (a single byte: none, -1)."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = [-1] * len(tokens), [-1] * len(tokens)
        for i, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None and a < i and b < i and self._apart(a, b, i):
                    self.left[i], self.right[i] = a, b
                    break

    def _apart(self, a: int, b: int, but: int) -> bool:
        """Whether a and b, side by side, keep their border under all merges except the one into but.

        Walks back in time from a and b: of the two tokens at the border the later made one is
        taken apart. Their joint token, if there is one, would come first if it ranks before what
        swallowed either of them; of equal ranks the left one comes first.
        """
        tokens, rank, left, right = self.tokens, self.rank, self.left, self.right
        swallowed_a = swallowed_b = len(tokens)
        while True:
            joint = rank.get(tokens[a] + tokens[b])
            if joint is not None and joint < swallowed_a and joint <= swallowed_b and joint != but:
                return False
            if left[a] < 0 and left[b] < 0:
                return True
            if left[b] < 0 or a > b and left[a] >= 0:
                swallowed_a, a = a, right[a]
            else:
                swallowed_b, b = b, left[b]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joint bytes of a and b gives a and b back."""
        return self._apart(a, b, -1)


class Transducer:
    """A finite-state transducer from the bytes of one word to its tokens.

    The merges decide which two tokens may stand side by side: exactly those pairs that merging
    their joint bytes gives back. The encoding of each prefix of a word then ends in the one
    token that fits behind the encoding of what precedes it. A state is the set of places from
    which a vocabulary entry may still go on: for each of them the trie node reached, the last
    token before it, and the tokens not yet emitted. What all of them have in common is emitted,
    at most one vocabulary entry behind the input. States and transitions are made when a text
    first needs them.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.tokens, self.rank, self.fits = vocabulary.tokens, vocabulary.rank, vocabulary.fits
        self.child: dict[int, int] = {}
        self.token = [-1]
        self.inner = [True]
        for i, t in enumerate(self.tokens):
            node = 0
            for b in t:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states = [((0, -1, ()),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, text: bytes) -> list[int]:
        """The encoding by the merges themselves: the pair of lowest rank first, the leftmost of equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, len(self.tokens)) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low == len(self.tokens):
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        child, token, inner, pairs = self.child, self.token, self.inner, self.pairs
        kept, last, done = [], -1, ()
        for node, before, waiting in self.states[state]:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            t = token[node]
            if last < 0 <= t:
                fits = True
                if before >= 0:
                    fits = pairs.get(before << 20 | t)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[before << 20 | t] = self.fits(before, t)
                if fits:
                    last, done = t, (*waiting, t)
            if inner[node]:
                kept.append((node, before, waiting))
        if not kept:  # nothing can go on: all is settled
            same, key = len(done), ((0, last, ()),)
        else:
            same = 0
            if kept[0][2]:  # the first place waits longest if any does
                shortest = min([len(w) for _, _, w in kept])
                while same < shortest and all([w[same] == done[same] for _, _, w in kept]):
                    same += 1
            kept.append((0, last, done))
            key = tuple([(n, b, w[same:]) for n, b, w in kept] if same else kept)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = (to, done[:same])
        return move

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        if len(self.states) > KEPT_STATES:
            self._restart()
        out: list[int] = []
        state, moves = 0, self.moves
        for i, byte in enumerate(word):
            move = moves.get(state << 8 | byte) or self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
            if not i & 0xFFFF and len(self.states) > 2 * KEPT_STATES:  # a word of many megabytes
                here = self.states[state]
                self._restart()
                state = self.number.setdefault(here, len(self.states))
                if state == len(self.states):
                    self.states.append(here)
                moves = self.moves
        out += self.states[state][-1][2]
        return tuple(out)


class Encoder(dict):
    """Text to token ids. The dictionary keeps the path of short words through the transducer as one transition."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.fst = Transducer(vocabulary)
        self.ascii, self.any = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.fst.encode_word(word.encode("utf-8", "surrogatepass"))
        if len(word) <= WORD_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words = self.ascii(text) if text.isascii() else self.any(text)
        return list(itertools.chain.from_iterable(map(self.__getitem__, words)))


class Utf8Machine:
    """Incremental UTF-8: takes bytes in any portions and gives the characters completed so far.

    The state is what is open: the bytes of the character begun. Bytes that can't be UTF-8 become U+FFFD.
    """

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else 1
                keep = back if need > back else 0
                break
            if b < 0x80:
                break
        cut = len(data) - keep
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        data, self.open = self.open, b""
        return data.decode("utf-8", "replace")


def decode(ids: Iterable[int], tokens: list[bytes], portion: int = 4096) -> str:
    """Token ids to text, in portions of tokens; an unknown id raises IndexError."""
    machine, ids, out = Utf8Machine(), iter(ids), []
    while some := list(itertools.islice(ids, portion)):
        out.append(machine.feed(b"".join([tokens[i] for i in some])))
    return "".join(out) + machine.end()


_made: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """One encoder per worker and vocabulary, with what it has learnt."""
    key = hash(tuple(vocabulary.tokens))
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(vocabulary)
    return _made[key]


def _encode(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(vocabulary.value)
            flat: list[int] = []
            ends = np.zeros(batch.num_rows + 1, dtype=np.int32)
            for i, text in enumerate(batch.column(1).to_pylist()):
                flat += encoder.encode(text)
                ends[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(flat, dtype=np.int32, count=len(flat))))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return run


def encode_corpus(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, ids): the token ids of each row's whole text, without special tokens.

    Text that looks like a special token is plain text. Null and empty texts give the empty list.
    Each row is encoded by itself; repeated rows stay repeated, other columns are left out. path:
    a rank file readable by the driver; its tokens and their parts, about a megabyte, are broadcast.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))
    docs = spread(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return docs.mapInArrow(_encode(vocabulary), "doc_id bigint, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) from (doc_id, ids); null ids give null, the empty list gives the empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else decode(ids, vocabulary.value) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")

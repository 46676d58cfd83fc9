"""Long exact spans shared between records: winnowed anchors, extended both ways to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import broadcast_if_small, cut, partitions_for, spread

SEED = 16
#: Letters hashed at once in a Python worker; longer records are hashed in overlapping pieces.
PIECE = 1 << 20
#: An anchor with more occurrences than this isn't held by one task but worked off window by window.
GROUP_LIMIT = 20_000
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
REPEAT = "row_id bigint, s bigint, e bigint, rep_row bigint, rep_s bigint, n_rows bigint"
REPEAT_NAMES = [c.split()[0] for c in REPEAT.split(", ")]
SEGMENT = "anchor bigint, row_id bigint, at bigint, segment string"


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), dtype=np.uint8)
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _rolling(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of the length, put together from windows of powers of two."""
    with np.errstate(over="ignore"):
        block, size, power = _scramble(codes.astype(np.uint64) + np.uint64(1)), 1, BASE
        out, done = None, 0
        while True:
            if length & size:
                out = block if out is None else out[: len(block) - done] * power + block[done:]
                done += size
            if done == length:
                return out
            block = block[:-size] * power + block[size:]
            size, power = size * 2, power * power


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of the width."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _windows(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end: the starts of the windows that lie in one text, and the number of them in each."""
    count = np.maximum(lengths - width + 1, 0)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) - np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.repeat(first, count) + np.arange(count.sum()), count


def _pieces(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    ids, starts, texts, size = [], [], [], 0
    for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for at in range(0, len(text) - width + 1, PIECE):
            part = text[at : at + PIECE + width - 1]
            ids.append(row)
            starts.append(at)
            texts.append(part)
            size += len(part)
            if size >= PIECE:
                yield ids, starts, texts
                ids, starts, texts, size = [], [], [], 0
    if texts:
        yield ids, starts, texts


def _anchored(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Segments (anchor, row, start, text): maximal runs of windows with one winnowed anchor.

    The anchor of a window is the least hash of its seeds. Equal windows have equal anchors, so
    that two records share a window only where they share its anchor.
    """
    for ids, starts, texts in _pieces(batch, width):
        joined = "".join(texts)
        codes, lengths = _codes(joined), np.array([len(t) for t in texts])
        seed = min(SEED, width)
        where, count = _windows(lengths, width)
        value = _least(_scramble(_rolling(codes, seed)), width - seed + 1)[where]
        piece = np.repeat(np.arange(len(texts)), count)
        cut_at = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (piece[1:] != piece[:-1]))))
        sizes = np.diff(np.append(cut_at, len(value))) + width - 1
        begin = where[cut_at]
        own = piece[cut_at]
        offset = np.cumsum(lengths) - lengths
        yield value[cut_at].view(np.int64), np.array(ids, dtype=np.int64)[own], begin - offset[own] + np.array(starts)[own], [joined[b:e] for b, e in zip(begin.tolist(), (begin + sizes).tolist(), strict=True)]


def _segments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, row, at, text in _anchored(batch, width):
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(row), pa.array(at.astype(np.int64)), pa.array(text, type=pa.string())], ["anchor", "row_id", "at", "segment"])

    return run


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, *_ in _anchored(batch, width):
                value, n = np.unique(anchor, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return run


def _first_of(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))


def _context(codes: np.ndarray, begin: np.ndarray, step: int, reach: int, left: np.ndarray) -> np.ndarray:
    """The reach letters from begin on, in steps of 1 or -1, as the rows of a matrix; 0 beyond the letters left."""
    out = np.zeros((len(begin), reach), dtype=codes.dtype)
    for j in range(reach):
        inside = left > j
        out[inside, j] = codes[begin[inside] + step * j]
    return out


class _Refined:
    """Classes of contexts of one anchor that agree in their first letters, however many are asked for."""

    def __init__(self, anchor: np.ndarray, context: np.ndarray):
        width = context.shape[1]
        keys = context.astype(context.dtype.newbyteorder(">")).view(f"S{width * context.dtype.itemsize}").ravel() if width else np.zeros(len(anchor), "S1")
        self.order = np.lexsort((keys, anchor))
        a, b = self.order[:-1], self.order[1:]
        differ = context[a] != context[b]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(a), np.int64)
        self.common = np.where(anchor[a] == anchor[b], common, -1)

    def classes(self, letters: int) -> np.ndarray:
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.concatenate(([0], np.cumsum(self.common < letters)))
        return out


def _repeats(anchor: np.ndarray, row: np.ndarray, at: np.ndarray, texts: list[str], width: int, classes: bool = True) -> tuple[np.ndarray, ...]:
    """Maximal repeats (row, first window, last window, row and first window of the representative, rows) of segments sorted by anchor.

    Every place of an anchor is extended to both sides letter by letter: contexts are sorted once
    to the right and once to the left, and the letters that neighbours have in common give the
    classes of places that agree in so many letters. The window with k letters before its anchor
    is shared by the places that agree in k letters to the left and in the rest to the right; the
    first of them is the representative. A repeat goes on for as long as it stays beside the same
    representative, with the same number of rows; without classes, as long as anything is shared.
    """
    none = (np.zeros(0, np.int64),) * 6
    first = _first_of(anchor)
    several = np.minimum.reduceat(row, first) < np.maximum.reduceat(row, first)
    keep = np.flatnonzero(np.repeat(several, np.diff(np.append(first, len(anchor)))))
    if not len(keep):
        return none
    keep = keep[np.lexsort((at[keep], row[keep]))]
    anchor, row, at, texts = anchor[keep], row[keep], at[keep], [texts[i] for i in keep.tolist()]
    joined = "".join(texts)
    codes, lengths = _codes(joined), np.array([len(t) for t in texts])
    seed = min(SEED, width)
    begin = np.cumsum(lengths) - lengths
    # The places of the anchor: the seeds with its hash. A window belongs to the first of them that lies in it.
    value = _scramble(_rolling(codes, seed)).view(np.int64)
    of = np.repeat(np.arange(len(texts)), np.maximum(lengths - seed + 1, 0))
    starts, _ = _windows(lengths, seed)
    hit = value[starts] == anchor[of]
    place, own = starts[hit], of[hit]
    where, count = _windows(lengths, width)
    segment = np.repeat(np.arange(len(texts)), count)
    nearest = np.searchsorted(place, where)
    before = place[nearest] - where
    codes = codes + codes.dtype.type(1)
    right = _Refined(anchor[own], _context(codes, place, 1, width, begin[own] + lengths[own] - place))
    left = _Refined(anchor[own], _context(codes, place - 1, -1, width - seed, place - begin[own]))
    shift = at - begin
    n, stand = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
    by_before = np.argsort(before, kind="stable")
    edges = np.searchsorted(before[by_before], np.arange(width - seed + 2))
    for k in range(width - seed + 1):
        w = by_before[edges[k] : edges[k + 1]]  # in the order of rows and places
        if not len(w):
            continue
        key = left.classes(k)[nearest[w]] * len(place) + right.classes(width - k)[nearest[w]]
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
        group = _first_of(key)
        sizes = np.diff(np.append(group, len(key)))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[segment[w[1:]]] != row[segment[w[:-1]]])))
        n[w] = np.repeat(np.add.reduceat(new.astype(np.int64), group), sizes)
        stand[w] = np.repeat(w[group], sizes)
    shared = np.flatnonzero(n > 1)
    if not len(shared):
        return none
    r, s, n = row[segment[shared]], where[shared] + shift[segment[shared]], n[shared]
    r2, s2 = row[segment[stand[shared]]], where[stand[shared]] + shift[segment[stand[shared]]]
    goes_on = (segment[shared][1:] == segment[shared][:-1]) & (s[1:] == s[:-1] + 1)
    if classes:
        goes_on &= (r2[1:] == r2[:-1]) & (s2[1:] == s2[:-1] + 1) & (n[1:] == n[:-1])
    start = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    end = np.append(start[1:], len(shared)) - 1
    return r[start], s[start], s[end], r2[start], s2[start], n[start]


def _extend(width: int, classes: bool, enough: int = 100_000):
    """Works off segments sorted by anchor, whole anchor groups at a time."""

    def work(held: list[pa.RecordBatch], upto: int | None) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
        t = pa.Table.from_batches(held).combine_chunks()
        anchor = t.column(0).to_numpy()
        n = len(anchor) if upto is None else int(np.searchsorted(anchor, upto, side="left"))
        rest = t.slice(n).to_batches() if n < len(anchor) else []
        if not n:
            return None, rest
        t = t.slice(0, n)
        out = _repeats(anchor[:n], t.column(1).to_numpy(), t.column(2).to_numpy(), t.column(3).to_pylist(), width, classes)
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], REPEAT_NAMES), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= enough:
                out, held = work(held, batch.column(0)[-1].as_py())
                if out is not None:
                    yield out
        if held:
            out, _ = work(held, None)
            if out is not None:
                yield out

    return run


def _hashed_windows(width: int):
    """All windows of segments by two independent 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, 2_000):
                part = batch.slice(c, 2_000)
                texts = part.column(2).to_pylist()
                if not texts:
                    continue
                codes, lengths = _codes("".join(texts)), np.array([len(t) for t in texts])
                where, count = _windows(lengths, width)
                own = np.repeat(np.arange(len(texts)), count)
                # The second hash is that of the reversed letters, scrambled another way.
                back = _rolling(_scramble(codes[::-1].astype(np.uint64) + MIX), width)[::-1]
                s = part.column(1).to_numpy()[own] + where - (np.cumsum(lengths) - lengths)[own]
                yield pa.RecordBatch.from_arrays([pa.array(_rolling(codes, width)[where].view(np.int64)), pa.array(back[where].view(np.int64)), pa.array(part.column(0).to_numpy()[own]), pa.array(s)], ["h1", "h2", "row_id", "s"])

    return run


def _heavy_repeats(segments: DataFrame, width: int) -> DataFrame:
    """Repeats of one window each of heavy anchors, however many rows they have; a window's 128 hashed bits stand for its letters."""
    each = cut(segments.select("row_id", "at", "segment").mapInArrow(_hashed_windows(width), "h1 bigint, h2 bigint, row_id bigint, s bigint"), "windows")
    rows = each.groupBy("h1", "h2", "row_id").agg(F.min("s").alias("s"), F.count("*").alias("n"))
    shared = rows.groupBy("h1", "h2").agg(F.min(F.struct("row_id", "s")).alias("x"), F.count("*").alias("n_rows"), F.sum("n").alias("n")).filter("n_rows > 1")
    shared = cut(shared.select("h1", "h2", F.col("x.row_id").alias("rep_row"), F.col("x.s").alias("rep_s"), "n_rows", "n"), "shared")
    # At most 1,000 windows can hold a thousandth of the rows each: they are broadcast, the others are shuffled.
    limit = each.count() // 1000
    top, light = F.broadcast(shared.filter(F.col("n") > limit)), shared.filter(F.col("n") <= limit)
    keys = ["h1", "h2"]
    kept = each.join(top, keys).unionByName(each.join(top.select(*keys), keys, "left_anti").join(light, keys))
    return kept.select("row_id", "s", F.col("s").alias("e"), "rep_row", "rep_s", "n_rows")


def _all_repeats(df: DataFrame, row_id: str, text: str, width: int, group_limit: int, classes: bool) -> DataFrame:
    """Repeats (row_id, s, e, rep_row, rep_s, n_rows), windows counted from 0, still divided where the anchor changes; without classes the last three mean nothing."""
    df = spread(df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(text).alias("text"))).filter((F.length("text") >= width) & F.col("row_id").isNotNull())
    is_heavy = F.col("n") > group_limit
    counts = df.mapInArrow(_counts(width), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n"))
    counts = cut(counts.groupBy(is_heavy.alias("heavy"), F.when(is_heavy, F.col("anchor")).alias("anchor")).agg(F.sum("n").alias("n")), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.filter("heavy").select("anchor")
    segments = df.mapInArrow(_segments(width), SEGMENT)
    repeats, light = None, segments
    if heavy.limit(1).count():
        heavy = broadcast_if_small(heavy)
        light = segments.join(heavy, "anchor", "left_anti")
        repeats = _heavy_repeats(segments.join(heavy, "anchor", "left_semi"), width)
    ordered = light.repartition(partitions_for(total, 150_000), "anchor").sortWithinPartitions("anchor")
    found = ordered.mapInArrow(_extend(width, classes), REPEAT)
    return found if repeats is None else found.unionByName(repeats)


def shared_spans(df: DataFrame, row_id: str, text: str, width: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Rows (row_id, span_start, span_end), 1-based and inclusive: the longest runs of shared characters.

    A character is shared if it lies in width consecutive characters of its text that occur as
    such in another row (another row_id; repeated rows with one row_id count as one record). Runs
    join windows that overlap or touch. Null ids and texts are left out, as is what is shorter
    than width; an empty table gives no row. Other columns are ignored.

    Records meet on winnowed anchors. All places of an anchor are extended to both sides at once,
    letter by letter (_repeats), against the representative of their class; record pairs are
    never formed. Anchor groups are worked off in order within partitions of bounded size; an
    anchor with more than group_limit occurrences is spread by its windows, so that any group of
    copies may be large.
    """
    repeats = _all_repeats(df, row_id, text, width, group_limit, False)
    by_row = Window.partitionBy("row_id").orderBy("s", "e")
    before = F.max("e").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    runs = repeats.select("row_id", "s", "e").distinct().withColumn("new", F.when(before + width >= F.col("s"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row_id", "run").agg((F.min("s") + 1).alias("span_start"), (F.max("e") + width).alias("span_end")).drop("run")


def maximal_repeats(df: DataFrame, row_id: str, text: str, width: int, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Rows (row_id, span_start, span_end, class_row_id, class_start, n_rows): which text each shared span has in common with whom.

    A span and its class text, which begins at class_start of the record class_row_id, are equal
    letter for letter and longer than width or as long. Of all places with the same width
    characters the one with the least row_id, then the leftmost, is the representative; a span
    reaches as far to both sides as its windows keep the same representative beside them and the
    same number of records, n_rows, that hold them. Spans of one record may overlap by width - 1
    characters. Every record of a class comes once per place, its representative included, so that
    all links between different texts are kept and no pairs are listed. Odd cases as in shared_spans.
    """
    repeats = _all_repeats(df, row_id, text, width, group_limit, True).distinct()
    beside = ["row_id", "rep_row", "n_rows", F.col("rep_s") - F.col("s")]
    by = Window.partitionBy(*beside).orderBy("s")
    runs = repeats.withColumn("new", F.when(F.lag("e").over(by) + 1 == F.col("s"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*beside[:3], beside[3].alias("d"), "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return spans.select("row_id", (F.col("s") + 1).alias("span_start"), (F.col("e") + width).alias("span_end"), F.col("rep_row").alias("class_row_id"), (F.col("s") + F.col("d") + 1).alias("class_start"), "n_rows")

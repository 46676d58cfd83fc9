"""Evaluation texts inside training texts, by a positional inverted index of all training tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.plans.shared import attach, broadcast_if_small, cut, spread

WORD = "[A-Za-z0-9]+"


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits; lower-cased only afterwards, as other letters may become ASCII ones."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored index: postings (term, doc_id, pos), one per word of docs, pos counting the words of a document from 0.

    Every document is read whole and every word is stored, so that the index serves any number
    of evaluation sets. Each task writes the postings of its documents as a segment sorted by
    the hash of the term, without a shuffle: no term, however frequent, comes together in one place. path: where
    to keep the index; without one it goes into the shared folder. doc_id must not be null.
    """
    each = spread(docs.filter("doc_id is not null").select("doc_id", "text")).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "w"))
    segments = each.select(F.lower("w").alias("term"), "doc_id", "pos").sortWithinPartitions(F.xxhash64("term"))
    if path is None:
        return cut(segments, "postings")
    segments.write.parquet(path)
    return docs.sparkSession.read.schema(segments.schema).parquet(path)


def passages(items: DataFrame, length: int, least: int) -> DataFrame:
    """Rows (item_id, w, size): the words of the items that have at least least of them, and the length of their phrases. A written table."""
    w = items.filter("item_id is not null and text is not null").select("item_id", words(F.col("text")).alias("w"))
    return cut(w.filter(F.size("w") >= max(least, 1)).distinct().withColumn("size", F.least(F.size("w"), F.lit(length))), "passages")


def _numbered(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, t) numbers the words of the passages; (item_id, w, size) has the numbers in place of the words. Written tables."""
    vocabulary = cut(known.select(F.explode("w").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    each = known.select("item_id", "size", F.posexplode("w").alias("q", "term")).join(broadcast_if_small(vocabulary), "term")
    w = F.transform(F.array_sort(F.collect_list(F.struct("q", "t"))), lambda x: x["t"])
    return vocabulary, cut(each.groupBy("item_id", "size").agg(w.alias("w")), "numbered")


def _rare_places(known: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """Rows (item_id, q, t, seed, alone): by which words of a passage its phrases are found. A written table.

    Of the size words of a phrase at most miss may be absent, so that of its miss + 1 rarest
    places one must be met, and of its miss + 2 rarest two. q is such a place, t its word; seed
    says whether it is among the first of those of some phrase, and alone that one of them has no
    further place to be met.
    """
    miss = F.expr(f"size - (size * {percent} + 99) div 100").cast("int")
    each = known.withColumn("miss", miss).select("item_id", "size", "miss", F.size("w").alias("n_words"), F.posexplode("w").alias("q", "t"))
    each = each.join(broadcast_if_small(counts), "t", "left").withColumn("cf", F.coalesce("cf", F.lit(0)))
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("size") + 1), F.least(F.col("q"), F.col("n_words") - F.col("size")))
    each = each.select("item_id", "size", "miss", "q", "t", "cf", F.explode(starts).alias("j"))
    phrase = Window.partitionBy("item_id", "j")
    ranked = each.withColumn("rn", F.row_number().over(phrase.orderBy("cf", "q"))).withColumn("absent", F.count_if(F.col("cf") == 0).over(phrase)).filter("absent <= miss and rn <= miss + 2")
    seed = F.col("rn") <= F.col("miss") + 1
    return cut(ranked.groupBy("item_id", "q", "t").agg(F.max(seed).alias("seed"), F.max(seed & (F.col("size") <= F.col("miss") + 1)).alias("alone")), "places")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of all rows one after another, how many each row has, and where they begin."""
    n = pc.list_value_length(column).to_numpy()
    return column.flatten().to_numpy(), n, np.cumsum(n) - n


def _in_place(slack: int, percent: int, rows: int = 2_000):
    """From rows (item_id, doc_id, size, starts, w, words, low): the starts at which a phrase of the words w lies in words, whose first stands at low, and its best count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in range(0, batch.num_rows, rows):
                part = batch.slice(c, rows)
                (start, n_starts, _), (w, n_w, w_at), (words, n_words, words_at) = (_lists(part.column(k)) for k in ("starts", "w", "words"))
                size, low, words = part.column("size").to_numpy(), part.column("low").to_numpy(), np.append(words, -2)
                of = np.repeat(np.arange(part.num_rows), n_starts)
                length = n_w[of]
                first = np.cumsum(length) - length
                which = np.repeat(np.arange(len(start)), length)
                q, row = np.arange(length.sum()) - first[which], of[which]
                want, at, hit = w[w_at[row] + q], start[which] - low[row] + q, np.zeros(len(q), dtype=bool)
                for d in range(-slack, slack + 1):
                    inside = (at + d >= 0) & (at + d < n_words[row])
                    hit |= inside & (words[np.where(inside, words_at[row] + at + d, len(words) - 1)] == want)
                upto = np.concatenate(([0], np.cumsum(hit)))
                ends = np.arange(len(q)) + size[row]
                n = np.where(q + size[row] <= n_w[row], upto[np.minimum(ends, len(q))] - upto[:-1], 0)
                best = np.maximum.reduceat(n, first)
                keep = np.flatnonzero(best * 100 >= size[of] * percent)
                take = pa.array(of[keep])
                yield pa.RecordBatch.from_arrays([part.column("item_id").take(take), part.column("doc_id").take(take), pa.array(start[keep]), pa.array(best[keep].astype(np.int64)), part.column("size").take(take)], ["item_id", "doc_id", "start", "n", "size"])

    return run


#: Neighbouring diagonals (the word of a document on which the first word of a passage would lie) that are looked at together.
BAND = 16


def find_passages(index: DataFrame, known: DataFrame, slack: int = 0, percent: int = 100) -> DataFrame:
    """Rows (item_id, doc_id, start, n, size): the passages' phrases in the documents, with the best count n of a phrase's words in place.

    A phrase is any size consecutive words of its passage. A word is in place if it stands within
    slack words of where the passage, its first word laid at the document's word start, would have
    it; at least percent percent of the phrase's words must be. With slack 0 and 100 percent these
    are the exact occurrences. known: as passages() gives it.

    Postings of the rarest words of each phrase give the starts in question. They are intersected
    with the offset-adjusted postings of the next rare words, in bands of starts; what is left,
    with the postings of the whole document, laid beside the passage. No phrase with so many of its
    words in place can escape: see _rare_places. A band holds at most BAND postings of each place.
    """
    vocabulary, known = _numbered(known)
    postings = cut(attach(index, vocabulary, ["term"], ["doc_id", "pos"]).select("t", "doc_id", "pos"), "wanted")
    counts = cut(postings.groupBy("t").agg(F.count("*").alias("cf")), "counts")
    met = attach(postings, _rare_places(known, counts, percent), ["t"], ["doc_id", "pos"]).withColumn("d", F.col("pos") - F.col("q"))
    reach = 2 * slack  # two words in place for one start may be so far from each other's
    band = lambda d: F.floor(d / BAND)
    bands = F.when(F.col("seed"), F.sequence(band(F.col("d") - reach), band(F.col("d") + reach))).otherwise(F.array(band(F.col("d"))))
    met = met.select("item_id", "doc_id", F.explode(bands).alias("band"), F.struct("d", "q", "seed", "alone").alias("x")).groupBy("item_id", "doc_id", "band").agg(F.collect_set("x").alias("h"))
    seeds = F.expr(f"filter(h, x -> x.seed and (x.alone or exists(h, y -> y.q <> x.q and abs(y.d - x.d) <= {reach})))")
    starts = F.array_distinct(F.flatten(F.transform(seeds, lambda x: F.sequence(x["d"] - slack, x["d"] + slack))))
    starts = cut(met.select("item_id", "doc_id", starts.alias("starts")).filter("size(starts) > 0"), "starts")
    left = broadcast_if_small(cut(starts.select("doc_id").distinct(), "left"))
    # The words of a document by their place, -1 for those that no passage has; a document delivered twice has each of them twice.
    beside = postings.join(left, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("pos", "t"))).alias("p"))
    gap = F.transform("p", lambda x, i: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), x["pos"] - F.when(i > 0, F.get("p", i - 1)["pos"]).otherwise(-1) - 1), F.array(x["t"])))
    laid = attach(starts, known, ["item_id"], ["doc_id"]).join(beside.select("doc_id", F.flatten(gap).alias("words")), "doc_id")
    low = F.greatest(F.array_min("starts") - slack, F.lit(0))
    laid = laid.withColumn("low", low).withColumn("words", F.slice("words", (F.col("low") + 1).cast("int"), F.greatest(F.array_max("starts") + slack + F.size("w") - F.col("low"), F.lit(0)).cast("int")))
    kind = dict(laid.dtypes)
    found = laid.select("item_id", "doc_id", F.col("size").cast("bigint").alias("size"), F.col("starts").cast("array<bigint>").alias("starts"), "w", "words", F.col("low").cast("bigint").alias("low")).mapInArrow(_in_place(slack, percent), f"item_id {kind['item_id']}, doc_id {kind['doc_id']}, start bigint, n bigint, size bigint")
    return found.distinct()


def leaks(docs: DataFrame, items: DataFrame, length: int = 12, least: int = 6) -> DataFrame:
    """Rows (doc_id, item_id), each once: the document contains length consecutive words of the item, or all of a shorter item.

    Items of fewer than least words, null and empty texts are no cases. Words as in words().
    docs: doc_id, text; items: item_id, text; further columns are ignored. Rows with null ids are
    left out; a doc_id or item_id delivered twice must carry one text. Empty tables give no rows.
    """
    return find_passages(build_index(docs), passages(items, length, least)).select("doc_id", "item_id").distinct()


def near_leaks(docs: DataFrame, items: DataFrame, length: int = 12, least: int = 6, slack: int = 1, percent: int = 90) -> DataFrame:
    """Rows (doc_id, item_id, n): of a phrase of the item at least percent percent of the words stand within slack words of their place; n is the most that do.

    Phrases, odd cases and ignored columns as for leaks().
    """
    found = find_passages(build_index(docs), passages(items, length, least), slack, percent)
    return found.groupBy("doc_id", "item_id").agg(F.max("n").cast("bigint").alias("n"))

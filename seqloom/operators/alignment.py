"""Base-level work: CIGAR walks, reference bases, mismatches, coverage, pileups, MD, NM and read features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.cigar import is_cigar, read_span, reference_span
from seqloom.plans.shared import broadcast_if_small, cut, running_total, spread

OP = "struct<op:string,len:bigint,rp:bigint,fp:bigint,mp:bigint>"
#: Reference chunks hold size letters of their own and overlap more of the next, so that a short read needs one chunk.
CHUNK, OVERLAP = 1024, 512
#: Reads that begin in a chunk beyond which its bases are counted before the shuffle.
HOT = 50_000


def operations(cigar: Column, pos: Column) -> Column:
    """The operations of a CIGAR as structs: op, len, and where each begins: rp in the read and fp in the reference (1-based), mp among aligned bases (0-based)."""
    lens = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.try_cast("bigint"))
    codes = F.regexp_extract_all(cigar, F.lit("[0-9]+([MIDNSHP=X])"), F.lit(1))
    zero = F.struct(F.array().cast(f"array<{OP}>").alias("ops"), F.lit(1).cast("bigint").alias("rp"), pos.cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("mp"))

    def step(a: Column, x: Column) -> Column:
        n, c = x["len"], x["op"]
        add = lambda ops: F.when(c.isin(*ops), n).otherwise(F.lit(0))
        one = F.struct(c.alias("op"), n.alias("len"), a["rp"].alias("rp"), a["fp"].alias("fp"), a["mp"].alias("mp"))
        return F.struct(F.array_append(a["ops"], one).cast(f"array<{OP}>").alias("ops"), (a["rp"] + add("MIS=X")).alias("rp"), (a["fp"] + add("MDN=X")).alias("fp"), (a["mp"] + add("M=X")).alias("mp"))

    return F.aggregate(F.arrays_zip(lens.alias("len"), codes.alias("op")), zero, step, lambda a: a["ops"])


def placed(reads: DataFrame, *keep: str) -> DataFrame:
    """Records that lie on a reference with a CIGAR that fits their bases: row_id, rname, pos, cigar, seq (upper case), n, span, ops and keep.

    Others (null or * in rname, cigar or seq, no position, malformed or unfitting CIGAR) have no base-level meaning and are left out.
    """
    fit = is_cigar(F.col("cigar")) & F.col("rname").isNotNull() & (F.col("rname") != "*") & (F.col("pos") >= 1) & (F.col("seq") != "*") & (read_span(F.col("cigar")) == F.length("seq"))
    df = spread(reads.select("row_id", "rname", "pos", "cigar", "seq", *keep)).filter(fit)
    df = df.select("row_id", "rname", "pos", "cigar", F.upper("seq").alias("seq"), F.length("seq").alias("n"), reference_span(F.col("cigar")).alias("span"), *keep)
    return df.withColumn("ops", operations(F.col("cigar"), F.col("pos")))


def chunks_of(lines: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(rname, chunk, seq) from whole sequences (rname, seq); chunk c begins at position c * size + 1. Letters as normalise() makes them."""
    at = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int"))
    return lines.filter("length(seq) > 0").select("rname", F.explode(at).alias("chunk"), "seq").select("rname", F.col("chunk").cast("bigint").alias("chunk"), F.expr(f"substring(seq, chunk * {size} + 1, {size + overlap})").alias("seq"))


def range_md5(ranges: DataFrame, chunks: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """Rows (keys, md5): of each range (keys, rname, s, e: from s to e - 1) the MD5 of its reference letters, N where there are none; 32 zeros for an empty one.

    A range takes the chunks that it touches; its letters come together in its own row.
    """
    touched = ranges.filter("e > s").select(*dict.fromkeys([*keys, "rname"]), "s", "e", F.explode(F.expr(f"sequence((s - 1) div {size}, (e - 2) div {size})")).alias("chunk"))
    ref = chunks.select(F.col("rname").alias("_name"), F.col("chunk").alias("_chunk"), F.substring("seq", 1, size).alias("_seq"))
    met = touched.join(ref, (F.col("rname") == F.col("_name")) & (F.col("chunk") == F.col("_chunk")), "left")
    parts = F.array_sort(F.collect_list(F.struct("chunk", F.rpad(F.coalesce("_seq", F.lit("")), size, "N").alias("text"))))
    whole = met.groupBy(*keys, "s", "e").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("_t"))
    md5 = whole.select(*keys, F.md5(F.expr(f"substring(_t, cast((s - 1) % {size} + 1 as int), cast(e - s as int))")).alias("md5"))
    return ranges.select(*keys).join(md5, keys, "left").select(*keys, F.coalesce("md5", F.lit("0" * 32)).alias("md5"))


def with_reference(reads: DataFrame, chunks: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """reads (placed) with ref: the reference from pos on over span + n letters, N where there is none.

    A read that needs at most overlap letters meets one chunk in one equi-join. Longer ones
    are spread over the chunks they touch and put together again.
    """
    need = (F.col("span") + F.col("n")).cast("bigint")
    reads = reads.withColumn("need", need).withColumn("chunk", F.expr(f"(pos - 1) div {size}"))
    ref = chunks.select(F.col("rname").alias("_name"), F.col("chunk").alias("_chunk"), F.col("seq").alias("_seq"))
    met = (F.col("rname") == F.col("_name")) & (F.col("chunk") == F.col("_chunk"))
    padded = lambda text: F.rpad(F.coalesce(text, F.lit("")), F.col("need").cast("int"), F.lit("N"))
    short = reads.filter(F.col("need") <= overlap).join(ref, met, "left").withColumn("ref", padded(F.expr(f"substring(_seq, (pos - 1) % {size} + 1, need)"))).drop("_name", "_chunk", "_seq")
    long = reads.filter(F.col("need") > overlap)
    touched = long.select("row_id", "rname", "pos", "need", F.explode(F.sequence(F.col("chunk"), F.expr(f"(pos + need - 2) div {size}"))).alias("chunk")).join(ref, met, "left")
    part = F.struct("chunk", F.rpad(F.substring(F.coalesce("_seq", F.lit("")), 1, size), size, "N").alias("part"))
    whole = touched.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "").alias("_whole"))
    long = long.join(whole, "row_id").withColumn("ref", padded(F.expr(f"substring(_whole, (pos - 1) % {size} + 1, need)"))).drop("_whole")
    return short.unionByName(long).drop("need", "chunk")


#: Per base of an operation o: its place in it from 0, the read's letter and the reference's, as fields `0`, `1` and `2`.
ZIPPED = "arrays_zip(sequence(0L, o.len - 1), split(substring(seq, cast(o.rp as int), cast(o.len as int)), ''), split(substring(ref, cast(o.fp - pos + 1 as int), cast(o.len as int)), ''))"


def bases(reads: DataFrame, *keep: str, ops: str = "M=X") -> DataFrame:
    """One row per read base of the given operations: row_id, rname, op, rpos, refpos, base, refb and keep. reads as with_reference gives them."""
    each = reads.select("row_id", "rname", "pos", "seq", "ref", *keep, F.explode(F.filter("ops", lambda o: o["op"].isin(*ops) & (o["len"] > 0))).alias("o"))
    each = each.select("row_id", "rname", *keep, "o", F.explode(F.expr(ZIPPED)).alias("x"))
    return each.select("row_id", "rname", F.col("o.op").alias("op"), F.expr("o.rp + x.`0`").alias("rpos"), F.expr("o.fp + x.`0`").alias("refpos"), F.col("x.`1`").alias("base"), F.col("x.`2`").alias("refb"), *keep)


def coverage_steps(reads: DataFrame, start: str = "pos", span: str = "span") -> DataFrame:
    """Rows (rname, p, d): by how much the depth changes at a position. Steps of parts of the reads add up to those of all."""
    ends = reads.filter(f"{span} > 0").select("rname", F.explode(F.array(F.struct(F.col(start).cast("bigint").alias("p"), F.lit(1).alias("d")), F.struct((F.col(start) + F.col(span)).cast("bigint").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    return ends.groupBy("rname", "x.p").agg(F.sum("x.d").alias("d")).filter("d <> 0")


def runs_of_steps(steps: DataFrame) -> DataFrame:
    """Rows (rname, start_pos, end_pos, depth) from steps, one or several for a position."""
    steps = steps.groupBy("rname", "p").agg(F.sum("d").alias("d")).filter("d <> 0")
    depth = running_total(steps, ["rname"], "p", "d", "depth").withColumn("b", F.expr("p >> 16"))
    # The next change lies in the block or is the first of the next block that has one.
    inside = Window.partitionBy("rname", "b").orderBy("p")
    first = depth.groupBy("rname", "b").agg(F.min("p").alias("f")).withColumn("_next", F.lead("f").over(Window.partitionBy("rname").orderBy("b"))).select("rname", "b", "_next")
    depth = depth.join(first, ["rname", "b"]).withColumn("end_pos", F.coalesce(F.lead("p").over(inside), "_next") - 1)
    return depth.filter("depth > 0").select("rname", F.col("p").alias("start_pos"), "end_pos", "depth")


def coverage_runs(reads: DataFrame, start: str = "pos", span: str = "span") -> DataFrame:
    """Rows (rname, start_pos, end_pos, depth): maximal runs of positions between two changes of depth, depth > 0.

    M, =, X, D and N all cover. Only the ends of reads are shuffled, not their bases.
    """
    return runs_of_steps(coverage_steps(reads, start, span))


def _by_position(reads: DataFrame, chunks: DataFrame, keys: list[str], counts: list[Column], wanted: str = "true") -> DataFrame:
    """Counts over the aligned bases of each position, in one shuffle of texts, not of bases. reads as placed() gives them.

    Aligned stretches are cut where a chunk of the reference ends and meet their chunk as texts;
    bases are only told apart there. The reads of chunks in which more than HOT reads begin, and
    of the chunks behind those, are counted where they are, and only their counts are sent.
    """
    begun = reads.groupBy("rname", F.expr(f"(pos - 1) div {CHUNK}").alias("chunk")).agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    hot = broadcast_if_small(cut(begun.select("rname", F.explode(F.array("chunk", F.col("chunk") + 1)).alias("chunk")).distinct(), "hot"))
    stretch = reads.select("rname", "seq", F.explode(F.filter("ops", lambda o: o["op"].isin("M", "=", "X") & (o["len"] > 0))).alias("o"))
    stretch = stretch.select("rname", "seq", "o", F.explode(F.expr(f"sequence((o.fp - 1) div {CHUNK}, (o.fp + o.len - 2) div {CHUNK})")).alias("chunk"))
    stretch = stretch.withColumn("at", F.expr(f"greatest(o.fp, chunk * {CHUNK} + 1)")).withColumn("size", F.expr(f"least(o.fp + o.len, (chunk + 1) * {CHUNK} + 1) - at"))
    stretch = stretch.select("rname", "chunk", "at", "size", F.expr("substring(seq, cast(o.rp + at - o.fp as int), cast(size as int))").alias("s"))

    def counted(part: DataFrame, ref: DataFrame) -> DataFrame:
        letters = F.rpad(F.expr(f"substring(coalesce(_seq, ''), cast(at - chunk * {CHUNK} as int), cast(size as int))"), F.col("size").cast("int"), F.lit("N"))
        met = part.join(ref.withColumnRenamed("seq", "_seq"), ["rname", "chunk"], "left").select("rname", "chunk", "at", "s", letters.alias("r"))
        each = met.select("rname", "chunk", "at", F.posexplode(F.expr("arrays_zip(split(s, ''), split(r, ''))")).alias("i", "x"))
        each = each.select("rname", "chunk", (F.col("at") + F.col("i")).alias("refpos"), F.col("x.`0`").alias("base"), F.col("x.`1`").alias("refb")).filter(wanted)
        return each.groupBy("rname", "chunk", *keys).agg(*counts).drop("chunk")

    there = ["rname", "chunk"]
    cold = counted(stretch.join(hot, there, "left_anti").repartition(*there), chunks.join(hot, there, "left_anti"))
    return cold.unionByName(counted(stretch.join(hot, there, "left_semi"), broadcast_if_small(cut(chunks.join(hot, there, "left_semi"), "chunks"))))


def mismatches(reads: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (rname, refpos, n): aligned bases that differ from the reference, per position."""
    return _by_position(reads, chunks, ["refpos"], [F.count("*").alias("n")], "base <> refb")


def pileup(reads: DataFrame, chunks: DataFrame, most: int = 15) -> DataFrame:
    """Rows (rname, refpos, refb, a, c, g, t): saturating counts of the aligned bases, at most 2**bits - 1 each."""
    count = lambda b: F.least(F.count_if(F.col("base") == b), F.lit(most)).cast("int").alias(b.lower())
    return _by_position(reads, chunks, ["refpos", "refb"], [count(b) for b in "ACGT"])


def should_store(piles: DataFrame, min_hits: int, most: int = 10) -> DataFrame:
    """Positions with a coverage estimate of at most most and min_hits or more of a base other than the reference's."""
    hits = F.lit(False)
    for b in "ACGT":
        hits = hits | ((F.col("refb") != b) & (F.col(b.lower()) >= min_hits))
    return piles.filter((F.expr("a + c + g + t") <= most) & hits)


def substitution_counts(reads: DataFrame) -> DataFrame:
    """Rows (refb, base, n) of all 20 pairs of different letters of ACGTN, 0 where a pair doesn't occur."""
    spark = reads.sparkSession
    pairs = spark.createDataFrame([(r, b) for r in "ACGTN" for b in "ACGTN" if r != b], "refb string, base string")
    found = bases(reads).filter("base <> refb").groupBy("refb", "base").agg(F.count("*").alias("n"))
    return pairs.join(found, ["refb", "base"], "left").select("refb", "base", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def substitution_codes(counts: DataFrame) -> DataFrame:
    """Rows (refb, base, code): 0 to 3 by falling count, ties in the order ACGTN."""
    order = F.expr("instr('ACGTN', base)")
    return counts.select("refb", "base", (F.row_number().over(Window.partitionBy("refb").orderBy(F.desc("n"), order)) - 1).alias("code"))


def pack_codes(codes: DataFrame) -> DataFrame:
    """Rows (refb, packed): the codes of the other letters, two bits each, in the order ACGTN from the high bits down."""
    rank = F.row_number().over(Window.partitionBy("refb").orderBy(F.expr("instr('ACGTN', base)")))
    return codes.withColumn("_s", F.lit(8) - 2 * rank).groupBy("refb").agg(F.sum(F.expr("shiftleft(code, _s)")).cast("int").alias("packed"))


def unpack_codes(packed: DataFrame) -> DataFrame:
    """The inverse of pack_codes."""
    each = packed.select("refb", "packed", F.posexplode(F.expr("filter(array('A', 'C', 'G', 'T', 'N'), x -> x <> refb)")).alias("i", "base"))
    return each.select("refb", "base", F.expr("shiftright(packed, 6 - 2 * i) & 3").alias("code"))


def _aligned_events() -> str:
    none = "cast(array() as array<struct<m:bigint,text:string,use:bigint>>)"
    event = "named_struct('m', o.mp + x.`0`, 'text', x.`2`, 'use', 1L)"
    gone = "array(named_struct('m', o.mp, 'text', concat('^', substring(ref, cast(o.fp - pos + 1 as int), cast(o.len as int))), 'use', 0L))"
    return f"flatten(transform(ops, o -> case when o.op in ('M', '=', 'X') and o.len > 0 then transform(filter({ZIPPED}, x -> x.`1` <> x.`2`), x -> {event}) when o.op = 'D' then {gone} else {none} end))"


def md_and_nm(reads: DataFrame) -> DataFrame:
    """Rows (row_id, md, nm): the mismatch text and the number of mismatched, inserted and deleted bases. reads as with_reference gives them."""
    df = reads.withColumn("ev", F.expr(_aligned_events())).withColumn("aligned", F.expr("aggregate(filter(ops, o -> o.op in ('M', '=', 'X')), 0L, (a, o) -> a + o.len)"))
    walk = "aggregate(ev, named_struct('s', '', 'at', 0L), (a, e) -> named_struct('s', concat(a.s, cast(e.m - a.at as string), e.text), 'at', e.m + e.use))"
    df = df.withColumn("w", F.expr(walk))
    gaps = F.expr("aggregate(filter(ops, o -> o.op in ('I', 'D')), 0L, (a, o) -> a + o.len)")
    return df.select("row_id", F.expr("concat(w.s, cast(aligned - w.at as string))").alias("md"), (F.expr("aggregate(ev, 0L, (a, e) -> a + e.use)") + gaps).alias("nm"))


FEATURE = "struct<pos:bigint,op:string,text:string,len:bigint>"


def features(reads: DataFrame) -> DataFrame:
    """reads with features: what a record has beyond the reference, in read order, as (pos, op, text, len).

    X a substitution and B another read base (text: the base; B where it or the reference isn't
    one of ACGTN), i an inserted base, S clipped bases, D and N gaps, H and P with their length.
    """
    f = lambda pos, op, text, n: f"named_struct('pos', {pos}, 'op', {op}, 'text', {text}, 'len', {n})"
    known = "instr('ACGTN', x.`1`) > 0 and instr('ACGTN', x.`2`) > 0"
    sub = f("o.rp + x.`0`", f"if({known}, 'X', 'B')", "x.`1`", "1L")
    e = f"""flatten(transform(filter(ops, o -> o.len > 0), o -> case
      when o.op in ('M', '=', 'X') then transform(filter({ZIPPED}, x -> x.`1` <> x.`2`), x -> {sub})
      when o.op = 'I' then transform(sequence(0L, o.len - 1), i -> {f("o.rp + i", "'i'", "substring(seq, cast(o.rp + i as int), 1)", "1L")})
      when o.op = 'S' then array({f("o.rp", "'S'", "substring(seq, cast(o.rp as int), cast(o.len as int))", "o.len")})
      else array({f("o.rp", "o.op", "''", "o.len")}) end))"""
    return reads.withColumn("features", F.expr(e).cast(f"array<{FEATURE}>"))


def _walk(found: list[dict], n: int, ref: str) -> tuple[str, str]:
    """CIGAR (M for all aligned bases) and bases of a read of n bases."""
    ops: list[list] = []
    seq: list[str] = []
    at, ref_at = 1, 0

    def put(op: str, count: int) -> None:
        if count > 0 and ops and ops[-1][0] == op:
            ops[-1][1] += count
        elif count > 0:
            ops.append([op, count])

    def align(upto: int) -> None:
        nonlocal at, ref_at
        put("M", upto - at)
        seq.append(ref[ref_at : ref_at + upto - at])
        ref_at += upto - at
        at = upto

    for x in found:
        align(x["pos"])
        if x["op"] in "XB":
            put("M", 1)
            seq.append(x["text"])
            at, ref_at = at + 1, ref_at + 1
        elif x["op"] in "iS":
            put("I" if x["op"] == "i" else "S", x["len"])
            seq.append(x["text"])
            at += x["len"]
        else:
            put(x["op"], x["len"])
            ref_at += x["len"] if x["op"] in "DN" else 0
    align(n + 1)
    return "".join(f"{c}{o}" for o, c in ops), "".join(seq)


def restored(reads: DataFrame) -> DataFrame:
    """Rows (row_id, cigar, seq) from the features, the reference and the read length alone. reads as features() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_walk(f, n, ref) for f, n, ref in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], ["row_id", "cigar", "seq"])

    return reads.select("row_id", "features", "n", "ref").mapInArrow(run, "row_id bigint, cigar string, seq string")


def feature_span(found: Column, n: Column) -> Column:
    """Reference bases that a read of n bases covers, from its features."""
    return F.aggregate(found, n.cast("bigint"), lambda a, x: a + F.when(x["op"].isin("D", "N"), x["len"]).when(x["op"].isin("i", "S"), -x["len"]).otherwise(0))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups, one by one, of rows that come sorted by keys, however they are cut into batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            c = batch.column(k)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        new[0] = bool(held) and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
        edges = np.flatnonzero(new).tolist()
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if new[a] and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tracked(t: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Coverage and mismatches of the rows of one batch, which come in the order of their positions."""
    pos, n, end = (t.column(c).to_numpy() for c in ("pos", "n", "stop"))
    offsets = np.concatenate(([0], np.cumsum(n)))
    x = np.repeat(pos, n) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    cover, ends = np.empty(len(x), np.int64), np.empty(0, np.int64)
    for k in range(len(pos)):  # earlier reads begin no later, so that those cover a position that end behind it
        ends = np.insert(ends, np.searchsorted(ends, end[k]), end[k])
        cover[offsets[k] : offsets[k + 1]] = k + 1 - np.searchsorted(ends, x[offsets[k] : offsets[k + 1]], side="right")
    wrong = t.column("places").combine_chunks()
    where, of = wrong.flatten().to_numpy(), np.repeat(np.arange(len(pos)), np.diff(wrong.offsets.to_numpy()))
    # Positions and reads in one key: the mismatches at x up to read k lie between two ranks.
    low, size = min(x.min(initial=0), where.min(initial=0)), len(pos) + 1
    keys = np.sort((where - low) * size + of)
    mine = (x - low) * size
    found = np.searchsorted(keys, mine + np.repeat(np.arange(len(pos)), n), side="right") - np.searchsorted(keys, mine, side="left")
    make = lambda v: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int64()))
    return make(cover), make(found)


def prefix_tracks(reads: DataFrame, *keep: str) -> DataFrame:
    """Rows (row_id, coverage, mismatches, keep...): per read base i the number of earlier reads of the batch, and the read itself, that cover position pos + i, and of their mismatches there.

    reads as with_reference gives them, with batch and rn. Positions follow the read length, not
    the CIGAR. Whole batches, bounded by their size, are walked in one task each; no base is shuffled.
    """
    places = f"flatten(transform(filter(ops, o -> o.op in ('M', '=', 'X') and o.len > 0), o -> transform(filter({ZIPPED}, x -> x.`1` <> x.`2`), x -> o.fp + x.`0`)))"
    df = reads.select("rname", "batch", "rn", "row_id", F.col("pos").cast("bigint").alias("pos"), F.col("n").cast("bigint").alias("n"), F.expr("cast(pos + greatest(span, 0) as bigint)").alias("stop"), F.expr(places).alias("places"), *[F.col(k).alias(f"k_{k}") for k in keep])
    schema = ", ".join(f"{k} {t}" for k, t in reads.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["rname", "batch"]):
            cover, found = _tracked(t)
            yield pa.RecordBatch.from_arrays([t.column("row_id").combine_chunks(), cover, found, *[t.column(f"k_{k}").combine_chunks() for k in keep]], ["row_id", "coverage", "mismatches", *keep])

    ordered = df.repartition("rname", "batch").sortWithinPartitions("rname", "batch", "rn")
    return ordered.mapInArrow(run, f"row_id bigint, coverage array<bigint>, mismatches array<bigint>{', ' + schema if keep else ''}")

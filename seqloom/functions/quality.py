"""Quality scores: binning tables and the preservation rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First score of each bin and the score that stands for it. Lower scores stay.
ILLUMINA = ((2, 6), (10, 15), (20, 22), (25, 27), (30, 33), (35, 37), (40, 40))
NCBI = ((3, 9), (15, 17), (20, 22), (25, 28), (30, 35))
DEFAULT = 30
DROP, BIN, PRESERVE = "drop", "bin", "preserve"


def binned(score: Column, table: tuple[tuple[int, int], ...] = ILLUMINA) -> Column:
    out = F.when(score < table[0][0], score)
    for (_, value), (upper, _) in zip(table, table[1:]):
        out = out.when(score < upper, value)
    return out.otherwise(table[-1][1])


def scores(qual: Column) -> Column:
    """Scores from text, 33 for 0."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)


def as_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda q: F.chr(q + 33)), "")


@dataclass(frozen=True)
class Policy:
    """read: None or (all | unplaced | lower | higher, threshold); bases: (kind, threshold) that are alternatives to each other."""

    read: tuple[str, int] | None
    bases: tuple[tuple[str, int], ...]
    treatment: str


_BASES = {"R": "match", "N": "mismatch", "D": "flanking_deletion", "I": "insertion"}
_READS = {"*": "all", "U": "unplaced"}


def _number(text: str) -> tuple[int, str]:
    digits = text[: len(text) - len(text.lstrip("0123456789"))]
    return int(digits or 0), text[len(digits) :]


def parse_policies(spec: str) -> list[Policy]:
    """Rules such as R8-N40 or m5, separated by dashes, in the order of their application: drop, bin, preserve.

    R, N, D, I, U and * are followed by their treatment: 0 or nothing drops, 40 preserves, any
    other number bins. X, P, M and m are followed by a threshold; P drops unless a treatment
    follows after _, the others preserve.
    """
    out = []
    for part in filter(None, spec.split("-")):
        read, bases, treatment, rest = None, [], None, part
        while rest:
            code, (n, rest) = rest[0], _number(rest[1:])
            given = DROP if n == 0 else PRESERVE if n == 40 else BIN
            if code in _BASES:
                bases.append((_BASES[code], 0))
                treatment = given
            elif code in _READS:
                read, treatment = (_READS[code], 0), given
            elif code == "_":
                treatment = given
            elif code == "P":
                bases.append(("pileup", n))
                treatment = DROP
            elif code == "X":
                bases.append(("lower_coverage", n))
            elif code in "Mm":
                read = ("higher" if code == "M" else "lower", n)
            else:
                raise ValueError(f"unknown category {code!r} in {part!r}")
            treatment = treatment or PRESERVE
        out.append(Policy(read, tuple(bases), treatment))
    return sorted(out, key=lambda p: (DROP, BIN, PRESERVE).index(p.treatment))


def needs_tracks(policies: list[Policy]) -> bool:
    return any(kind in ("lower_coverage", "pileup") for p in policies for kind, _ in p.bases)


#: Per base x of place j whether a category holds; x has q, _s (the base), _r (the reference base), _o (the operation), _coverage and _mismatches.
_HOLDS = {"match": "x._s = x._r", "mismatch": "x._s <> x._r", "insertion": "x._o = 'I'", "flanking_deletion": "exists(gaps, g -> j = g - 1 or j = g)", "lower_coverage": "x._coverage < {}", "pileup": "x._mismatches > {}"}


def _per_base(what: str) -> str:
    """The text made of what gives for each operation o of a placed read that has bases."""
    return f"array_join(transform(filter(ops, o -> o.op in ('M', 'I', 'S', '=', 'X')), o -> {what}), '')"


def apply_policies(df: DataFrame, policies: list[Policy]) -> DataFrame:
    """df with scores (kept, -1 where dropped), forced (the whole array is stored) and restored (dropped ones as DEFAULT).

    df: q (scores), flag, mapq, and of placed reads seq, ref, pos, ops, also coverage and
    mismatches (arrays, per base) where a rule asks for them; ops is null for others, to which no
    base category applies. A rule of base categories that hits more than half of the read forces
    the whole array; null q stays null. All rules are one expression over a base, so that the
    arrays are walked once, and once more for each rule that counts its hits.
    """
    asked = {kind for p in policies for kind, _ in p.bases}
    arrays = {"q": "q"}
    if asked & {"match", "mismatch"}:
        letters = _per_base("substring(ref, cast(o.fp - pos + 1 as int), cast(o.len as int))")
        arrays |= {"_s": "split(coalesce(seq, ''), '')", "_r": f"split(coalesce({letters}, ''), '')"}
    if "insertion" in asked:
        arrays["_o"] = f"split(coalesce({_per_base('repeat(o.op, cast(o.len as int))')}, ''), '')"
    arrays |= {f"_{c}": f"coalesce({c}, cast(array() as array<bigint>))" for c, kind in (("coverage", "lower_coverage"), ("mismatches", "pileup")) if kind in asked}
    df = df.withColumns({n: F.expr(e) for n, e in arrays.items() if n != "q"} | {"gaps": F.expr("transform(filter(ops, o -> o.op = 'D'), o -> o.rp)")})
    df = df.withColumn("cells", F.arrays_zip(*arrays)).drop(*[n for n in arrays if n != "q"])
    state, forced = "-1", F.lit(False)
    for i, p in enumerate(policies):
        kind, n = p.read or ("all", 0)
        applies = {"all": "true", "unplaced": "(flag & 4) <> 0", "lower": f"coalesce(mapq, 0) < {n}", "higher": f"coalesce(mapq, 0) > {n}"}[kind]
        value = {DROP: "-1", PRESERVE: "x.q"}.get(p.treatment) or _binned_text("x.q")
        if not p.bases:
            state = state if p.treatment == DROP else f"if({applies}, {value}, {state})"
            forced = F.when(F.expr(applies), F.lit(p.treatment != DROP)).otherwise(forced)
            continue
        applies = f"({applies} and ops is not null)"
        holds = " or ".join(f"coalesce({_HOLDS[k].format(n)}, false)" for k, n in p.bases)
        df = df.withColumn(f"_hits{i}", F.expr(f"if({applies}, size(filter(cells, (x, j) -> {holds})), 0)"))
        state = f"if({applies} and ({holds}), {value}, {state})"
        forced = forced | (F.expr(applies) & (F.col(f"_hits{i}") > F.floor(F.size("q") / 2)))
    df = df.withColumn("forced", forced).withColumn("scores", F.expr(f"transform(cells, (x, j) -> {state})"))
    return df.withColumn("restored", F.transform("scores", lambda s: F.when(s < 0, DEFAULT).otherwise(s))).drop("gaps", "cells", *[f"_hits{i}" for i in range(len(policies))])


def _binned_text(q: str, table: tuple[tuple[int, int], ...] = ILLUMINA) -> str:
    cases = " ".join(f"when {q} < {upper} then {value}" for (_, value), (upper, _) in zip(table, table[1:]))
    return f"case when {q} < {table[0][0]} then {q} {cases} else {table[-1][1]} end"


def kept_as_features(df: DataFrame, row: str = "row_id") -> DataFrame:
    """Rows (row, pos, op, text, len) of the scores that survive rules where the whole array isn't forced: features Q with the score as text.

    df: as apply_policies gives it. pos counts from 1. Put behind the read features of the same
    place they are the order in which a container stores them.
    """
    each = df.filter("not forced").select(row, F.posexplode("scores").alias("i", "s")).filter("s >= 0")
    return each.select(row, (F.col("i") + 1).cast("bigint").alias("pos"), F.lit("Q").alias("op"), F.col("s").cast("string").alias("text"), F.lit(1).cast("bigint").alias("len"))

"""Commands: python -m seqloom.cli COMMAND ...; @FILE stands for the arguments in a file, one per line."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import flags, quality, region, selector
from seqloom.functions.cigar import is_cigar, reference_span
from seqloom.operators import alignment as al
from seqloom.operators import compare, merge, storage
from seqloom.sources import binary, cipher, container, crai, detect, fasta, fastq, files, sam

FIELDS = [f.lower() for f in selector.FIELDS]


def read(spark: SparkSession, path: str, reference: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and contigs (sequence_id, name, length) of a file or folder of any kind that has a reader."""
    first = files.files_below(path, ".sam", ".gz", ".bam", ".cram", ".txt")[0]
    what = detect.kind_of(first)
    if what == "bam":
        binary.register(spark)
        with files.open_file(first) as f:
            known = binary.read_header(binary.Blocks(f))
        return spark.read.format("seqloom_bam").load(path), _contigs(spark, known)
    if what == "cram":
        binary.register(spark)
        text = container.read_header(first)[1]
        cells = [dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x) for line in text.splitlines() if line.startswith("@SQ")]
        return spark.read.format("seqloom_cram").option("reference", fasta.find_reference(first, reference)).load(path), _contigs(spark, [(c["SN"], int(c["LN"])) for c in cells])
    lines = sam.read_header(spark, path).filter("kind = 'SQ'").groupBy("line").agg(F.max(F.when(F.col("key") == "SN", F.col("value"))).alias("n"), F.max(F.when(F.col("key") == "LN", F.col("value"))).alias("l")).collect()
    return sam.read_sam(spark, path).drop("n_cells"), _contigs(spark, sorted({(r["n"], int(r["l"])) for r in lines}))


def _contigs(spark: SparkSession, known: Sequence[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(known)], "sequence_id int, name string, length bigint")


def _with_end(df: DataFrame) -> DataFrame:
    span = F.when(is_cigar(F.col("cigar")), reference_span(F.col("cigar"))).otherwise(0)
    return df.withColumn("span", span).withColumn("end", region.last_base())


def _in(df: DataFrame, where: str | None) -> DataFrame:
    return region.query(_with_end(df), region.Region.parse(where), "overlapping").drop("span", "end") if where else df


def _captured(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Tags: all but ignored ones, or those listed, or none."""
    listed = lambda text: [t for t in text.split(":") if t]
    if a.capture_all_tags:
        kept = F.map_filter("tags", lambda k, v: ~k.isin(*listed(a.ignore_tags), "RG")) if a.ignore_tags else F.col("tags")
    else:
        kept = F.map_filter("tags", lambda k, v: k.isin(*listed(a.capture_tags), "RG"))
    return df.withColumn("tags", kept)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return al.chunks_of(fasta.read_fasta(spark, path).withColumn("seq", F.upper("seq")))


def cram(spark: SparkSession, a: argparse.Namespace) -> None:
    df, contigs = read(spark, a.input)
    df = _captured(df, a)
    if not a.preserve_read_names:
        df = df.withColumn("qname", F.xxhash64("qname").cast("string"))  # mates keep equal names
    if not a.lossless:
        # A record's number is needed to bring its scores and its alignment together again.
        from seqloom.plans.shared import cut

        df = cut(df.withColumn("row_id", F.monotonically_increasing_id()), "records")
        rules = quality.parse_policies(a.lossy)
        at = al.with_reference(al.placed(df), _chunks(spark, a.reference))
        if quality.needs_tracks(rules):
            from seqloom.operators.pairing import batched

            order = batched(df.select("row_id", "rname", "pos"), a.max_slice_size).select(F.col("row_id").alias("_id"), "batch", "rn")
            at = al.prefix_tracks(at.join(order, F.col("row_id") == F.col("_id")).drop("_id"), "pos", "cigar", "seq", "ref").withColumn("ops", al.operations(F.col("cigar"), F.col("pos"))).drop("cigar")
        else:
            at = at.select("row_id", "pos", "seq", "ref", "ops")
        scores = df.filter("qual <> '*' and length(qual) = length(seq)").select("row_id", "flag", "mapq", quality.scores(F.col("qual")).alias("q"))
        ruled = quality.apply_policies(scores.join(at, "row_id", "left"), rules).select("row_id", "scores", "forced", quality.as_text(F.col("restored")).alias("_q"))
        df = df.join(ruled, "row_id", "left").withColumn("qual", F.coalesce("_q", F.lit("*"))).withColumn("forced", F.coalesce("forced", F.lit(False)))
    groups = df.select(F.regexp_extract(F.coalesce(F.col("tags")["RG"], F.lit("")), "^Z:(.*)$", 1).alias("rg")).filter("rg <> ''").distinct()
    plain = f"{a.output}/plain" if a.encrypt else a.output
    container.write_cram(df, contigs, a.reference, plain, a.max_slice_size, groups, a.max_records)
    if a.encrypt:
        cipher.encrypt(spark, files.files_below(plain, ".cram"), f"{a.output}/encrypted", os.environ["SEQLOOM_PASSWORD"])


def bam(spark: SparkSession, a: argparse.Namespace) -> None:
    path = a.input
    if a.decrypt:
        cipher.decrypt(spark, files.files_below(path, ".enc"), f"{a.output}/plain", os.environ["SEQLOOM_PASSWORD"])
        path = f"{a.output}/plain"
    df, contigs = read(spark, path, a.reference)
    for where in a.locations[:1]:
        df = _in(df, where)
    df = df.filter(flags.required(F.col("flag"), a.required_flags) & flags.filtered(F.col("flag"), a.filter_flags))
    if a.count_only:
        print(df.count())
        return
    if a.default_quality_score != 63:
        df = df.withColumn("qual", F.when((F.col("qual") == "*") & (F.col("seq") != "*"), F.expr(f"repeat(chr({a.default_quality_score}), length(seq))")).otherwise(F.col("qual")))
    if a.calculate_md_tag or a.calculate_nm_tag:
        from seqloom.plans.shared import cut

        df = cut(df.withColumn("row_id", F.monotonically_increasing_id()), "records")
        found = al.md_and_nm(al.with_reference(al.placed(df), _chunks(spark, a.reference))).withColumnRenamed("row_id", "_id")
        df = df.join(found, F.col("row_id") == F.col("_id"), "left")
        made = [F.when(F.col(c).isNotNull(), F.create_map(F.lit(k), F.concat(F.lit(t), F.col(c).cast("string")))) for k, t, c, on in (("MD", "Z:", "md", a.calculate_md_tag), ("NM", "i:", "nm", a.calculate_nm_tag)) if on]
        none = F.create_map().cast("map<string,string>")
        names = [k for k, on in (("MD", a.calculate_md_tag), ("NM", a.calculate_nm_tag)) if on]
        df = df.withColumn("tags", F.map_concat(F.coalesce(F.map_filter("tags", lambda k, v: ~k.isin(*names) | F.col("_id").isNull()), none), *[F.coalesce(m, none) for m in made])).drop("_id", "md", "nm", "row_id")
    out = f"{a.output}/records" if a.decrypt else a.output
    if a.fastq or a.fastq_gz:
        fastq.write_fastq(df, out, gzip=a.fastq_gz)
    elif a.bam:
        binary.write_bam(df, contigs, out)
    else:
        sam.write_sam(df, out, header=sam.header_lines(contigs) if a.print_sam_header else None)


def merged(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sources in the order given; names begin with their file's name, numbered where several share it."""
    names, parts, contigs = [p.rstrip("/").rsplit("/", 1)[-1].split(".")[0] for p in a.files], [], None
    for i, p in enumerate(a.files):
        df, own = read(spark, p, a.reference)
        parts.append(_in(df, a.region))
        own = own.withColumn("source", F.lit(i))
        contigs = own if contigs is None else contigs.unionByName(own)
    contigs = contigs.groupBy("name").agg(F.min(F.struct("source", "sequence_id", "length")).alias("x")).select("name", "x.*")
    contigs = _contigs(spark, [(r["name"], r["length"]) for r in contigs.orderBy("source", "sequence_id").collect()])
    ids = merge.resolve_collisions(spark.createDataFrame(list(enumerate(names)), "source int, id string"))
    df = merge.prefixed_names(merge.union_sources(parts).withColumn("row_id", F.monotonically_increasing_id()), ids)
    df = merge.written_in_order(merge.merged_order(df), contigs).select(*FIELDS, "tags")
    if a.sam_format:
        sam.write_sam(df, a.output, header=sam.header_lines(contigs, order="coordinate") if a.sam_header else None)
    else:
        binary.write_bam(df, contigs, a.output)


def indexed(spark: SparkSession, a: argparse.Namespace) -> None:
    """.bai beside .bam files, or beside .cram files if asked for; .crai files come with the writer."""
    if files.files_below(a.input, ".bam"):
        binary.index_bam(spark, a.input)
    for p in files.files_below(a.input, ".cram"):
        if a.bai:
            _, contigs = read(spark, p, a.reference)
            crai.write_bai(crai.read_crai(spark, f"{p}.crai"), contigs, f"{p}.bai")


def diff(spark: SparkSession, a: argparse.Namespace) -> None:
    sides = [_in(read(spark, p, a.reference)[0], a.location).withColumn("n", F.monotonically_increasing_id()) for p in (a.file1, a.file2)]
    left_out = {f.lower() for f in a.ignore_fields.split(":")}
    tags = set(a.ignore_tags.split(":"))
    keep = F.map_filter("tags", lambda k, v: ~k.isin(*tags)) if a.compare_tags else F.lit(None).cast("map<string,string>")
    found = compare.dump(*[s.withColumn("tags", keep) for s in sides], "n", [f for f in FIELDS if f not in left_out], most=a.max_value_len)
    if a.dump:
        found.write.parquet(a.dump)
    elif a.count_only:
        compare.summary(found, FIELDS).orderBy("place", "field").drop("place").show(100, False)
    else:
        found.orderBy("counter", "field").limit(a.max_discrepancies).select("counter", "field", "tag", "value1", "value2").show(a.max_discrepancies, False)


def selected(spark: SparkSession, a: argparse.Namespace) -> None:
    df, _ = read(spark, a.input, a.reference)
    df = df.filter(flags.required(F.col("flag"), a.required_flags) & flags.filtered(F.col("flag"), a.filter_flags))
    if a.sql:
        df.createOrReplaceTempView("reads")
        spark.sql(a.sql).write.option("sep", "\t").csv(a.output)
    else:
        df = df.limit(a.skip + a.limit).offset(a.skip) if a.limit is not None else df
        selector.tsv(df, a.select, []).select("line").write.text(a.output)


def decomposed(spark: SparkSession, a: argparse.Namespace) -> None:
    df, _ = read(spark, a.input, a.reference)
    storage.write_columns(storage.decompose(df, {f: F.col(f) for f in FIELDS}, most=a.max_records), a.output)


STATES = ("NONE", "INPROGRESS", "FAILED", "SUCCESS", "GARBLED")


class Task:
    """A step whose state is told by marker files: none, one of inprogress, failed or success; several are garbled."""

    def __init__(self, folder: str, name: str, run):
        self.folder, self.name, self.run = folder, name, run

    def _marker(self, state: str) -> str:
        return f"{self.folder}/{self.name}.{state.lower()}"

    def state(self) -> str:
        found = [s for s in STATES[1:4] if files.exists(self._marker(s))]
        return "NONE" if not found else found[0] if len(found) == 1 else "GARBLED"

    def _set(self, state: str | None) -> None:
        for s in STATES[1:4]:
            fs, inner = files.resolve(self._marker(s))
            if s == state:
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(inner, compression=None) as f:
                    f.write(s.encode())
            elif files.exists(self._marker(s)):
                fs.delete_file(inner)

    def reset(self) -> None:
        self._set(None)

    def __call__(self) -> str:
        self._set("INPROGRESS")
        try:
            self.run()
        except Exception as why:
            self._set("FAILED")
            print(f"{self.folder}/{self.name}: {why}", file=sys.stderr)
        else:
            self._set("SUCCESS")
        return self.state()


def batch(spark: SparkSession, a: argparse.Namespace) -> list[tuple[str, str, str, str]]:
    """Every file under every set of rules, to containers and back, with rows (file, model, task, state). What has succeeded isn't run again; failed ones only with --reset-failed."""
    with files.open_file(a.models) as f:
        models = dict(line.split("\t") for line in f.read().decode().splitlines() if line)
    with files.open_file(a.inputs) as f:
        inputs = [line for line in f.read().decode().splitlines() if line]
    rows: list[tuple[str, str, str, str]] = []

    def project(path: str, model: str) -> list[tuple[str, str, str, str]]:
        name = path.rstrip("/").rsplit("/", 1)[-1]
        folder = f"{a.dest}/{model}"
        make = lambda *argv: lambda: main([*argv], spark)
        forth = ["cram", "-I", path, "-R", a.reference, "-O", f"{folder}/{name}.cram.d", "-n", "--capture-all-tags", *(["-L", models[model]] if models[model] else ["-Q"])]
        back = ["bam", "-I", f"{folder}/{name}.cram.d", "-R", a.reference, "-O", f"{folder}/{name}.bam.d", "-b"]
        out = []
        for step, argv in (("cram", forth), ("bam", back)):
            task = Task(folder, f"{name}.{step}", make(*argv))
            state = task.state()
            if state in ("FAILED", "GARBLED", "INPROGRESS") and a.reset_failed:
                fs, inner = files.resolve(argv[argv.index("-O") + 1])
                fs.delete_dir_contents(inner, missing_dir_ok=True)
                task.reset()
                state = "NONE"
            state = task() if state == "NONE" else state
            out.append((path, model, step, state))
            if state != "SUCCESS":
                break
        return out

    with ThreadPoolExecutor(a.pool) as pool:
        for done in pool.map(lambda x: project(*x), [(p, m) for p in inputs for m in sorted(models)]):
            rows += done
    for row in rows:
        print("\t".join(row))
    return rows


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom", fromfile_prefix_chars="@")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, about: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about, fromfile_prefix_chars="@")
        p.set_defaults(run=run)
        p.add_argument("-R", "--reference-fasta-file", dest="reference", default=None)
        return p

    p = command("cram", cram, "records to containers")
    p.add_argument("-I", "--input", required=True)
    p.add_argument("-O", "--output", required=True)
    p.add_argument("--max-records", type=int, default=None)
    p.add_argument("--max-slice-size", type=int, default=container.RECORDS)
    p.add_argument("-n", "--preserve-read-names", action="store_true")
    p.add_argument("-Q", "--lossless-quality-score", dest="lossless", action="store_true")
    p.add_argument("-L", "--lossy-quality-score-spec", dest="lossy", default="")
    p.add_argument("--ignore-tags", default="")
    p.add_argument("--capture-tags", default="")
    p.add_argument("--capture-all-tags", action="store_true")
    p.add_argument("--encrypt", action="store_true", help="the password stands in SEQLOOM_PASSWORD")
    p = command("bam", bam, "containers to records")
    p.add_argument("-I", "--input", required=True)
    p.add_argument("-O", "--output", default=None)
    p.add_argument("-b", "--output-bam-format", dest="bam", action="store_true")
    p.add_argument("-q", "--output-fastq-format", dest="fastq", action="store_true")
    p.add_argument("-z", "--output-fastq-gz-format", dest="fastq_gz", action="store_true")
    p.add_argument("--print-sam-header", action="store_true")
    p.add_argument("--default-quality-score", type=int, default=63)
    p.add_argument("--calculate-md-tag", action="store_true")
    p.add_argument("--calculate-nm-tag", action="store_true")
    p.add_argument("-c", "--count-only", action="store_true")
    p.add_argument("-f", "--required-flags", type=int, default=0)
    p.add_argument("-F", "--filter-flags", type=int, default=0)
    p.add_argument("--decrypt", action="store_true", help="the password stands in SEQLOOM_PASSWORD")
    p.add_argument("locations", nargs="*")
    p = command("merge", merged, "several files to one order")
    p.add_argument("-O", "--output-file", dest="output", required=True)
    p.add_argument("--sam-format", action="store_true")
    p.add_argument("--sam-header", action="store_true")
    p.add_argument("-r", "--region", default=None)
    p.add_argument("files", nargs="+")
    p = command("index", indexed, "index files beside the data")
    p.add_argument("-I", "--input", required=True)
    p.add_argument("--bam-style-index", dest="bai", action="store_true")
    p = command("diff", diff, "compare two files record by record")
    p.add_argument("--file1", required=True)
    p.add_argument("--file2", required=True)
    p.add_argument("--max-discrepancies", type=int, default=1000)
    p.add_argument("--max-value-len", type=int, default=20)
    p.add_argument("--location", default=None)
    p.add_argument("--ignore-tags", default="")
    p.add_argument("--ignore-fields", default="")
    p.add_argument("-c", "--count-only", action="store_true")
    p.add_argument("--compare-tags", action="store_true")
    p.add_argument("--dump-to", dest="dump", default=None)
    p = command("select", selected, "fields and tags as tab-separated text, or SQL over the view reads")
    p.add_argument("-I", "--input", required=True)
    p.add_argument("-O", "--output", required=True)
    p.add_argument("--select", default="*")
    p.add_argument("--sql", default=None)
    p.add_argument("--skip", type=int, default=0)
    p.add_argument("--limit", type=int, default=None)
    p.add_argument("-f", "--required-flags", type=int, default=0)
    p.add_argument("-F", "--filter-flags", type=int, default=0)
    p = command("decompose", decomposed, "one folder of text per field and tag")
    p.add_argument("-I", "--input", required=True)
    p.add_argument("-O", "--output", required=True)
    p.add_argument("--max-records", type=int, default=None)
    p = command("batch", batch, "every file under every set of rules")
    p.add_argument("--inputs", required=True, help="a file with a path per line")
    p.add_argument("--models", required=True, help="a file with a name, a tab and rules per line")
    p.add_argument("--dest", required=True)
    p.add_argument("--pool", type=int, default=2)
    p.add_argument("--reset-failed", action="store_true")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    return a.run(spark or SparkSession.builder.appName("seqloom").getOrCreate(), a)


if __name__ == "__main__":
    main()

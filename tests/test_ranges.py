"""Folders of written files, split reads, indexes and regions."""

import random

import pytest

from seqloom.sources import binary, container, fasta, files

CONTIGS = "sequence_id int, name string, length bigint"


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name, size = rng.choice(["c", "c", "d", "*"]), rng.randrange(1, 160)
        cigar = f"{size}M" if rng.random() < 0.8 else f"{size}M{rng.randrange(1, 40_000)}N"
        seq = "".join(rng.choices("ACGT", k=size))
        placed = name != "*"
        rows.append((rng.choice(["q", "café", "A:1:あ"]) + str(i), 0 if placed else 4, name, rng.randrange(1, 90_000) if placed else 0, 9 if placed else 0, cigar if placed else "*", "*", 0, i, seq, "".join(rng.choices("!#IJ~", k=size)), {"NM": f"i:{i % 7}", "RG": f"Z:g{i % 3}"}))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = made(3000)
    contigs = spark.createDataFrame([(0, "c", 200_000), (1, "d", 200_000)], CONTIGS)
    return rows, spark.createDataFrame(rows, binary.READS_SCHEMA), contigs


def overlapping(rows, name, start, end):
    out = set()
    for r in rows:
        span = sum(int(x[:-1]) for x in __import__("re").findall(r"\d+[MN]", r[5]))
        if r[2] == name and r[3] <= end and r[3] + max(span, 1) - 1 >= start:
            out.add(r[0])
    return out


def test_a_write_touches_nothing_that_was_there(data, tmp_path):
    _, df, contigs = data
    kept = tmp_path / "out" / "notes.txt"
    kept.parent.mkdir()
    kept.write_text("mine")
    for write in (lambda p: binary.write_bam(df, contigs, p), lambda p: container.write_cram(df, contigs, "none.fa", p)):
        with pytest.raises(FileExistsError):
            write(str(kept.parent))
        assert kept.read_text() == "mine" and [p.name for p in kept.parent.iterdir()] == ["notes.txt"]
    (tmp_path / "_x").mkdir()
    (tmp_path / "_x" / "hidden.bam").write_text("")
    assert files.files_below(str(tmp_path), ".bam") == [] and files.files_below(f"file://{tmp_path}") == [str(kept)]


@pytest.mark.parametrize("split", [500, 9_999, 70_000, 10_000_000])
def test_binary_files_are_split_anywhere(data, tmp_path_factory, split):
    rows, df, contigs = data
    path = str(tmp_path_factory.mktemp("bam")) + "/out"
    binary.write_bam(df.coalesce(1), contigs, path)
    reader = binary.BamReader({"path": path, "split": str(split)})
    parts = reader.partitions()
    assert len(parts) > 1 or split > 1_000_000
    got = [r for p in parts for r in reader.read(p)]
    assert [r[0] for r in got] == [r[0] for r in rows]


@pytest.mark.parametrize("split", [700, 9_999])
def test_no_record_is_seen_in_the_tail_of_another(spark, tmp_path, split):
    """Four bytes before each of these records the fields of one make sense, too, but its 30 MB lie behind the end of the file or of what is looked at."""
    rng = random.Random(2)
    rows = [(f"q{i}", 99, "c0", 4, 60, "20M", "=", 300, 300, "".join(rng.choices("ACGT", k=20)), "".join(rng.choices("!#IJ~", k=20)), {"XI": f"i:{30_000_000 + i}"}) for i in range(6000)]
    contigs = spark.createDataFrame([(i, f"c{i}", 1000) for i in range(900)], CONTIGS)
    path = str(tmp_path / "out")
    binary.write_bam(spark.createDataFrame(rows, binary.READS_SCHEMA).coalesce(1), contigs, path)
    reader = binary.BamReader({"path": path, "split": str(split)})
    assert [r for p in reader.partitions() for r in reader.read(p)] == rows
    binary.register(spark)
    back = spark.read.format("seqloom_bam").option("split", split * 20).load(path).collect()
    assert {r["qname"]: tuple(r) for r in back} == {r[0]: r for r in rows} and len(back) == len(rows)


def test_all_scores_come_back():
    row = {"qname": "q", "flag": 0, "rname": "*", "pos": 0, "mapq": 0, "cigar": "*", "rnext": "*", "pnext": 0, "tlen": 0, "seq": "ACN", "qual": "I\xff\u011f", "tags": None}
    assert binary.decode_record(binary.encode_record(row, {})[4:], [])[9:11] == ("ACN", row["qual"])


def test_long_names_are_refused(data, spark, tmp_path):
    _, _, contigs = data
    with pytest.raises(ValueError):
        binary.encode_record({"qname": "n" * 255}, {})


def test_index_of_records(data, spark, tmp_path):
    rows, df, contigs = data
    path = str(tmp_path / "bam")
    binary.write_bam(binary.sorted_for_index(df, contigs), contigs, path)
    binary.index_bam(spark, path)
    for region in [("c", 1, 200_000), ("c", 30_000, 30_100), ("d", 16_384, 16_385), ("d", 150_000, 160_000), ("e", 1, 9)]:
        reader = binary.BamReader({"path": path, "region": "{}:{}-{}".format(*region)})
        parts = reader.partitions()
        assert {r[0] for p in parts for r in reader.read(p)} == overlapping(rows, *region)
    whole = sum(files.size_of(p) for p in files.files_below(path, ".bam"))
    reader = binary.BamReader({"path": path, "region": "c:30000-30100"})
    assert sum((p.end >> 16) - (-1 - p.start >> 16) for p in reader.partitions()) < whole
    for p in files.files_below(path, ".bai"):
        assert binary.bai_bytes(*binary.read_bai(p)) == open(p, "rb").read()
    loose = str(tmp_path / "loose")
    binary.write_bam(df.coalesce(1), contigs, loose)
    with pytest.raises(ValueError, match="sorted"):
        binary.index_bam(spark, loose)


def test_bins_of_a_range():
    for start, end in [(1, 1), (16_384, 16_385), (1, 1 << 27), (99_999, 140_000)]:
        want = {b for p in {start - 1, end - 1, *range(start - 1, end, 16_384)} for b in [0, 1 + (p >> 26), 9 + (p >> 23), 73 + (p >> 20), 585 + (p >> 17), 4681 + (p >> 14)]}
        assert set(binary.bins_of(start, end)) == want


@pytest.fixture(scope="module")
def written(data, spark, tmp_path_factory):
    rows, df, contigs = data
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("cram")
    ref = {n: "".join(rng.choices("ACGT", k=200_000)) for n in "cd"}
    (folder / "r.fa").write_text("".join(f">{n}\n" + "\n".join(s[i : i + 70] for i in range(0, len(s), 70)) + "\n" for n, s in ref.items()))
    container.write_cram(df, contigs, str(folder / "r.fa"), str(folder / "out"), records=100, groups=spark.createDataFrame([("g0",), ("g2",), (None,)], "rg string"))
    return ref, str(folder / "r.fa"), str(folder / "out")


def test_only_overlapping_containers_are_read(data, written):
    rows, *_ = data
    _, fa, path = written
    whole = sum(len(p.heads) for p in container.CramReader({"path": path, "reference": fa}).partitions())
    for region in [("c", 30_000, 30_100), ("d", 1, 5), ("d", 80_000, 200_000), ("e", 1, 9)]:
        reader = container.CramReader({"path": path, "reference": fa, "region": "{}:{}-{}".format(*region)})
        parts = reader.partitions()
        assert sum(len(p.heads) for p in parts) < whole
        assert {r[0] for p in parts for r in reader.read(p)} == overlapping(rows, *region)
        pushed = container.FilteredCramReader({"path": path, "reference": fa})
        from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

        assert len(list(pushed.pushFilters([EqualTo(("rname",), region[0]), LessThanOrEqual(("pos",), region[2]), GreaterThanOrEqual(("pos",), region[1])]))) == 3
        assert {h.start_byte for p in pushed.partitions() for h in p.heads} == {h.start_byte for p in parts for h in p.heads}


def test_containers_by_bai_and_slices(data, written, spark, tmp_path):
    """Without a .crai a .bai over the slices leads to the same containers; a container is also read by parts."""
    import shutil

    from seqloom.sources import crai

    rows, _, contigs = data
    _, fa, path = written
    for p in files.files_below(path, ".cram"):
        new = str(tmp_path / p.rsplit("/", 1)[1])
        shutil.copy(p, new)
        crai.write_bai(crai.read_crai(spark, f"{p}.crai"), contigs, f"{new}.bai")
    for region in [("c", 30_000, 30_100), ("d", 1, 5), ("d", 80_000, 200_000)]:
        text = "{}:{}-{}".format(*region)
        by_bai, by_crai = (container.CramReader({"path": p, "reference": fa, "region": text}).partitions() for p in (str(tmp_path), path))
        assert sum(len(p.heads) for p in by_bai) == sum(len(p.heads) for p in by_crai)
        reader = container.CramReader({"path": str(tmp_path), "reference": fa, "region": text})
        assert {r[0] for p in reader.partitions() for r in reader.read(p)} == overlapping(rows, *region)
    file = files.files_below(path, ".cram")[0]
    head, (names, groups) = next(h for h in container.container_heads(file) if h.records), container.header_names(container.read_header(file)[1])
    ref = container.load_reference(fa)
    assert len(list(container.read_container(file, head, names, groups, ref, 0, 1))) == head.records and list(container.read_container(file, head, names, groups, ref, 1)) == []


def test_containers_count_through_all_files_and_choose_codes(data, written, spark):
    rows, *_ = data
    _, fa, path = written
    heads = [h for p in files.files_below(path, ".cram") for h in container.container_heads(p) if h.records]
    at = sorted((h.counter, h.records) for h in heads)
    assert [c for c, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))] and sum(n for _, n in at) == len(rows)
    binary.register(spark)
    back = {r["qname"]: r for r in spark.read.format("seqloom_cram").option("reference", fa).load(path).collect()}
    assert all(back[r[0]]["tags"] == r[11] and back[r[0]]["qual"] == r[10] and back[r[0]]["cigar"] == r[5] for r in rows)
    file = files.files_below(path, ".cram")[0]
    head = next(h for h in container.container_heads(file) if h.records)
    with open(file, "rb") as f:
        f.seek(head.body)
        _, _, raw = container._read_block(container.c.Bytes(f.read(head.size)))
    kinds = {k: e[0] for k, e in container.Compression(raw).series.items()}
    assert kinds["BF"] != container.c.EXTERNAL and set(kinds.values()) & {container.c.HUFFMAN, container.c.BETA, container.c.GAMMA}


def test_pushed_filters_through_spark(data, written, spark):
    rows, *_ = data
    _, fa, path = written
    binary.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("seqloom_cram").option("reference", fa).option("pushdown", "true").load(path).filter("rname = 'c' and pos between 20000 and 40000")
        assert {r["qname"] for r in df.collect()} == {r[0] for r in rows if r[2] == "c" and 20_000 <= r[3] <= 40_000}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_reference_by_ranges(written, tmp_path):
    ref, fa, _ = written
    r = container.Reference(fa)
    for start, end in [(0, 1), (69, 71), (70, 140), (199_990, 300_000), (-5, 3), (5, 5)]:
        assert r.letters("d", start, end) == ref["d"][max(start, 0) : end]
    assert r.letters("x", 0, 5) == ""
    text = container.Letters(r, "c")
    assert text[100:300] == ref["c"][100:300] and text[150_000:150_010] == ref["c"][150_000:150_010] and text[199_999:200_009] == ref["c"][199_999:]
    (tmp_path / "odd.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(ValueError):
        container.Reference(str(tmp_path / "odd.fa"))
    (tmp_path / "low.fa").write_text(">a x\nacgr\nAC\n>b\n\n")
    assert container.Reference(str(tmp_path / "low.fa")).letters("a", 0, 9) == "ACGNAC"


def test_most_records(data, written, tmp_path):
    _, df, contigs = data
    _, fa, _ = written
    container.write_cram(df, contigs, fa, str(tmp_path / "few"), most=7)
    assert sum(h.records for p in files.files_below(str(tmp_path / "few"), ".cram") for h in container.container_heads(p)) == 7


def test_sub_ranges(spark):
    df = spark.createDataFrame([(1, "ACGTACGT"), (2, ""), (3, None)], "row_id int, seq string")
    assert {r["row_id"]: r["seq"] for r in fasta.sub_ranges(df, "seq", 3, 2).collect()} == {1: "GTA", 2: "", 3: None}

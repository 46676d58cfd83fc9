"""Text and binary formats."""

import gzip

import pytest
from pyspark.sql import functions as F

from seqloom.sources import binary, detect, fasta, fastq, sam


def test_sam_text(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "@SQ\tSN:c\tLN:9", "@CO\tfree: text\there", "q\t99\tc\t5\t60\t3M\t=\t9\t7\tACG\tIII\tNM:i:1\tXZ:Z:a:b\tNM:i:2\tbad", "short\t4", "", "x\tnan\t*\t0\t0\t*\t*\t0\t0\t*\t*"]
    (tmp_path / "a.sam").write_text("\n".join(lines))
    with gzip.open(tmp_path / "b.sam.gz", "wt") as f:
        f.write(lines[3])
    got = {r["qname"]: r for r in sam.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert got["q"]["pos"] == 5 and got["q"]["tags"] == {"NM": "i:2", "XZ": "Z:a:b"} and got["q"]["n_cells"] == 15
    assert got["short"]["seq"] is None and got["short"]["tags"] == {} and got["x"]["flag"] is None
    assert sam.read_sam(spark, str(tmp_path / "b.sam.gz")).count() == 1
    head = {(r["kind"], r["key"]): r["value"] for r in sam.read_header(spark, str(tmp_path / "a.sam")).collect()}
    assert head["SQ", "SN"] == "c" and head["CO", None] == "free: text\there"


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fa"
    path.write_text(">a desc\nACG\nTT\n>empty\n>b\r\nGG\r\n")
    seqs = fasta.read_fasta(spark, str(path))
    assert {r["rname"]: r["seq"] for r in seqs.collect()} == {"a": "ACGTT", "empty": "", "b": "GG"}
    assert fasta.sub_range(seqs, "a", 2, 2).first()["seq"] == "CGT"
    assert [r["value"] for r in fasta.fasta_lines(seqs.filter("rname in ('a', 'empty')"), 3).orderBy("rname", "line_no").collect()] == [">a", "ACG", "TT", ">empty"]
    assert fasta.find_reference(str(tmp_path / "x.cram")) == str(path)
    (tmp_path / "y.ref").write_text(str(path) + "\n")
    assert fasta.find_reference(str(tmp_path / "y.cram")) == str(path)
    with pytest.raises(FileNotFoundError):
        fasta.find_reference(str(tmp_path / "z.cram"))
    header = spark.createDataFrame([("b", "GG"), ("c", "G")], "name string, s string").select("name", F.md5("s").alias("m5"))
    assert {r["name"]: r["ok"] for r in fasta.check_md5(seqs, header).collect()} == {"b": True, "c": None}


def test_fastq_ranges_with_odd_qualities(tmp_path):
    records = [(f"r{i}", "ACGT" * (i % 5 + 1), ("@+II" * (i % 5 + 1))) for i in range(200)]
    path = tmp_path / "x.fastq"
    path.write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in records))
    for split in (7, 64, 100_000):
        reader = binary.FastqReader({"path": str(path), "split": str(split)})
        assert [r for p in reader.partitions() for r in reader.read(p)] == records
    reader = binary.FastqReader({"path": str(tmp_path / "none")})
    assert [r for p in reader.partitions() for r in reader.read(p)] == []


def test_fastq_ends(spark):
    df = spark.createDataFrame([("a", 0, "A", "I"), ("b", 65, "A", "I"), ("c", 129, "A", "I"), ("d", 256, "A", "I"), (None, 0, None, None)], "qname string, flag int, seq string, qual string")
    assert {r["qname"]: r["file"] for r in fastq.fastq_records(df).collect()} == {"a": 0, "b": 1, "c": 2, None: 0}
    assert {r["qname"]: r["file"] for r in fastq.fastq_records(df, swapped=True).collect()}["b"] == 2


def test_binary_records_and_detection(spark, tmp_path):
    rows = [("q", 99, "c", 5, 60, "2S3M", "=", 9, -7, "ACGTN", "IIII!", {"NM": "i:1", "XF": "f:0.5", "XB": "B:s,1,-2", "XA": "A:k", "XZ": "Z:t x", "XH": "H:1AE3", "XU": "i:4294967295"}), ("u", 4, "*", 0, 0, "*", "*", 0, 0, "*", "*", None), ("w", 16, "d", 1, 255, "1M", "c", 3, 0, "A", "*", {})]
    df = spark.createDataFrame(rows, binary.READS_SCHEMA)
    contigs = spark.createDataFrame([(0, "c", 100), (1, "d", 50)], "sequence_id int, name string, length bigint")
    path = str(tmp_path / "out")
    binary.write_bam(df.coalesce(1), contigs, path)
    (file,) = binary.files_below(path)
    assert detect.kind_of(file) == "bam" and detect.is_terminated(open(file, "rb").read())
    got = {r["qname"]: r for r in detect.read_reads(spark, file).collect()}
    for row in rows:
        r = got[row[0]]
        assert tuple(r)[:11] == row[:11] and r["tags"] == (row[11] or {})
    assert detect.kind(b"CRAM\2\0") == "cram" and detect.kind(b"@HD\t") == "sam" and detect.kind(gzip.compress(b"@HD")) == "gzip_sam" and detect.kind(binary.block(b"@HD")) == "bgzf_sam"


def test_folders_of_several_files_of_a_kind(spark, tmp_path):
    df = spark.range(60).selectExpr("concat('q', id) qname", "4 flag", "'*' rname", "0 pos", "0 mapq", "'*' cigar", "'*' rnext", "0 pnext", "0 tlen", "'AC' seq", "'II' qual", "map('NM', concat('i:', id)) tags").repartition(3)
    contigs = spark.createDataFrame([(0, "c", 100)], "sequence_id int, name string, length bigint")
    sam.write_sam(df, str(tmp_path / "sam"))
    sam.write_sam(df, str(tmp_path / "gzip_sam"), gzip=True)
    binary.write_bam(df, contigs, str(tmp_path / "bam"))
    for kind in ("sam", "gzip_sam", "bam"):
        path = str(tmp_path / kind)
        assert len(binary.files_below(path)) == 3 and detect.kind_below(path) == kind
        assert {(r["qname"], r["tags"]["NM"]) for r in detect.read_reads(spark, path).collect()} == {(f"q{i}", f"i:{i}") for i in range(60)}
    with pytest.raises(ValueError, match="bam and gzip_sam and sam"):
        detect.kind_below(str(tmp_path))

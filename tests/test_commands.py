"""Commands end to end, encryption and the batch of files and rules."""

import pytest
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.sources import binary, cipher, files, sam
from tests.test_ranges import CONTIGS, made


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    at, rng = tmp_path_factory.mktemp("cli"), random.Random(2)
    rows = made(300, 5)
    (at / "r.fa").write_text("".join(f">{n}\n" + "".join(rng.choices("ACGT", k=140_000)) + "\n" for n in "cd"))
    df = spark.createDataFrame(rows, binary.READS_SCHEMA)
    contigs = spark.createDataFrame([(0, "c", 140_000), (1, "d", 140_000)], CONTIGS)
    binary.write_bam(df, contigs, f"{at}/in.d")
    return rows, at


def names(spark, path):
    return {r["qname"] for r in cli.read(spark, path)[0].collect()}


def test_to_containers_and_back(spark, folder, tmp_path, capsys):
    rows, at = folder
    fa = f"{at}/r.fa"
    cli.main(["cram", "-I", f"{at}/in.d", "-R", fa, "-O", f"{tmp_path}/c", "-n", "-Q", "--capture-all-tags"], spark)
    cli.main(["bam", "-I", f"{tmp_path}/c", "-R", fa, "-O", f"{tmp_path}/b", "-b", "--calculate-nm-tag", "--calculate-md-tag"], spark)
    back = {r["qname"]: r for r in cli.read(spark, f"{tmp_path}/b")[0].collect()}
    assert all(back[r[0]]["seq"] == r[9] and back[r[0]]["qual"] == r[10] and back[r[0]]["cigar"] == r[5] and back[r[0]]["tags"]["RG"] == r[11]["RG"] for r in rows)
    assert all(("MD" in back[r[0]]["tags"]) == (r[2] != "*") for r in rows)
    capsys.readouterr()
    cli.main(["bam", "-I", f"{tmp_path}/c", "-R", fa, "-c", "-F", "4", "c"], spark)
    assert int(capsys.readouterr().out) == sum(r[2] == "c" for r in rows)
    (tmp_path / "args").write_text(f"-I\n{tmp_path}/c\n-R\n{fa}\n-O\n{tmp_path}/s\n--print-sam-header\nc:1-40000\n")
    cli.main(["bam", f"@{tmp_path}/args"], spark)
    texts = spark.read.text(f"{tmp_path}/s")
    assert texts.filter("value like '@SQ%'").count() >= 2
    assert sam.read_sam(spark, f"{tmp_path}/s").agg(F.max("pos")).first()[0] <= 40_000
    cli.main(["bam", "-I", f"{tmp_path}/c", "-R", fa, "-O", f"{tmp_path}/q", "-q"], spark)
    assert files.files_below(f"{tmp_path}/q")
    cli.main(["cram", "-I", f"{at}/in.d", "-R", fa, "-O", f"{tmp_path}/l", "-L", "N40-R8", "--max-records", "50"], spark)
    lossy = cli.read(spark, f"{tmp_path}/l", fa)[0]
    assert lossy.count() == 50 and set(lossy.select(F.explode("tags")).select("key").distinct().toPandas()["key"]) <= {"RG"}


def test_merge_index_and_diff(spark, folder, tmp_path, capsys):
    rows, at = folder
    cli.main(["merge", "-O", f"{tmp_path}/m", f"{at}/in.d", f"{at}/in.d"], spark)
    assert names(spark, f"{tmp_path}/m") == {f"in{i}.{r[0]}" for i in (1, 2) for r in rows}
    cli.main(["index", "-I", f"{tmp_path}/m"], spark)
    assert len(files.files_below(f"{tmp_path}/m", ".bai")) == len(files.files_below(f"{tmp_path}/m", ".bam"))
    cli.main(["diff", "--file1", f"{at}/in.d", "--file2", f"{at}/in.d", "--compare-tags", "--dump-to", f"{tmp_path}/d"], spark)
    assert spark.read.parquet(f"{tmp_path}/d").count() == 0
    cli.main(["diff", "--file1", f"{at}/in.d", "--file2", f"{tmp_path}/m", "-c", "--ignore-fields", "SEQ:QUAL"], spark)
    assert "PREMATURE" in capsys.readouterr().out


def test_select_and_decompose(spark, folder, tmp_path):
    rows, at = folder
    cli.main(["select", "-I", f"{at}/in.d", "-O", f"{tmp_path}/t", "--select", "QNAME/NM"], spark)
    assert {r["value"].split("\t")[0] for r in spark.read.text(f"{tmp_path}/t").collect()} == {r[0] for r in rows}
    cli.main(["select", "-I", f"{at}/in.d", "-O", f"{tmp_path}/q", "--sql", "select rname, count(*) as n from reads group by rname"], spark)
    assert {tuple(r) for r in spark.read.option("sep", "\t").csv(f"{tmp_path}/q").collect()} == {(n, str(sum(r[2] == n for r in rows))) for n in ("c", "d", "*")}
    cli.main(["decompose", "-I", f"{at}/in.d", "-O", f"{tmp_path}/x", "--max-records", "20"], spark)
    assert spark.read.text(f"{tmp_path}/x").filter("column = 'qname'").count() == 20


def test_batch_of_files_and_rules(spark, folder, tmp_path):
    _, at = folder
    (tmp_path / "inputs").write_text(f"{at}/in.d\n{tmp_path}/absent\n")
    (tmp_path / "models").write_text("all\t\nmismatches\tN40\n")
    argv = ["batch", "--inputs", f"{tmp_path}/inputs", "--models", f"{tmp_path}/models", "--dest", f"{tmp_path}/out", "-R", f"{at}/r.fa"]
    rows = cli.main(argv, spark)
    assert sorted((m, t, s) for p, m, t, s in rows if p.endswith("in.d")) == [(m, t, "SUCCESS") for m in ("all", "mismatches") for t in ("bam", "cram")]
    assert [(t, s) for p, _, t, s in rows if p.endswith("absent")] == [("cram", "FAILED")] * 2
    assert cli.main(argv, spark) == rows  # nothing is run again
    task = cli.Task(f"{tmp_path}/out/all", "in.d.cram", None)
    assert task.state() == "SUCCESS"
    (tmp_path / "out" / "all" / "in.d.cram.failed").write_text("")
    assert task.state() == "GARBLED"
    task.reset()
    assert task.state() == "NONE"


def test_cipher_vector(spark):
    """A published vector of the mode."""
    key, first = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    df = spark.createDataFrame([(cipher.counters(first, 0, 2),)], "b array<binary>")
    stream = b"".join(df.select(cipher.key_stream(F.col("b"), key)).first()[0])
    assert bytes(a ^ b for a, b in zip(plain, stream)).hex() == "874d6191b620e3261bef6864990db6ce9806f66b7970fdff8617187bb9fffdff"
    assert cipher.counters(b"\xff" * 16, 0, 2) == [b"\xff" * 16, bytes(16)]


def test_files_are_encrypted_and_decrypted(spark, tmp_path):
    for name, data in (("a", b""), ("b", b"x" * 15), ("c", bytes(range(256)) * 1000)):
        (tmp_path / name).write_bytes(data)
    paths = [f"{tmp_path}/{n}" for n in "abc"]
    there = cipher.encrypt(spark, paths, f"{tmp_path}/e", "secret")
    assert [files.size_of(p) for p in there] == [16, 31, 256_016]
    back = cipher.decrypt(spark, there, f"{tmp_path}/d", "secret")
    assert [open(p, "rb").read() for p in back] == [open(p, "rb").read() for p in paths]
    other = cipher.decrypt(spark, there[1:], f"{tmp_path}/o", "wrong")
    assert open(other[1], "rb").read() != open(paths[2], "rb").read()
    with pytest.raises(ValueError):
        cipher.decrypt(spark, [paths[1]], f"{tmp_path}/n", "secret")

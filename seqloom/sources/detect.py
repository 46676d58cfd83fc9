"""What a file is, by its first bytes."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from seqloom.sources.files import files_below, open_file

# Magic bytes, and the empty block that ends a block-gzipped file.
CRAM, BAM, GZIP = b"CRAM", b"BAM\1", b"\x1f\x8b"
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def kind(head: bytes) -> str:
    """cram, bam, bgzf_sam, gzip_sam or sam from the first bytes of a file; anything unknown is taken for SAM text."""
    if head[:4] == CRAM:
        return "cram"
    if head[:2] != GZIP:
        return "sam"
    try:
        inner = zlib.decompressobj(31).decompress(head, 4)
    except zlib.error:
        inner = b""
    if inner[:4] == BAM:
        return "bam"
    return "bgzf_sam" if len(head) > 13 and head[3] & 4 and head[12:14] == b"BC" else "gzip_sam"


def kind_of(path: str) -> str:
    with open_file(path) as f:
        return kind(f.read(1 << 16))


def kind_below(path: str) -> str:
    """What a file, or all files below a folder, are; ValueError if they differ or there are none."""
    kinds = {kind_of(p) for p in files_below(path)}
    if len(kinds) != 1:
        raise ValueError(f"{path} holds files of {' and '.join(sorted(kinds)) or 'no kind'}")
    return kinds.pop()


def is_terminated(tail: bytes) -> bool:
    """Whether a block-gzipped file ends with the empty block."""
    return tail.endswith(BGZF_END)


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file, or of all files below a folder, of any kind that has a reader; files of a folder are of one kind."""
    what = kind_below(path)
    if what in ("bam", "cram"):
        from seqloom.sources import binary

        binary.register(spark)
        return spark.read.format(f"seqloom_{what}").load(path)
    from seqloom.sources.sam import read_sam

    return read_sam(spark, path)

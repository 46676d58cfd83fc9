"""Encryption and decryption of whole files: AES in counter mode under a key made from a password."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources.files import NewFolder, open_file, size_of

# The salt and rounds of the key, which has 128 bits; a file begins with the 16 bytes of its first counter.
SALT = bytes([244, 34, 1, 0, 158, 223, 78, 21])
ROUNDS, BITS, BLOCK = 1024, 128, 16
#: Bytes worked off at once, a multiple of BLOCK.
PIECE = 1 << 16


def key_of(password: str) -> bytes:
    return hashlib.pbkdf2_hmac("sha1", password.encode(), SALT, ROUNDS, BITS // 8)


def counters(first: bytes, at: int, n: int) -> list[bytes]:
    """The counters of n blocks from block at on; they grow from the first as one big number."""
    start = int.from_bytes(first, "big") + at
    return [((start + i) % (1 << 128)).to_bytes(16, "big") for i in range(n)]


def key_stream(blocks: Column, key: bytes) -> Column:
    """The bytes that go over the data: each counter encrypted on its own. (The block mode pads; the padding's block is left out.)"""
    return F.transform(blocks, lambda b: F.substring(F.aes_encrypt(b, F.unhex(F.lit(key.hex())), F.lit("ECB"), F.lit("PKCS")), 1, BLOCK))


def _pieces(spark: SparkSession, sources: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Rows (path, id, data, blocks): the pieces of the files (path, first counter as hex, bytes before the data)."""
    rows = [(p, first, head, size_of(p)) for p, first, head in sources]
    df = spark.createDataFrame(rows, "path string, first string, head bigint, size bigint").select("*", F.explode(F.expr(f"sequence(0L, greatest(size - head - 1, 0L) div {PIECE})")).alias("id"))
    n = spark.sparkContext.defaultParallelism

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as f:
                    f.seek(row["head"] + row["id"] * PIECE)
                    data = f.read(PIECE)
                blocks = counters(bytes.fromhex(row["first"]), row["id"] * (PIECE // BLOCK), -(-len(data) // BLOCK))
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "id": [row["id"]], "data": pa.array([data], pa.binary()), "blocks": pa.array([blocks], pa.list_(pa.binary()))})

    return df.repartition(n, "path", "id").mapInArrow(read, "path string, id bigint, data binary, blocks array<binary>")


def _changed(spark: SparkSession, sources: Sequence[tuple[str, str, int]], names: dict[str, str], folder: str, password: str, with_head: bool) -> list[str]:
    out, firsts = NewFolder(folder), {p: bytes.fromhex(first) for p, first, _ in sources}
    pieces = _pieces(spark, sources).select("path", "id", "data", key_stream(F.col("blocks"), key_of(password)).alias("stream"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, path, name, done = None, None, None, []
        for batch in batches:
            for p, data, stream in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if p != path:
                    if f is not None:
                        f.close()
                    path, name = p, out.attempt(".part")
                    f = out.create(name)
                    done.append((p, name))
                    if with_head:
                        f.write(firsts[p])
                over = np.frombuffer(b"".join(stream)[: len(data)], dtype=np.uint8)
                f.write((np.frombuffer(data, dtype=np.uint8) ^ over).tobytes())
        if f is not None:
            f.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "name": pa.array([n for _, n in done], pa.string())})

    # The pieces of a file come together in order, one after another, in the task that writes it.
    ordered = pieces.repartition("path").sortWithinPartitions("path", "id")
    try:
        out.keep_as({r["name"]: names[r["path"]] for r in ordered.mapInArrow(write, "path string, name string").collect()})
    except BaseException:
        out.close()
        raise
    return [f"{folder}/{names[p]}" for p, *_ in sources]


def encrypt(spark: SparkSession, paths: Sequence[str], folder: str, password: str) -> list[str]:
    """Write X.enc of each file X into a new or empty folder; their paths. Names must differ. The first counter of a file is random."""
    sources = [(p, os.urandom(BLOCK).hex(), 0) for p in paths]
    return _changed(spark, sources, {p: p.rsplit("/", 1)[-1] + ".enc" for p in paths}, folder, password, True)


def decrypt(spark: SparkSession, paths: Sequence[str], folder: str, password: str) -> list[str]:
    """The inverse of encrypt: X of each X.enc. A wrong password gives other bytes, not an error, as the format has no check."""
    sources = []
    for p in paths:
        with open_file(p) as f:
            first = f.read(BLOCK)
        if len(first) < BLOCK:
            raise ValueError(f"{p} is no encrypted file")
        sources.append((p, first.hex(), BLOCK))
    return _changed(spark, sources, {p: p.rsplit("/", 1)[-1].removesuffix(".enc") for p in paths}, folder, password, False)

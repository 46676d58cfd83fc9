"""Python data sources: FASTQ by byte ranges, and the block-gzipped binary record format."""

from __future__ import annotations

import re
import struct
import zlib
from binascii import hexlify, unhexlify
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from seqloom.sources.detect import BAM, BGZF_END
from seqloom.sources.files import NewFolder, exists, files_below, open_file, resolve, size_of

FASTQ_SCHEMA = "qname string, seq string, qual string"
READS_SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>"
SPLIT = 32 << 20
#: Length up to which CIGARs and tags are kept in a cache.
SHORT = 64


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


class FastqReader(DataSourceReader):
    """Each byte range begins at the first record that starts in it: a line with @ whose next but one begins with +.

    A quality line may begin with @, too, but is followed by a name and bases, and those never begin with +.
    """

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Part]:
        sizes = [(p, size_of(p)) for p in files_below(self.path)]
        return [Part(p, at, min(at + self.split, n)) for p, n in sizes for at in range(0, n, n if p.endswith(".gz") and n else self.split)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        if part.path.endswith(".gz"):
            import gzip

            with open_file(part.path) as raw, gzip.open(raw, "rb") as f:
                yield from self._records(f, 1 << 62)
            return
        with open_file(part.path) as f:
            if part.start:
                f.seek(part.start - 1)
                f.readline()
                while True:
                    at = f.tell()
                    head, _, plus = f.readline(), f.readline(), f.readline()
                    if not head or head.startswith(b"@") and plus.startswith(b"+"):
                        f.seek(at)
                        break
                    f.seek(at)
                    f.readline()
            yield from self._records(f, part.end)

    @staticmethod
    def _records(f, end: int) -> Iterator[tuple]:
        while f.tell() < end:
            head, seq, _, qual = (f.readline().rstrip(b"\r\n").decode() for _ in range(4))
            if not head:
                return
            yield head[1:], seq, qual


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seqloom_fastq"

    def schema(self) -> str:
        return FASTQ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(dict(self.options))


# Fixed values of the binary record format: letters of 4-bit bases, CIGAR operations, tag number formats.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
NUMBER = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
UNPACK = {k: struct.Struct("<" + f) for k, f in NUMBER.items()}
# Bytes of text to hexadecimal digits of bases and back, to scores and back; what has no code is N, scores are 0 to 254.
TO_BASES = bytes(b"0123456789abcdef"[i if (i := BASES.find(chr(c))) >= 0 else 15] for c in range(256))
FROM_BASES = bytes(ord(BASES[int(chr(c), 16)]) if chr(c) in "0123456789abcdef" else 0 for c in range(256))
TO_SCORES, FROM_SCORES, HIGH_SCORES = bytes(max(0, c - 33) for c in range(256)), bytes((c + 33) % 256 for c in range(256)), bytes(range(223, 256))


def block(data: bytes) -> bytes:
    """One block of at most 65,280 bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """A block-gzipped stream from the block that begins at a byte on; places in it are virtual offsets, block << 16 | byte."""

    def __init__(self, f, at: int = 0):
        self.f, self.next, self.start, self.held, self.at = f, at, at, b"", 0

    def _load(self) -> bool:
        self.f.seek(self.next)
        head = self.f.read(18)
        if not head:
            return False
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block-gzipped file")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        self.start, self.next = self.next, self.next + size
        self.held, self.at = zlib.decompress(self.f.read(size - 18)[:-8], -15), 0
        return True

    def tell(self) -> int:
        while self.at == len(self.held):
            if not self._load():
                return self.next << 16
        return self.start << 16 | self.at

    def seek(self, place: int) -> None:
        self.next, self.held, self.at = place >> 16, b"", 0
        if place & 0xFFFF:
            self._load()
            self.at = place & 0xFFFF

    def take(self, n: int) -> bytes:
        """The next n bytes; none at the end of the stream."""
        out = []
        while n:
            if self.at == len(self.held) and not self._load():
                return b""
            piece = self.held[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            out.append(piece)
        return out[0] if len(out) == 1 else b"".join(out)


def first_block(f, start: int, end: int) -> int | None:
    """The first byte from start to end - 1 at which a block begins: its header, followed by another block's or the file's end."""
    f.seek(start)
    data, size = f.read(end - start + (1 << 17)), end - start
    at = data.find(b"\x1f\x8b\x08\x04")
    while 0 <= at < size:
        if data[at + 10 : at + 16] == b"\x06\0BC\x02\0" and len(data) >= at + 18:
            after = at + struct.unpack_from("<H", data, at + 16)[0] + 1
            if data[after : after + 4] in (b"", b"\x1f\x8b\x08\x04"):
                return start + at
        at = data.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


def _is_record(raw: bytes, at: int, n_refs: int) -> int:
    """Where the record that may begin at a byte would end, 0 if none can begin there; the part of its name that raw lacks is taken for right."""
    size, ref, _, n_name, _, _, n_ops, _, n, ref2, _, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    least = 32 + n_name + 4 * n_ops + (n + 1) // 2 + n
    if not (-1 <= ref < n_refs and -1 <= ref2 < n_refs and n_name >= 1 and n >= 0 and least <= size < 1 << 28):
        return 0
    name = raw[at + 36 : at + 36 + n_name]
    if len(name) == n_name and name.find(0) != n_name - 1:
        return 0
    return at + 4 + size


def _goes_on(data: Blocks, skip: int, n_refs: int, least: int = 4) -> bool:
    """Whether at least so many records, or as many as the stream has left, follow each other from skip bytes on."""
    for _ in range(least):
        while skip:
            if not (piece := data.take(min(skip, 1 << 20))):
                return False
            skip -= len(piece)
        data.tell()
        if data.at == len(data.held):
            return True
        raw = data.take(36)
        raw += data.take(raw[12]) if raw else b""
        if len(raw) < 36 or not (size := _is_record(raw, 0, n_refs)) or size < len(raw):
            return False
        skip = size - len(raw)
    return True


def first_record(f, start: int, end: int, n_refs: int) -> int | None:
    """The virtual offset of the first record that begins in a block from start to end - 1.

    A record is where its fields make sense, and those of every record behind it in what is looked
    at, at least 128 kb more than its block, and of the next few behind that, however far off, or to
    the end of the file exactly.
    """
    block = first_block(f, start, end)
    while block is not None and block < end:
        stream = Blocks(f, block)
        block = stream.tell() >> 16
        if block >= end:
            return None
        own, after, raw = len(stream.held), stream.next, stream.held
        more = True
        while len(raw) < own + (1 << 17) and (more := stream._load()):
            raw += stream.held
        for at in range(min(own, len(raw) - 35)):
            ends = at
            while 0 < len(raw) - ends >= 36 and (ends := _is_record(raw, ends, n_refs)):
                pass
            if ends and not more and ends == len(raw):
                return block << 16 | at
            if ends and more:
                rest = Blocks(f, stream.next)
                rest.held = raw[ends:]
                if _goes_on(rest, max(0, ends - len(raw)), n_refs):
                    return block << 16 | at
        block = after if own else None
    return None


def _text(raw: bytes, at: int) -> tuple[str, int]:
    end = raw.index(b"\0", at)
    return raw[at:end].decode(), end + 1


def _tags(raw: bytes, at: int) -> dict[str, str]:
    out = {}
    while at < len(raw):
        key, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in UNPACK:
            (number,) = UNPACK[kind].unpack_from(raw, at)
            value, at = str(number), at + UNPACK[kind].size
            kind = kind if kind == "f" else "i"
        elif kind in "ZH":
            value, at = _text(raw, at)
        elif kind == "A":
            value, at = chr(raw[at]), at + 1
        else:
            if kind != "B":
                raise ValueError(f"tag {key} of an unknown type {kind}")
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            numbers = struct.unpack_from(f"<{n}{NUMBER[sub]}", raw, at + 5)
            value, at = ",".join([sub, *map(str, numbers)]), at + 5 + n * struct.calcsize(NUMBER[sub])
        out[key] = f"{kind}:{value}"
    return out


@lru_cache(1 << 12)
def _cigar_text(ops: bytes) -> str:
    return "".join(f"{v >> 4}{OPS[v & 15]}" for (v,) in struct.iter_unpack("<I", ops)) or "*"


def decode_record(raw: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_ops, flag, n, ref2, pos2, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32
    qname, _ = _text(raw, at)
    at += n_name
    cigar = (_cigar_text if 4 * n_ops <= SHORT else _cigar_text.__wrapped__)(raw[at : at + 4 * n_ops])
    at += 4 * n_ops
    packed = raw[at : at + (n + 1) // 2]
    seq = hexlify(packed).translate(FROM_BASES)[:n].decode() or "*"
    at += (n + 1) // 2
    qual = raw[at : at + n]
    at += n
    name = lambda i: names[i] if i >= 0 else "*"
    rnext = "=" if ref2 == ref and ref >= 0 else name(ref2)
    if not n or qual[0] == 255:
        text = "*"
    elif len(qual) == len(qual.translate(None, HIGH_SCORES)):
        text = qual.translate(FROM_SCORES).decode("latin-1")
    else:
        text = "".join(chr(q + 33) for q in qual)
    return qname, flag, name(ref), pos + 1, mapq, cigar, rnext, pos2 + 1, tlen, seq, text, _tags(raw, at)


@lru_cache(1 << 12)
def _encode_tag(key: str, value: str) -> bytes:
    if len(key) != 2 or value is None or value[1:2] != ":":
        return b""
    kind, value = value[0], value[2:]
    if kind == "i":
        number = int(value)
        kind = next(k for k, low, high in (("c", -128, 127), ("C", 0, 255), ("s", -32768, 32767), ("S", 0, 65535), ("i", -(2**31), 2**31 - 1), ("I", 0, 2**32 - 1)) if low <= number <= high)
        data = UNPACK[kind].pack(number)
    elif kind == "f":
        data = struct.pack("<f", float(value))
    elif kind == "A":
        data = value[:1].encode()
    elif kind == "B":
        sub, *numbers = value.split(",")
        data = sub.encode() + struct.pack(f"<i{len(numbers)}{NUMBER[sub]}", len(numbers), *[float(x) if sub == "f" else int(x) for x in numbers])
    else:
        kind, data = ("H" if kind == "H" else "Z"), value.encode() + b"\0"
    return key.encode() + kind.encode() + data


def _encode_tags(tags: dict[str, str] | None) -> bytes:
    return b"".join([(_encode_tag if v is None or len(v) <= SHORT else _encode_tag.__wrapped__)(k, v) for k, v in sorted((tags or {}).items())])


def _bin(start: int, end: int) -> int:
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


@lru_cache(1 << 12)
def _cigar_bytes(cigar: str) -> tuple[bytes, int]:
    """The operations of a CIGAR, none if it is malformed, and the bases of the reference under them, at least 1."""
    ops = re.findall(r"(\d+)([MIDNSHP=X])", cigar) if re.fullmatch(r"(\d+[MIDNSHP=X])+", cigar) else []
    return b"".join(struct.pack("<I", int(n) << 4 | OPS.index(o)) for n, o in ops), sum(int(n) for n, o in ops if o in "MDN=X") or 1


def encode_record(row: dict, ids: dict[str, int]) -> bytes:
    """A record; nulls as sentinels, a malformed CIGAR as none, letters without a code as N. ValueError for names of more than 254 bytes, which the format can't hold."""
    qname = (row["qname"] or "*").encode() + b"\0"
    if len(qname) > 255:
        raise ValueError(f"name of {len(qname) - 1} bytes: {row['qname'][:40]}...")
    cigar = row["cigar"] or "*"
    ops, span = (_cigar_bytes if len(cigar) <= SHORT else _cigar_bytes.__wrapped__)(cigar)
    seq = "" if (row["seq"] or "*") == "*" else row["seq"].upper()
    packed = unhexlify(seq.encode("latin-1", "replace").translate(TO_BASES) + b"0" * (len(seq) % 2))
    qual = row["qual"] or "*"
    if qual == "*" or len(qual) != len(seq):
        scores = bytes([255]) * len(seq)
    elif qual.isascii():
        scores = qual.encode().translate(TO_SCORES)
    else:
        scores = bytes(max(0, min(254, ord(c) - 33)) for c in qual)
    ref = ids.get(row["rname"] or "*", -1)
    ref2 = ref if row["rnext"] == "=" else ids.get(row["rnext"] or "*", -1)
    pos = (row["pos"] or 0) - 1
    mapq = row["mapq"] if row["mapq"] is not None and 0 <= row["mapq"] <= 255 else 255
    head = struct.pack("<iiBBHHHiiii", ref, pos, len(qname), mapq, _bin(max(pos, 0), max(pos, 0) + span) & 0xFFFF, len(ops) // 4, row["flag"] or 0, len(seq), ref2, (row["pnext"] or 0) - 1, row["tlen"] or 0)
    body = head + qname + ops + packed + scores + _encode_tags(row["tags"])
    return struct.pack("<i", len(body)) + body


def header_bytes(names: list[str], lengths: list[int], text: str = "") -> bytes:
    refs = b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", min(size, 2**31 - 1)) for n, size in zip(names, lengths, strict=True))
    raw = text.encode()
    return BAM + struct.pack("<i", len(raw)) + raw + struct.pack("<i", len(names)) + refs


def read_header(data: Blocks) -> list[tuple[str, int]]:
    """Names and lengths of the sequences; the stream goes on at the first record."""
    if data.take(4) != BAM:
        raise ValueError("no binary records")
    number = lambda: struct.unpack("<i", data.take(4))[0]
    data.take(number())
    return [(data.take(number())[:-1].decode(), number()) for _ in range(number())]


def read_names(data: Blocks) -> list[str]:
    return [n for n, _ in read_header(data)]


OFFSETS = ", file string, v_start bigint, v_end bigint"


class BamReader(DataSourceReader):
    """Byte ranges of the files, each from the first record that begins in it.

    Options: split, bytes of a range; region (name or name:start-end), records that overlap it,
    found by the .bai beside a file where there is one; offsets, with the file and the virtual
    offsets of each record.
    """

    def __init__(self, options: dict):
        self.path, self.split, self.offsets = options["path"], int(options.get("split", SPLIT)), options.get("offsets", "") == "true"
        self.region = _region(options["region"]) if options.get("region") else None

    def partitions(self) -> list[Part]:
        out = []
        for p in files_below(self.path, ".bam"):
            if self.region and exists(f"{p}.bai"):
                with open_file(p) as f:
                    names = read_names(Blocks(f))
                if self.region[0] in names:
                    out += [Part(p, -1 - a, b) for a, b in bai_chunks(f"{p}.bai", names.index(self.region[0]), *self.region[1:])]
            else:
                size = size_of(p)
                out += [Part(p, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        """A part with a negative start is a chunk between virtual offsets, another one a range of bytes."""
        if not part.path:
            return
        with open_file(part.path) as f:
            data = Blocks(f)
            names = read_names(data)
            if part.start < 0:
                at, end = -1 - part.start, part.end
            else:
                at, end = data.tell(), part.end << 16
                if part.start > at >> 16 and (at := first_record(f, part.start, part.end, len(names))) is None:
                    return
            data = Blocks(f)
            data.seek(at)
            while (at := data.tell()) < end and (size := data.take(4)):
                row = decode_record(data.take(struct.unpack("<i", size)[0]), names)
                if self.region is None or _overlaps(row, self.region):
                    yield (*row, part.path, at, data.tell()) if self.offsets else row


class BamBatches(BamReader):
    """The same records in batches of columns, which Spark takes as they are."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options)
        self.schema = schema

    def read(self, part: Part) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, records = to_arrow_schema(self.schema), super().read(part)
        while rows := list(islice(records, 10_000)):
            columns = [[list(t.items()) for t in c] if name == "tags" else c for name, c in zip(schema.names, zip(*rows), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _region(text: str) -> tuple[str, int, int]:
    """name, start and end of a region such as chr1, chr1:100 or chr1:100-200."""
    m = re.fullmatch(r"(.*?)(?::(\d+)(?:-(\d+))?)?", text)
    return m[1], int(m[2] or 1), int(m[3] or 2**31 - 1)


def _overlaps(row: tuple, region: tuple[str, int, int]) -> bool:
    name, start, end = region
    if row[2] != name or not 1 <= row[3] <= end:
        return False
    return row[3] + max(sum(int(n) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", row[5]) if o in "MDN=X"), 1) - 1 >= start


def bins_of(start: int, end: int) -> list[int]:
    """The bins whose records may overlap start to end (1-based, inclusive)."""
    return [0] + [b for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for b in range(offset + (max(start - 1, 0) >> shift), offset + (min(end, 1 << 29) - 1 >> shift) + 1)]


def bai_bytes(bins: list[dict[int, list[tuple[int, int]]]], linear: list[list[int]]) -> bytes:
    """An index file: for each sequence its chunks by bin, and the least offset of each window of 16 kb."""
    out = b"BAI\1" + struct.pack("<i", len(bins))
    for of, windows in zip(bins, linear, strict=True):
        out += struct.pack("<i", len(of))
        for b, chunks in sorted(of.items()):
            out += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        out += struct.pack("<i", len(windows)) + b"".join(struct.pack("<Q", w) for w in windows)
    return out


def read_bai(path: str) -> tuple[list[dict[int, list[tuple[int, int]]]], list[list[int]]]:
    """The inverse of bai_bytes."""
    with open_file(path) as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{path} is no such index")
    at, bins, linear = 8, [], []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        n, at, of = struct.unpack_from("<i", raw, at)[0], at + 4, {}
        for _ in range(n):
            b, k = struct.unpack_from("<Ii", raw, at)
            flat = struct.unpack_from(f"<{2 * k}Q", raw, at + 8)
            of[b], at = list(zip(flat[::2], flat[1::2])), at + 8 + 16 * k
        n = struct.unpack_from("<i", raw, at)[0]
        linear.append(list(struct.unpack_from(f"<{n}Q", raw, at + 4)))
        bins.append(of)
        at += 4 + 8 * n
    return bins, linear


def bai_chunks(path: str, sequence: int, start: int, end: int, whole: bool = False) -> list[tuple[int, int]]:
    """Chunks (virtual offsets) that may hold records overlapping a range, without those that end before its first window begins; neighbours are joined, but not where each stands as a whole."""
    bins, linear = read_bai(path)
    if sequence >= len(bins):
        return []
    window = max(start - 1, 0) >> 14
    least = linear[sequence][window] if window < len(linear[sequence]) else 0
    wanted = set(bins_of(start, end)) & bins[sequence].keys() if end - start < 1 << 26 else bins[sequence].keys()
    out: list[tuple[int, int]] = []
    for a, b in sorted(c for x in wanted for c in bins[sequence][x] if c[1] > least):
        if not whole and out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seqloom_bam"

    def schema(self) -> str:
        return READS_SCHEMA + (OFFSETS if self.options.get("offsets", "") == "true" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamBatches(dict(self.options), schema)


def write_bam(reads, contigs, path: str) -> None:
    """One file per partition, in its order, in a new or empty folder that all executors see. The sequence dictionary, bounded by the reference, goes to each task."""
    known = contigs.select("sequence_id", "name", "length").orderBy("sequence_id").collect()
    names, lengths = [r["name"] for r in known], [r["length"] for r in known]
    ids = {n: i for i, n in enumerate(names)}
    folder = NewFolder(path)
    columns = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]

    def run(batches):
        import pyarrow as pa

        name, n, held = folder.attempt(".bam"), 0, bytearray(header_bytes(names, lengths))
        with folder.create(name) as f:
            for batch in batches:
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    row = dict(zip(columns, values))
                    row["tags"] = dict(row["tags"] or [])
                    held += encode_record(row, ids)
                    n += 1
                    while len(held) >= 65_280:
                        f.write(block(bytes(held[:65_280])))
                        del held[:65_280]
            if held:
                f.write(block(bytes(held)))
            f.write(BGZF_END)
        yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    try:
        folder.keep(r["name"] for r in reads.select(*columns).mapInArrow(run, "name string, n bigint").collect())
    except BaseException:
        folder.close()
        raise


def sorted_for_index(reads, contigs):
    """reads in the order of contigs and positions, range-partitioned; what has no place comes last, spread by its name."""
    from pyspark.sql import functions as F

    ids = contigs.select(F.col("name").alias("_n"), "sequence_id").dropDuplicates(["_n"])
    key = F.when(F.col("sequence_id").isNull(), F.lit(2**62) + F.pmod(F.xxhash64("qname"), F.lit(2**31))).otherwise(F.col("sequence_id").cast("bigint") * 2**32 + F.coalesce("pos", F.lit(0)))
    df = reads.join(ids, F.col("rname") == F.col("_n"), "left").withColumn("_key", key).drop("_n", "sequence_id")
    return df.repartitionByRange("_key", F.xxhash64("qname")).sortWithinPartitions("_key")


def index_bam(spark: SparkSession, path: str) -> None:
    """Write X.bam.bai beside each file X.bam at or below path, from the places of its records; ValueError if one isn't sorted.

    The chunks of a file are put together by Spark; what goes to one task is a file's index.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    from seqloom.operators.index import linear_windows, record_chunks

    register(spark)
    files = {}
    for p in files_below(path, ".bam"):
        with open_file(p) as f:
            files[p] = {n: i for i, n in enumerate(read_names(Blocks(f)))}
    ids = spark.createDataFrame([(p, n, i) for p, of in files.items() for n, i in of.items()], "file string, rname string, sequence_id int")
    records = spark.read.format(BamSource.name()).option("offsets", "true").load(path).join(ids, ["file", "rname"]).filter("pos >= 1")
    chunks, windows = record_chunks(records), linear_windows(records)
    if bad := chunks.filter("unsorted").select("file").first():
        raise ValueError(f"{bad['file']} isn't sorted by coordinates")
    rows = chunks.select("file", "sequence_id", "bin", F.col("v_start"), F.col("v_end")).unionByName(windows.select("file", "sequence_id", (-1 - F.col("window")).alias("bin"), F.col("offset").alias("v_start"), F.lit(0).cast("bigint").alias("v_end")))
    sizes = {p: len(of) for p, of in files.items()}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bins, linear = [{} for _ in range(sizes[key[0].as_py()])], [{} for _ in range(sizes[key[0].as_py()])]
        for s, b, v, e in zip(*(t.column(c).to_pylist() for c in ("sequence_id", "bin", "v_start", "v_end"))):
            if b < 0:
                linear[s][-1 - b] = v
            else:
                bins[s].setdefault(b, []).append((v, e))
        raw = bai_bytes([{b: sorted(c) for b, c in of.items()} for of in bins], [[of[w] for w in sorted(of)] for of in linear])
        fs, inner = resolve(key[0].as_py() + ".bai")
        with fs.open_output_stream(inner, compression=None) as f:
            f.write(raw)
        return pa.table({"n": pa.array([len(raw)], pa.int64())})

    rows.groupBy("file").applyInArrow(run, "n bigint").collect()


def register(spark: SparkSession) -> None:
    from seqloom.sources.container import CramSource

    for source in (FastqSource, BamSource, CramSource):
        spark.dataSource.register(source)

"""The reference-compressed container format, version 2: reader, writer and data source."""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from seqloom.sources import codecs as c
from seqloom.plans.shared import row_numbers
from seqloom.sources.binary import READS_SCHEMA, _encode_tags, _overlaps, _region, _tags, bai_chunks
from seqloom.sources.files import NewFolder, exists, files_below, open_file, size_of

MAGIC, VERSION, FILE_ID = b"CRAM", (2, 0), 20
# Kinds of blocks.
FILE_HEADER, COMPRESSION_HEADER, SLICE, EXTERNAL_BLOCK, CORE_BLOCK = 0, 1, 2, 4, 5
# The letters that a substitution code stands for, by reference letter, where codes follow the order ACGTN.
LETTERS = "ACGTN"
PLAIN_MATRIX = bytes([0x1B] * 5)
# Kinds of the series. The numbers of their external blocks follow this order in what is written here.
SERIES = {
    "BF": "int", "CF": "byte", "RI": "int", "RL": "int", "AP": "int", "RG": "int", "RN": "array", "MF": "byte", "NS": "int", "NP": "int", "TS": "int", "NF": "int", "TL": "int", "FN": "int", "FC": "byte", "FP": "int",
    "BA": "byte", "QS": "byte", "BS": "byte", "IN": "array", "SC": "array", "DL": "int", "RS": "int", "HC": "int", "PD": "int", "MQ": "int",
}
RECORDS = 10_000


def _block(kind: int, number: int, raw: bytes) -> bytes:
    packed = gzip.compress(raw, 6, mtime=0) if len(raw) > 64 else raw
    return bytes([int(packed is not raw), kind]) + c.write_itf8(number) + c.write_itf8(len(packed)) + c.write_itf8(len(raw)) + packed


def _read_block(b: c.Bytes) -> tuple[int, int, bytes]:
    method, kind = b.take(2)
    number, packed, _ = b.itf8(), b.itf8(), b.itf8()
    data = b.take(packed)
    if method > 1:
        raise ValueError(f"unknown compression {method}")
    return kind, number, gzip.decompress(data) if method else data


@dataclass
class Head:
    """A container's header, and where its blocks begin."""

    size: int
    sequence: int
    start: int
    span: int
    records: int
    counter: int
    bases: int
    blocks: int
    landmarks: list[int]
    body: int
    start_byte: int


def container_heads(path: str, at: int = 26) -> Iterator[Head]:
    """The headers of a file's containers, one after another from a byte on, without their blocks."""
    end = size_of(path)
    with open_file(path) as f:
        while at < end:
            f.seek(at)
            b = c.Bytes(f.read(1 << 12))
            size = struct.unpack("<i", b.take(4))[0]
            head = Head(size, b.itf8(), b.itf8(), b.itf8(), b.itf8(), b.ltf8(), b.ltf8(), b.itf8(), b.array(), 0, at)
            head.body = at + b.at
            yield head
            at = head.body + size


def read_header(path: str) -> tuple[tuple[int, int], str]:
    """Version and the text of the record header."""
    with open_file(path) as f:
        start = f.read(26)
        if start[:4] != MAGIC:
            raise ValueError(f"{path} isn't of this format")
        head = next(container_heads(path))
        f.seek(head.body)
        _, _, raw = _read_block(c.Bytes(f.read(head.size)))
    return (start[4], start[5]), raw[4 : 4 + struct.unpack_from("<i", raw)[0]].decode()


def header_names(text: str) -> tuple[list[str], list[str]]:
    """Sequence names and read group ids in their order."""
    cells = [dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x) | {"_": line[:3]} for line in text.splitlines()]
    return [x["SN"] for x in cells if x["_"] == "@SQ"], [x["ID"] for x in cells if x["_"] == "@RG"]


class Reference:
    """Upper-case letters of a FASTA file, read by ranges; what isn't one of ACGTN becomes N.

    Places come from X.fai, or, where there is none, from one pass over the file per worker. The
    lines of a sequence must be of one length but the last.
    """

    AHEAD = 1 << 16

    def __init__(self, path: str):
        self.path, self.places, self.file = path, {}, None
        if exists(f"{path}.fai"):
            with open_file(f"{path}.fai") as f:
                for line in f.read().decode().splitlines():
                    name, *rest = line.split("\t")
                    self.places[name] = tuple(map(int, rest[:4]))
        else:
            self._scan()

    def _scan(self) -> None:
        name, ended = None, False
        with open_file(self.path) as f:
            at = 0
            for line in f:
                at += len(line)
                if line.startswith(b">"):
                    name, ended = (line[1:].split() or [b""])[0].decode(), False
                    self.places[name] = (0, at, 0, 0)
                elif name is not None and (n := len(line.rstrip(b"\r\n"))):
                    size, first, bases, width = self.places[name]
                    if ended or bases and n > bases:
                        raise ValueError(f"lines of {name} differ in length")
                    ended = bool(bases) and n < bases
                    self.places[name] = (size + n, first, bases or n, width or len(line))

    def letters(self, name: str, start: int, end: int) -> str:
        """From start to end - 1, counted from 0; shorter where the sequence ends, empty where there is none."""
        size, first, bases, width = self.places.get(name, (0, 0, 0, 0))
        start, end = max(start, 0), min(end, size)
        if start >= end:
            return ""
        byte = lambda p: first + p // bases * width + p % bases
        self.file = self.file or open_file(self.path)
        self.file.seek(byte(start))
        raw = self.file.read(byte(end - 1) + 1 - byte(start))
        return re.sub("[^ACGTN]", "N", raw.translate(None, b"\r\n").decode("latin-1").upper())


class Letters:
    """One sequence of a reference, to be sliced like a text; what was read last is kept, with what follows it."""

    def __init__(self, reference: Reference | None, name: str):
        self.reference, self.name, self.start, self.held = reference, name, 0, ""

    def __getitem__(self, part: slice) -> str:
        start, end = part.start, part.stop
        if self.reference is None or end <= start:
            return ""
        if not self.start <= start <= end <= self.start + len(self.held):
            self.start = max(start, 0)
            self.held = self.reference.letters(self.name, self.start, max(end, self.start + Reference.AHEAD))
        return self.held[max(start, 0) - self.start : max(end, 0) - self.start]


@lru_cache(maxsize=2)
def load_reference(path: str) -> Reference:
    return Reference(path)


class Compression:
    """A compression header: preserved facts, encodings of series and tags."""

    def __init__(self, raw: bytes):
        b = c.Bytes(raw)
        self.names, self.delta, self.tag_sets, matrix = True, True, [[]], PLAIN_MATRIX
        m = c.Bytes(b.take(b.itf8()))
        for _ in range(m.itf8()):
            key = m.take(2)
            if key == b"RN":
                self.names = m.byte() == 1
            elif key == b"AP":
                self.delta = m.byte() == 1
            elif key == b"SM":
                matrix = m.take(5)
            elif key == b"TD":
                self.tag_sets = [[s[i : i + 3] for i in range(0, len(s), 3)] for s in m.take(m.itf8()).split(b"\0")[:-1]]
            else:
                m.byte()
        self.base = {(r, packed >> 6 - 2 * i & 3): x for r, packed in zip(LETTERS, matrix) for i, x in enumerate(LETTERS.replace(r, ""))}
        self.series = self._map(c.Bytes(b.take(b.itf8())), lambda m: m.take(2).decode())
        self.tags = self._map(c.Bytes(b.take(b.itf8())), lambda m: m.itf8().to_bytes(3, "big"))

    @staticmethod
    def _map(m: c.Bytes, key) -> dict:
        return {key(m): (m.byte(), m.take(m.itf8())) for _ in range(m.itf8())}


def _slice(b: c.Bytes) -> tuple[c.Bytes, list[tuple[int, int, bytes]]]:
    _, _, head = _read_block(b)
    h = c.Bytes(head)
    sequence, start, span, n, counter, blocks = h.itf8(), h.itf8(), h.itf8(), h.itf8(), h.ltf8(), h.itf8()
    h.info = (sequence, start, span, n, counter)
    return h, [_read_block(b) for _ in range(blocks)]


def read_container(path: str, head: Head, names: list[str], groups: list[str], reference: Reference | None, from_slice: int = 0, how_many: int | None = None) -> Iterator[tuple]:
    """The records of a container, or of how_many of its slices from one on, as rows of READS_SCHEMA."""
    with open_file(path) as f:
        f.seek(head.body)
        b = c.Bytes(f.read(head.size))
    _, _, raw = _read_block(b)
    comp = Compression(raw)
    for place in (head.landmarks or [b.at])[from_slice:][:how_many]:
        b.at = place
        h, parts = _slice(b)
        sequence, start, _, n, counter = h.info
        core = c.BitReader(next((raw for kind, _, raw in parts if kind == CORE_BLOCK), b""))
        external = {number: c.Bytes(raw) for kind, number, raw in parts if kind == EXTERNAL_BLOCK}
        get = {k: c.reader(*comp.series.get(k, (c.NULL, b"")), core, external, kind) for k, kind in SERIES.items()}
        tag = {k: c.reader(*e, core, external, "array") for k, e in comp.tags.items()}
        rows = [_record(get, tag, comp, sequence, counter + i) for i in range(n)]
        yield from _finished(rows, start, comp, names, groups, reference)


def _record(get: dict, tag: dict, comp: Compression, sequence: int, number: int) -> dict:
    r: dict = {"flag": get["BF"](), "cf": get["CF"](), "number": number}
    r["ref"] = get["RI"]() if sequence == -2 else sequence
    r["n"], r["ap"], r["rg"] = get["RL"](), get["AP"](), get["RG"]()
    r["name"] = get["RN"]().decode() if comp.names else None
    if r["cf"] & 2:
        r["mf"] = get["MF"]()
        if not comp.names:
            r["name"] = get["RN"]().decode()
        r["mate_ref"], r["mate_pos"], r["tlen"] = get["NS"](), get["NP"](), get["TS"]()
    elif r["cf"] & 4:
        r["next"] = get["NF"]()
    r["tags"] = b"".join(k + tag[k]() for k in comp.tag_sets[get["TL"]()])
    if r["flag"] & 4:
        r["bases"] = bytes(get["BA"]() for _ in range(r["n"])).decode()
    else:
        r["features"], at = [], 0
        for _ in range(get["FN"]()):
            op = chr(get["FC"]())
            at += get["FP"]()
            if op == "B":
                value = chr(get["BA"]()), get["QS"]()
            elif op in "IS":
                value = get["IN" if op == "I" else "SC"]().decode()
            else:
                value = get[{"X": "BS", "i": "BA", "D": "DL", "N": "RS", "H": "HC", "P": "PD", "Q": "QS"}[op]]()
            r["features"].append((op, at, value))
        r["mapq"] = get["MQ"]()
    r["qual"] = bytes(get["QS"]() for _ in range(r["n"])) if r["cf"] & 1 else None
    return r


def _aligned(r: dict, comp: Compression, ref: Letters) -> tuple[str, str, bytearray | None]:
    """CIGAR, bases and scores from the features."""
    ops: list[list] = []
    seq: list[str] = []
    scores = bytearray([30] * r["n"]) if any(f[0] == "Q" for f in r["features"]) else None
    at, place = 1, r["pos"] - 1

    def put(op: str, n: int) -> None:
        if n and ops and ops[-1][0] == op:
            ops[-1][1] += n
        elif n:
            ops.append([op, n])

    def upto(p: int) -> None:
        nonlocal at, place
        if p > at:
            put("M", p - at)
            seq.append(ref[place : place + p - at].ljust(p - at, "N"))
            place, at = place + p - at, p

    for op, p, value in r["features"]:
        if op == "Q":
            scores[p - 1] = value
            continue
        upto(p)
        if op in "XB":
            r_base = ref[place : place + 1] or "N"
            seq.append(comp.base[r_base, value] if op == "X" else value[0])
            put("M", 1)
            at, place = at + 1, place + 1
        elif op in "IiS":
            value = chr(value) if op == "i" else value
            put("S" if op == "S" else "I", len(value))
            seq.append(value)
            at += len(value)
        else:
            put(op, value)
            place += value if op in "DN" else 0
    upto(r["n"] + 1)
    return "".join(f"{n}{o}" for o, n in ops) or "*", "".join(seq) or "*", scores


def _finished(rows: list[dict], start: int, comp: Compression, names: list[str], groups: list[str], reference: Reference | None) -> Iterator[tuple]:
    before, letters = start, {}
    for r in rows:
        r["pos"] = before = before + r["ap"] if comp.delta else r["ap"]
    name = lambda i: names[i] if 0 <= i < len(names) else "*"
    for i, r in enumerate(rows):
        if "next" in r:  # positional mates within the slice
            m = rows[i + r["next"] + 1]
            for a, b in ((r, m), (m, r)):
                a |= {"mate_ref": b["ref"], "mate_pos": b["pos"], "mf": (b["flag"] >> 4 & 1) | (b["flag"] >> 1 & 2)}
            m["name"] = r["name"] = r["name"] or str(r["number"])
    for r in rows:
        mf = r.get("mf", 0)
        flag = r["flag"] | (0x20 if mf & 1 else 0) | (8 if mf & 2 else 0)
        if r["flag"] & 4:
            cigar, seq, scores = "*", r["bases"] or "*", None
        else:
            of = name(r["ref"])
            if of not in letters:
                letters[of] = Letters(reference, of)
            cigar, seq, scores = _aligned(r, comp, letters[of])
        qual = r["qual"] if r["qual"] is not None else scores
        text = "*" if not qual else bytes(min(q, 93) + 33 for q in qual).decode("latin-1")
        mate = r.get("mate_ref", -1)
        rnext = "=" if mate == r["ref"] and mate >= 0 else name(mate)
        yield r["name"] or str(r["number"]), flag, name(r["ref"]), r["pos"], r.get("mapq", 0), cigar, rnext, r.get("mate_pos", 0), r.get("tlen", 0), seq, text, _tags(r["tags"], 0) | ({"RG": f"Z:{groups[r['rg']]}"} if 0 <= r["rg"] < len(groups) else {})


@dataclass
class Part(InputPartition):
    path: str
    heads: list[Head]


#: Bytes of neighbouring containers that make one partition.
TOGETHER = 4 << 20


class CramReader(DataSourceReader):
    """Partitions of whole containers: their headers are read ahead, their blocks only by the tasks.

    Options: reference, a FASTA file; region (name or name:start-end), records that overlap it.
    Containers that can't hold wanted records are left out, by their headers, or, where X.crai or
    else X.bai lies beside X, without reading those. pushdown: filters that Spark hands down on rname and pos
    narrow the containers in the same way; it needs spark.sql.python.filterPushdown.enabled.
    """

    def __init__(self, options: dict):
        self.path, self.reference = options["path"], options.get("reference")
        self.region = _region(options["region"]) if options.get("region") else None
        self.name, self.low, self.high = self.region or (None, 1, 2**31 - 1)

    def _wanted(self, path: str) -> Iterator[Head]:
        heads = container_heads(path)
        first = next(heads, None)
        if self.name is None:
            yield from (h for h in heads if h.records)
            return
        names, _ = header_names(read_header(path)[1]) if first else ([], [])
        # A name that the header lacks can only stand on records without a known sequence.
        sequence = names.index(self.name) if self.name in names else -1
        fits = lambda s, start, span: s == -2 or s == sequence and (s < 0 or start <= self.high and start + max(span, 1) - 1 >= self.low)
        if exists(f"{path}.crai"):
            with open_file(f"{path}.crai") as f:
                index = [tuple(map(int, line.split("\t"))) for line in gzip.decompress(f.read()).decode().splitlines()]
            places = sorted({x[3] for x in index if fits(*x[:3])})
            yield from (next(container_heads(path, at)) for at in places)
        elif exists(f"{path}.bai") and sequence >= 0:
            places = sorted({a >> 16 for a, _ in bai_chunks(f"{path}.bai", sequence, self.low, self.high, whole=True)})
            yield from (h for h in (next(container_heads(path, at)) for at in places) if fits(h.sequence, h.start, h.span))
        else:
            yield from (h for h in heads if h.records and fits(h.sequence, h.start, h.span))

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        for p in files_below(self.path, ".cram"):
            size = TOGETHER
            for head in self._wanted(p):
                if size >= TOGETHER:
                    out.append(Part(p, []))
                    size = 0
                out[-1].heads.append(head)
                size += head.size
        return out or [Part("", [])]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.heads:
            return
        names, groups = header_names(read_header(part.path)[1])
        reference = load_reference(self.reference) if self.reference else None
        for head in part.heads:
            rows = read_container(part.path, head, names, groups, reference)
            yield from rows if self.region is None else (r for r in rows if _overlaps(r, self.region))


class FilteredCramReader(CramReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = getattr(f, "attribute", None)
            if isinstance(f, EqualTo) and at == ("rname",) and self.name in (None, f.value):
                self.name = f.value
            elif at == ("pos",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f  # only containers are left out; Spark still looks at the records


class CramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seqloom_cram"

    def schema(self) -> str:
        return READS_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredCramReader if self.options.get("pushdown", "") == "true" else CramReader)(dict(self.options))


def _int_codes(values: list[int]) -> tuple[int, int, bytes, Callable[[c.BitWriter, int], None]]:
    """The cheapest bit code of a series: its bits, kind, parameters, and what puts a value."""
    from seqloom.functions.encoding import DICTIONARY
    from seqloom.operators.storage import huffman_lengths

    counts = Counter(values)
    low, high = min(counts), max(counts)
    shift = max(0, -low)
    width = (high + shift).bit_length()
    two = lambda a, b: c.write_itf8(a) + c.write_itf8(b)
    total = lambda cost: sum(n * cost(v) for v, n in counts.items())
    sub = lambda k: lambda v: k + 1 if v + shift < 1 << k else 2 * (v + shift).bit_length() - k
    found = [(total(lambda v: 2 * (v + shift + 1).bit_length() - 1), 0, c.GAMMA, c.write_itf8(shift + 1), lambda w, v: c.put_gamma(w, v, shift + 1))]
    found += [(total(sub(k)), k, c.SUBEXP, two(shift, k), lambda w, v, k=k: c.put_subexp(w, v, shift, k)) for k in (2, 3, 4)]
    found.append((width * len(values), 5, c.BETA, two(shift, width), lambda w, v: w.put(v + shift, width)))
    if len(counts) < DICTIONARY:
        keys = sorted(counts)
        lengths = huffman_lengths([counts[v] for v in keys])
        book = c.canonical(keys, lengths)
        found.append((sum(n * counts[v] for v, n in zip(keys, lengths)), 6, c.HUFFMAN, c.write_array(keys) + c.write_array(lengths), lambda w, v: w.put(*book[v])))
    bits, _, kind, params, put = min(found, key=lambda x: x[:2])
    return bits, kind, params, put


class _Writer:
    """Collects the series of a slice: bytes and texts as they are, integers with their order among each other."""

    def __init__(self) -> None:
        self.out = {k: bytearray() for k in SERIES}
        self.events: list[tuple[str, int]] = []
        self.sets: dict[tuple[bytes, ...], int] = {}
        self.tags: dict[bytes, tuple[bytearray, bytearray]] = {}

    def int(self, key: str, v: int) -> None:
        self.events.append((key, v))

    def byte(self, key: str, v: int) -> None:
        self.out[key].append(v)

    def array(self, key: str, v: bytes) -> None:
        self.out[key] += v + b"\0"

    def coded(self) -> tuple[dict[str, tuple[int, bytes]], bytes]:
        """The encodings of integer series in the core block, each where its best code takes fewer bytes than a packed block of its own, and that block; the others become bytes."""
        by_key: dict[str, list[int]] = {}
        for k, v in self.events:
            by_key.setdefault(k, []).append(v)
        chosen, put = {}, {}
        for k, values in by_key.items():
            raw = b"".join(map(c.write_itf8, values))
            bits, kind, params, one = _int_codes(values)
            if bits // 8 + len(params) < len(_block(EXTERNAL_BLOCK, 0, raw)):
                chosen[k], put[k] = (kind, params), one
            else:
                self.out[k] += raw
        core = c.BitWriter()
        for k, v in self.events:
            if k in put:
                put[k](core, v)
        return chosen, core.data()


def _features(pos: int, ops: list[tuple[int, str]], seq: str, ref: Letters) -> Iterator[tuple[str, int, object]]:
    at, place = 1, pos - 1
    for n, op in ops:
        if op in "M=X":
            own = ref[place : place + n].ljust(n, "N")
            for i in range(n):
                a, b = seq[at - 1 + i], own[i]
                if a != b:
                    yield ("X", at + i, LETTERS.replace(b, "").index(a)) if a in LETTERS and b in LETTERS else ("B", at + i, a)
        elif n:
            yield op, at, seq[at - 1 : at - 1 + n] if op in "IS" else n
        at += n if op in "MIS=X" else 0
        place += n if op in "MDN=X" else 0


def _put(w: _Writer, row: dict, ids: dict[str, int], groups: dict[str, int], ref: Letters, start: int, pos: int) -> tuple[int, int]:
    flag = row["flag"] or 0
    seq = "" if (row["seq"] or "*") == "*" else row["seq"].upper()
    cigar = row["cigar"] or "*"
    ops = [(int(n), o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)] if re.fullmatch(r"(\d+[MIDNSHP=X])+", cigar) else []
    if sum(n for n, o in ops if o in "MIS=X") != len(seq):
        ops = []
    qual = row["qual"] or "*"
    kept = None if row.get("forced", True) else row["scores"] or []
    scored = kept is None and qual != "*" and len(qual) == len(seq) > 0
    own = ids.get(row["rname"] or "*", -1)
    mapped = not flag & 4 and bool(ops) and own >= 0 and pos >= 1
    w.int("BF", (flag & ~0x28 & 0xFFF) | (0 if mapped else 4))
    w.byte("CF", 2 | scored)
    w.int("RL", len(seq))
    w.int("AP", pos - start)
    tags = row["tags"] or {}
    group = groups.get((tags.get("RG") or "")[2:], -1) if (tags.get("RG") or "").startswith("Z:") else -1
    w.int("RG", group)
    w.array("RN", (row["qname"] or "*").replace("\0", "").encode())
    w.byte("MF", (flag >> 5 & 1) | (flag >> 2 & 2))
    w.int("NS", own if row["rnext"] == "=" else ids.get(row["rnext"] or "*", -1))
    w.int("NP", row["pnext"] or 0)
    w.int("TS", row["tlen"] or 0)
    cells = []
    for key, value in sorted(tags.items()):
        if (group < 0 or key != "RG") and (raw := _encode_tags({key: value})):
            cells.append((raw[:3], raw[3:]))
    w.int("TL", w.sets.setdefault(tuple(k for k, _ in cells), len(w.sets)))
    for k, v in cells:
        sizes, data = w.tags.setdefault(k, (bytearray(), bytearray()))
        sizes += c.write_itf8(len(v))
        data += v
    if mapped:
        found = list(_features(pos, ops, seq, ref))
        if kept:
            found = sorted(found + [("Q", i + 1, min(q, 93)) for i, q in enumerate(kept) if q >= 0], key=lambda x: x[1])
        w.int("FN", len(found))
        at = 0
        for op, p, value in found:
            w.byte("FC", ord(op))
            w.int("FP", p - at)
            at = p
            if op == "X":
                w.byte("BS", value)
            elif op == "B":
                w.byte("BA", ord(value) & 0xFF)
                w.byte("QS", 0)
            elif op == "Q":
                w.byte("QS", value)
            elif op in "IS":
                w.array("IN" if op == "I" else "SC", value.encode())
            else:
                w.int({"D": "DL", "N": "RS", "H": "HC", "P": "PD"}[op], value)
        mapq = row["mapq"] or 0
        w.int("MQ", mapq if 0 <= mapq <= 255 else 255)
    else:
        w.out["BA"] += seq.encode("latin-1", "replace")
    if scored:
        w.out["QS"] += bytes(max(0, min(93, ord(x) - 33)) for x in qual)
    return len(seq), pos + (sum(n for n, o in ops if o in "MDN=X") if mapped else 1)


def write_container(rows: list[dict], sequence: int, ids: dict[str, int], groups: dict[str, int], ref: Letters, counter: int) -> tuple[bytes, str]:
    """One container of one slice of records of one sequence, and its line of the index but the container's place."""
    w = _Writer()
    places = [(r["pos"] or 0) if sequence >= 0 else 0 for r in rows]
    start = min(places, default=0)
    before, n_bases, stop = start, 0, start
    for r, pos in zip(rows, places, strict=True):
        n, end = _put(w, r, ids, groups, ref, before, pos)
        before, n_bases, stop = pos, n_bases + n, max(stop, end)
    number = {k: i + 1 for i, k in enumerate(SERIES)}
    series, (chosen, core) = b"", w.coded()
    for k, kind in SERIES.items():
        if k in chosen:
            series += k.encode() + bytes([chosen[k][0]]) + c.write_itf8(len(chosen[k][1])) + chosen[k][1]
            continue
        params = (b"\0" + c.write_itf8(number[k])) if kind == "array" else c.write_itf8(number[k])
        series += k.encode() + bytes([c.ARRAY_STOP if kind == "array" else c.EXTERNAL]) + c.write_itf8(len(params)) + params
    tags, blocks, at = b"", [(number[k], bytes(v)) for k, v in w.out.items() if v], len(SERIES) + 1
    for k, (sizes, data) in w.tags.items():
        a, b = c.write_itf8(at), c.write_itf8(at + 1)
        params = bytes([c.EXTERNAL]) + c.write_itf8(len(a)) + a + bytes([c.EXTERNAL]) + c.write_itf8(len(b)) + b
        tags += c.write_itf8(int.from_bytes(k, "big")) + bytes([c.ARRAY_LEN]) + c.write_itf8(len(params)) + params
        blocks += [(at, bytes(sizes)), (at + 1, bytes(data))]
        at += 2
    dictionary = b"".join(b"".join(s) + b"\0" for s in w.sets)
    facts = c.write_itf8(4) + b"RN\1" + b"AP\1" + b"SM" + PLAIN_MATRIX + b"TD" + c.write_itf8(len(dictionary)) + dictionary
    sized = lambda x: c.write_itf8(len(x)) + x
    header = _block(COMPRESSION_HEADER, 0, sized(facts) + sized(c.write_itf8(len(SERIES)) + series) + sized(c.write_itf8(len(w.tags)) + tags))
    span = max(stop - start, 0)
    md5 = hashlib.md5(ref[start - 1 : start - 1 + span].encode()).digest() if sequence >= 0 and start > 0 else bytes(16)
    head = c.write_itf8(sequence) + c.write_itf8(start) + c.write_itf8(span) + c.write_itf8(len(rows)) + c.write_ltf8(counter) + c.write_itf8(len(blocks) + 1) + c.write_array([i for i, _ in blocks]) + c.write_itf8(-1) + md5
    body = header + _block(SLICE, 0, head) + _block(CORE_BLOCK, 0, core) + b"".join(_block(EXTERNAL_BLOCK, i, raw) for i, raw in blocks)
    line = f"{sequence}\t{start}\t{span}\t{{}}\t{len(header)}\t{len(body) - len(header)}"
    return struct.pack("<i", len(body)) + c.write_itf8(sequence) + c.write_itf8(start) + c.write_itf8(span) + c.write_itf8(len(rows)) + c.write_ltf8(counter) + c.write_ltf8(n_bases) + c.write_itf8(len(blocks) + 3) + c.write_array([len(header)]) + body, line


def file_start(text: str) -> bytes:
    raw = text.encode()
    body = _block(FILE_HEADER, 0, struct.pack("<i", len(raw)) + raw)
    return MAGIC + bytes(VERSION) + bytes(FILE_ID) + struct.pack("<i", len(body)) + c.write_itf8(0) * 4 + c.write_ltf8(0) * 2 + c.write_itf8(1) + c.write_array([]) + body


def write_cram(reads: DataFrame, contigs: DataFrame, reference: str, path: str, records: int = RECORDS, groups: DataFrame | None = None, most: int | None = None) -> None:
    """Files by ranges of coordinates in the order of contigs, each with its index beside it (X.crai), in a new or empty folder that all executors see.

    reference: a FASTA file they see, too, best with its .fai; only the ranges that records lie on
    are read. groups: the read groups (rg) of the header; a record's RG tag that names one of them
    becomes its read group. most: write only so many records. Records are counted through all files.

    Where reads have the columns scores and forced of rules, records whose scores aren't forced
    keep only those above -1, as features; what is unmapped keeps none of them then.

    Kept are names, flags, places, mates, TLEN, bases in upper case, scores up to 93 and tags.
    = and X come back as M. A record without a CIGAR that fits its bases, or without a
    place, is written as unmapped and loses CIGAR and MAPQ; unknown sequence names become *.
    """
    known = contigs.select("sequence_id", "name", "length").orderBy("sequence_id").collect()
    ids = {r["name"]: i for i, r in enumerate(known)}
    own = [r[0] for r in groups.select("rg").filter("rg is not null").distinct().orderBy("rg").collect()] if groups is not None else []
    group_ids = {g: i for i, g in enumerate(own)}
    text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{r['name']}\tLN:{r['length']}\n" for r in known) + "".join(f"@RG\tID:{g}\n" for g in own)
    folder = NewFolder(path)
    columns = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "tags"]

    def run(batches):
        import pyarrow as pa

        letters: dict[str, Letters] = {}
        name, n, index = folder.attempt(".cram"), 0, []
        with folder.create(name) as f:
            f.write(file_start(text))
            at = len(file_start(text))
            held: list[dict] = []

            def flush() -> None:
                nonlocal at, n, held
                if held:
                    of = held[0]["rname"] or "*"
                    if of not in letters:
                        letters.clear()
                        letters[of] = Letters(load_reference(reference), of)
                    raw, line = write_container(held, ids.get(of, -1), ids, group_ids, letters[of], held[0]["_rn"] - 1)
                    f.write(raw)
                    index.append(line.format(at))
                    at, n, held = at + len(raw), n + len(held), []

            for batch in batches:
                for row in batch.to_pylist():
                    row["tags"] = dict(row["tags"] or [])
                    if held and (len(held) >= records or ids.get(held[0]["rname"] or "*", -1) != ids.get(row["rname"] or "*", -1)):
                        flush()
                    held.append(row)
            flush()
        with folder.create(f"{name}.crai") as f:
            f.write(gzip.compress("".join(x + "\n" for x in index).encode(), mtime=0))
        yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    place = contigs.select(F.col("name").alias("_n"), "sequence_id").dropDuplicates(["_n"])
    # What has no place comes last, in the order of a hash, so that it is spread like the rest.
    key = F.when(F.col("sequence_id").isNull(), F.lit(2**62) + F.pmod(F.xxhash64("qname"), F.lit(2**31))).otherwise(F.col("sequence_id").cast("bigint") * 2**32 + F.coalesce("pos", F.lit(0)))
    df = reads if most is None else reads.limit(most)
    columns += [c for c in ("scores", "forced") if c in reads.columns]
    df = df.select(*columns).join(place, F.col("rname") == F.col("_n"), "left").withColumn("_key", key).select(*columns, "_key")
    df = row_numbers(df, [], ["_key", "qname", "flag"], F.shiftright("_key", 14), "_rn")
    parts = max(df.rdd.getNumPartitions(), reads.sparkSession.sparkContext.defaultParallelism)
    ordered = df.repartitionByRange(parts, "_rn").sortWithinPartitions("_rn").select(*columns, "_rn")
    try:
        names = [r["name"] for r in ordered.mapInArrow(run, "name string, n bigint").collect()]
        folder.keep(x for n in names for x in (n, f"{n}.crai"))
    except BaseException:
        folder.close()
        raise

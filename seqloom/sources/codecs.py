"""Variable-length integers, bit streams and the value codes of the container format."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Numbers of the encodings.
NULL, EXTERNAL, GOLOMB, HUFFMAN, ARRAY_LEN, ARRAY_STOP, BETA, SUBEXP, GOLOMB_RICE, GAMMA = range(10)


def write_itf8(v: int) -> bytes:
    """A 32-bit integer in one to five bytes: the leading ones of the first byte count the further ones."""
    v &= 0xFFFFFFFF
    for n, bits in enumerate((7, 14, 21, 28)):
        if v < 1 << bits:
            return ((0xFF << (8 - n) & 0xFF) << 8 * n | v).to_bytes(n + 1, "big")
    return bytes([0xF0 | v >> 28, v >> 20 & 0xFF, v >> 12 & 0xFF, v >> 4 & 0xFF, v & 0x0F])


def write_ltf8(v: int) -> bytes:
    """A 64-bit integer in one to nine bytes."""
    v &= (1 << 64) - 1
    for n in range(8):
        if v < 1 << 7 * (n + 1):
            return ((0xFF << (8 - n) & 0xFF) << 8 * n | v).to_bytes(n + 1, "big")
    return b"\xff" + v.to_bytes(8, "big")


class Bytes:
    """A place in a byte string."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def until(self, stop: int) -> bytes:
        end = self.data.index(stop, self.at)
        out = self.data[self.at : end]
        self.at = end + 1
        return out

    def itf8(self) -> int:
        first = self.byte()
        n = 0
        while n < 4 and first & 0x80 >> n:
            n += 1
        if n == 4:
            a, b, c, d = self.take(4)
            v = (first & 0x0F) << 28 | a << 20 | b << 12 | c << 4 | d & 0x0F
        else:
            v = (first & 0xFF >> (n + 1)) << 8 * n | int.from_bytes(self.take(n), "big")
        return v - (1 << 32) if v >= 1 << 31 else v

    def ltf8(self) -> int:
        first = self.byte()
        n = 0
        while n < 8 and first & 0x80 >> n:
            n += 1
        head = first & 0xFF >> (n + 1) if n < 7 else 0
        v = head << 8 * n | int.from_bytes(self.take(n), "big")
        return v - (1 << 64) if v >= 1 << 63 else v

    def array(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


def write_array(values: list[int]) -> bytes:
    return write_itf8(len(values)) + b"".join(map(write_itf8, values))


class BitWriter:
    """Bits from the high one down."""

    def __init__(self) -> None:
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.bits.append(format(value & (1 << n) - 1, f"0{n}b"))

    def text(self) -> str:
        return "".join(self.bits)

    def data(self) -> bytes:
        text = self.text()
        return int(text + "0" * (-len(text) % 8) or "0", 2).to_bytes((len(text) + 7) // 8, "big")


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        if self.at >= 8 * len(self.data):
            raise EOFError
        b = self.data[self.at >> 3] >> 7 - (self.at & 7) & 1
        self.at += 1
        return b

    def get(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def run(self, bit: int) -> int:
        n = 0
        while self.bit() == bit:
            n += 1
        return n


def put_gamma(w: BitWriter, v: int, offset: int = 0) -> None:
    n = (v + offset).bit_length()
    w.put(0, n - 1)
    w.put(v + offset, n)


def get_gamma(r: BitReader, offset: int = 0) -> int:
    n = r.run(0)
    return (1 << n | r.get(n)) - offset


def put_subexp(w: BitWriter, v: int, offset: int, k: int) -> None:
    v += offset
    b = k if v < 1 << k else v.bit_length() - 1
    u = 0 if v < 1 << k else b - k + 1
    w.put((1 << u) - 1, u)
    w.put(0, 1)
    w.put(v, b)


def get_subexp(r: BitReader, offset: int, k: int) -> int:
    u = r.run(1)
    return (r.get(k) if u == 0 else 1 << u + k - 1 | r.get(u + k - 1)) - offset


def put_golomb(w: BitWriter, v: int, offset: int, m: int, run: int = 1) -> None:
    """Quotient in runs of the bit run, then the remainder in truncated form."""
    q, rest = divmod(v + offset, m)
    width = m.bit_length()
    spare = (1 << width) - m
    w.put(((1 << q) - 1) * run, q)
    w.put(1 - run, 1)
    if rest < spare:
        w.put(rest, width - 1)
    else:
        w.put(rest + spare, width)


def get_golomb(r: BitReader, offset: int, m: int, run: int = 1) -> int:
    q, width = r.run(run), m.bit_length()
    rest, spare = r.get(width - 1), (1 << width) - m
    if rest >= spare:
        rest = (rest << 1 | r.bit()) - spare
    return q * m + rest - offset


def put_golomb_rice(w: BitWriter, v: int, offset: int, log2m: int) -> None:
    w.put(0, (v + offset) >> log2m)
    w.put(1, 1)
    w.put(v + offset, log2m)


def get_golomb_rice(r: BitReader, offset: int, log2m: int) -> int:
    return (r.run(0) << log2m | r.get(log2m)) - offset


def golomb_rice_block(values: np.ndarray, offset: int, log2m: int) -> bytes:
    """Many non-negative values (less the offset) one after another, as put_golomb_rice writes them."""
    v = np.asarray(values, dtype=np.int64) + offset
    zeros = v >> log2m
    one = np.cumsum(zeros + 1 + log2m) - 1 - log2m
    bits = np.zeros(int(one[-1]) + 1 + log2m if len(v) else 0, dtype=np.uint8)
    bits[one] = 1
    for i in range(log2m):
        bits[one + 1 + i] = v >> log2m - 1 - i & 1
    return np.packbits(bits).tobytes()


def golomb_rice_values(data: bytes, n: int, offset: int, log2m: int, leap: int = 2) -> np.ndarray:
    """The first n values of a block of golomb_rice_block; EOFError if it holds fewer.

    A code ends with the remainder behind its first 1. Which 1 is the next code's follows from how
    many lie in the remainder: it is known for every 1 at once, then for 2**leap codes further
    on, so that few steps are left to be made one by one.
    """
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    ones = np.flatnonzero(bits).astype(np.int32)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.append(bits, np.zeros(log2m + 1, dtype=np.uint8))
    rest = np.zeros(len(ones), dtype=np.int32)
    follow = np.arange(1, len(ones) + 1, dtype=np.int32)
    for i in range(1, log2m + 1):
        bit = padded[ones + i]
        rest = rest << 1 | bit
        follow += bit
    last = len(ones)
    follow = np.append(np.minimum(follow, last), last)
    far = follow
    for _ in range(leap):
        far = far[far]
    codes = np.empty((-(-n >> leap), 1 << leap), dtype=np.int32)
    step, at, starts = memoryview(far), 0, []
    for _ in range(len(codes)):
        starts.append(at)
        at = step[at]
    codes[:, 0] = starts
    for i in range(1, 1 << leap):
        codes[:, i] = follow[codes[:, i - 1]]
    codes = codes.ravel()[:n]
    if codes[-1] >= last or ones[codes[-1]] + log2m >= len(bits):
        raise EOFError
    one = ones[codes]
    zeros = np.diff(one, prepend=-1 - log2m) - 1 - log2m
    return (zeros.astype(np.int64) << log2m | rest[codes]) - offset


def canonical(values: list[int], lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: value -> (code, length), shorter first, then by value."""
    code = last = 0
    out = {}
    for n, v in sorted(zip(lengths, values, strict=True)):
        code <<= n - last
        out[v] = (code, n)
        code, last = code + 1, n
    return out


def _huffman(values: list[int], lengths: list[int]) -> Callable[[BitReader], int]:
    if lengths == [0]:
        return lambda r: values[0]
    table = {(n, c): v for v, (c, n) in canonical(values, lengths).items()}

    def get(r: BitReader) -> int:
        code = n = 0
        while (n, code) not in table:
            code, n = code << 1 | r.bit(), n + 1
            if n > 64:
                raise ValueError("no such code")
        return table[n, code]

    return get


def reader(encoding: int, params: bytes, core: BitReader, external: dict[int, Bytes], kind: str) -> Callable[[], int | bytes]:
    """What reads the next value of a series; kind is byte, int or array."""
    p = Bytes(params)
    if encoding == NULL:
        return lambda: b"" if kind == "array" else 0
    if encoding == EXTERNAL:
        source = external.get(p.itf8(), Bytes(b""))
        return source.byte if kind == "byte" else source.itf8
    if encoding == HUFFMAN:
        get = _huffman(p.array(), p.array())
        return lambda: get(core)
    if encoding == ARRAY_STOP:
        stop, source = p.byte(), external.get(p.itf8(), Bytes(b""))
        return lambda: source.until(stop)
    if encoding == ARRAY_LEN:
        length = reader(p.byte(), p.take(p.itf8()), core, external, "int")
        inner, inner_params = p.byte(), p.take(p.itf8())
        if inner == EXTERNAL:
            source = external.get(Bytes(inner_params).itf8(), Bytes(b""))
            return lambda: source.take(length())
        one = reader(inner, inner_params, core, external, "byte")
        return lambda: bytes(one() for _ in range(length()))
    offset = p.itf8()
    if encoding == GAMMA:
        return lambda: get_gamma(core, offset)
    n = p.itf8()
    get = {BETA: lambda: core.get(n) - offset, SUBEXP: lambda: get_subexp(core, offset, n), GOLOMB: lambda: get_golomb(core, offset, n), GOLOMB_RICE: lambda: get_golomb_rice(core, offset, n)}
    return get[encoding]

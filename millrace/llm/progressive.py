"""Media columns as progressive JPEG: text bytes in coefficients, and RGB tensors out of them.

The unit of storage is the quantised coefficient. A byte b becomes the coefficient b (from 128 on) or
b - 255 (below), so each is non-zero and of one size class, and a file of 8-bit 4:2:0 blocks with unit
quantisation holds 64 bytes a block without loss. Scans, one component each: DC with successive
approximation 1, AC 1-5 and 6-63 likewise, then the refinement bits of both. The payload's length is in a
comment segment; blocks that complete the last row hold byte 255.

``decode`` accumulates any progressive scans (spectral selection, successive approximation, restart
intervals, interleaved DC) into coefficient arrays. Scans whose symbols turn out to be all alike, as those
written here, are read as bit matrices in numpy; all others symbol by symbol. ``tensor`` inverse-transforms
the blocks with an exact integer-valued matrix product, so equal files give equal pixels on any machine,
replicates chroma and converts to full-resolution RGB.

Edge cases
* null and empty texts: one unit of 576 bytes of 255.
* a text of exactly a multiple of 576 bytes gets no padding; long texts become one large image.
* equal texts give equal files; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words

UNIT = 576
COMPONENTS = ((1, 2, 2), (2, 1, 1), (3, 1, 1))  # id, horizontal and vertical sampling
BANDS = ((1, 5), (6, 63))
WIDEST = 4095  # units of 16 pixels in one direction
RUN = 32767  # the longest run of ended bands


@functools.cache
def zigzag() -> np.ndarray:
    """Natural place (8 * row + column) of each coefficient in zigzag order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def shape_of(n_blocks: int) -> tuple[int, int]:
    """Columns and rows of 16-pixel units that hold the blocks, six a unit."""
    units = -(-n_blocks // 6)
    across = min(WIDEST, max(1, math.isqrt(max(units - 1, 0)) + 1))
    return across, -(-units // across)


# ---- writing ---------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, slot: int, length: int, symbols: list[int]) -> bytes:
    """A table whose codes all have one length."""
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4 | slot, *counts, *symbols]))


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits padded with ones to bytes, and a zero byte after each 255."""
    packed = np.packbits(bits)
    if len(packed):
        packed[-1] |= (1 << -len(bits) % 8) - 1
    return packed.tobytes().replace(b"\xff", b"\xff\x00")


def _scan(component: int, slots: int, ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    return _segment(0xDA, bytes([1, component, slots, ss, se, ah << 4 | al])) + data


@functools.cache
def _differences() -> tuple[np.ndarray, np.ndarray]:
    """The code and extra bits of DC differences -255 to 255, at 255 more, and which of the twelve places they take."""
    bits, taken = np.zeros((511, 12), np.uint8), np.zeros((511, 12), bool)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        value = size << size | (d if d >= 0 else d + (1 << size) - 1)
        bits[d + 255, : size + 4] = [value >> k & 1 for k in range(size + 3, -1, -1)]
        taken[d + 255, : size + 4] = True
    return bits, taken


@functools.cache
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Half the coefficient of each byte, and its refinement bit: two's complement, b - 255 is odd where b is even."""
    b = np.arange(256)
    return np.where(b >= 128, b, b - 255) >> 1, np.where(b >= 128, b & 1, 1 - (b & 1)).astype(np.uint8)


@functools.cache
def _tables() -> bytes:
    return b"".join([_dht(0, 0, 4, list(range(12))), _dht(1, 0, 1, [0x07]), _dht(1, 1, 4, [n << 4 for n in range(15)])])


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the bytes of ``payload`` (a multiple of 64)."""
    n_blocks = len(payload) // 64
    across, down = shape_of(n_blocks)
    total = across * down
    raw = np.full(total * 6 * 64, 255, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(-1, 64)
    (halves, fixes), (bits, taken) = _coefficients(), _differences()
    parts_of = lambda x: (x[: 4 * total], x[4 * total : 5 * total], x[5 * total :])
    first, half, fix = parts_of(raw >> 1), parts_of(halves[raw[:, 0]]), parts_of(fixes[raw])
    out = [
        b"\xff\xd8",
        _segment(0xFE, struct.pack(">Q", len(payload))),
        _segment(0xDB, bytes([0]) + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in COMPONENTS)),
        _tables(),
    ]
    for (ident, _, _), dc in zip(COMPONENTS, half, strict=True):
        diff = dc + 255
        diff[1:] -= dc[:-1]
        out.append(_scan(ident, 0x00, 0, 0, 0, 1, _stuffed(bits[diff][taken[diff]])))
    for (ident, _, _), plane in zip(COMPONENTS, first, strict=True):
        for ss, se in BANDS:
            # One code bit 0 and seven bits of magnitude and sign: exactly a byte, never 255.
            out.append(_scan(ident, 0x00, ss, se, 0, 1, plane[:, ss : se + 1].tobytes()))
    for (ident, _, _), plane in zip(COMPONENTS, fix, strict=True):
        out.append(_scan(ident, 0x00, 0, 0, 1, 0, _stuffed(plane[:, 0])))
        parts = []
        for s in range(0, len(plane), RUN):
            run = plane[s : s + RUN, 1:]
            n = len(run).bit_length() - 1
            head = n << n | len(run) - (1 << n)
            parts += [np.array([head >> k & 1 for k in range(n + 3, -1, -1)], np.uint8), run.ravel()]
        out.append(_scan(ident, 0x01, 1, 63, 1, 0, _stuffed(np.concatenate(parts))))
    return b"".join([*out, b"\xff\xd9"])


# ---- reading ---------------------------------------------------------------------------------------


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks a row that scans of this component alone have
    high: int = 0
    stride: int = 0  # blocks a row with the filling of interleaved scans
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    height: int = 0
    width: int = 0
    payload_bytes: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)


class _Bits:
    """Bits of one stretch of entropy-coded data, one after another."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def one(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.one()
        return v

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (found := table.get((length, code))) is not None:
                return found
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if size and v >> (size - 1) else v - (1 << size) + 1


@functools.lru_cache(maxsize=64)
def _codes(body: bytes) -> list[tuple[int, dict[tuple[int, int], int]]]:
    at, out = 0, []
    while at < len(body):
        slot, counts = body[at], body[at + 1 : at + 17]
        at += 17
        code, table = 0, {}
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                table[length, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        out.append((slot, table))
    return out


#: What ends a scan: neither a stuffed byte nor a restart.
_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.DOTALL)


def decode(data: bytes, fast: bool = True) -> Image:
    """All scans of a progressive JPEG, accumulated into coefficient arrays in zigzag order."""
    image, tables, restart, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE and len(body) == 8:
            image.payload_bytes = struct.unpack(">Q", body)[0]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                image.quant[body[0] & 15] = np.frombuffer(body[1 : n + 1], ">u2" if wide else "u1").astype(np.int64)
                body = body[n + 1 :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
            for c in image.components:
                c.wide, c.high = -(-(-(-image.width * c.h // hm)) // 8), -(-(-(-image.height * c.v // vm)) // 8)
                c.stride = -(-image.width // (8 * hm)) * c.h
                c.coef = np.zeros((c.stride * -(-image.height // (8 * vm)) * c.v, 64), np.int32)
        elif marker == 0xC4:
            tables.update(_codes(body))
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if (found := _MARKER.search(data, at)) is None:
                raise ValueError("a scan without end")
            end = found.start()
            _read_scan(image, body, data[at:end], tables, restart, fast)
            at = end
        elif marker in (0xC0, 0xC1, 0xC3):
            raise ValueError("only progressive files are read here")


def _read_scan(image: Image, head: bytes, data: bytes, tables: dict, restart: int, fast: bool) -> None:
    n = head[0]
    chosen = [(next(c for c in image.components if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    ss, se, ah, al = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    if fast and n == 1 and not restart:
        comp, slots = chosen[0]
        if comp.stride == comp.wide and comp.coef.shape[0] == comp.wide * comp.high:
            whole = data.replace(b"\xff\x00", b"\xff")
            if _fast_scan(comp, slots, ss, se, ah, al, whole, tables):
                return
    parts, start = [], 0
    if restart:
        i = 0
        while (i := data.find(b"\xff", i)) >= 0:
            if data[i + 1]:
                parts.append(data[start:i])
                start = i + 2
            i += 2
    parts.append(data[start:])
    if n == 1:
        comp = chosen[0][0]
        order = [[(0, r * comp.stride + c)] for r in range(comp.high) for c in range(comp.wide)]
    else:
        across = chosen[0][0].stride // chosen[0][0].h
        rows = len(chosen[0][0].coef) // chosen[0][0].stride // chosen[0][0].v
        order = [[(k, (r * c.v + y) * c.stride + u * c.h + x) for k, (c, _) in enumerate(chosen) for y in range(c.v) for x in range(c.h)] for r in range(rows) for u in range(across)]
    for p, part in enumerate(parts):
        bits, last, run = _Bits(part.replace(b"\xff\x00", b"\xff")), [0] * n, 0
        for unit in order[p * restart : (p + 1) * restart] if restart else order:
            for k, block in unit:
                comp, slots = chosen[k]
                run = _slow_block(comp.coef[block], bits, tables, slots, ss, se, ah, al, last, k, run)


def _slow_block(c: np.ndarray, bits: _Bits, tables: dict, slots: int, ss: int, se: int, ah: int, al: int, last: list[int], k: int, run: int) -> int:
    """One block of one scan; returns how many more blocks have ended bands."""
    if ss == 0:
        if ah:
            c[0] |= bits.one() << al
        else:
            last[k] += bits.signed(bits.symbol(tables[slots >> 4]))
            c[0] = last[k] << al
        return 0
    table = tables[16 | slots & 15]
    at = ss
    if not ah:
        if run:
            return run - 1
        while at <= se:
            zeros, size = divmod(bits.symbol(table), 16)
            if size:
                at += zeros
                c[at] = bits.signed(size) * (1 << al)
                at += 1
            elif zeros == 15:
                at += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    def refine(i: int) -> None:
        if bits.one() and not abs(int(c[i])) >> al & 1:
            c[i] += (1 << al) if c[i] > 0 else -(1 << al)

    if not run:
        while at <= se:
            zeros, size = divmod(bits.symbol(table), 16)
            value = 0
            if size:
                value = (1 << al) if bits.one() else -(1 << al)
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while at <= se:
                if c[at]:
                    refine(at)
                elif zeros:
                    zeros -= 1
                else:
                    break
                at += 1
            if value and at <= se:
                c[at] = value
            at += 1
    if run:
        for i in range(at, se + 1):
            if c[i]:
                refine(i)
        return run - 1
    return 0


def _fast_scan(comp: Component, slots: int, ss: int, se: int, ah: int, al: int, data: bytes, tables: dict) -> bool:
    """Read a scan of one component whose symbols are all alike; False, with nothing changed, if they are not."""
    blocks, band = len(comp.coef), se - ss + 1
    stream = np.frombuffer(data, np.uint8)
    if ss == 0 and ah:
        bits = np.unpackbits(stream)[:blocks]
        if len(bits) < blocks:
            return False
        comp.coef[:, 0] |= bits.astype(np.int32) << al
        return True
    if ss == 0:
        table = tables[slots >> 4]
        if {length for length, _ in table} != {4} or any(s > 16 for s in table.values()):
            return False
        size_of = np.array([table.get((4, c), 0) for c in range(16)])
        padded = np.concatenate([stream, np.full(8, 255, np.uint8)])
        bits = np.unpackbits(padded)[: 8 * len(stream) + 4]
        step = (size_of + 4)[bits[:-3] << 3 | bits[1:-2] << 2 | bits[2:-1] << 1 | bits[3:]].tolist()
        at, starts = 0, []
        for _ in range(blocks):
            if at >= len(step):
                return False
            starts.append(at)
            at += step[at]
        starts = np.array(starts)
        # Four bytes hold a code and its extra bits wherever they start: 7 + 4 + 16 bits at most.
        byte, wide = starts >> 3, padded.astype(np.int64)
        four = wide[byte] << 24 | wide[byte + 1] << 16 | wide[byte + 2] << 8 | wide[byte + 3]
        size = size_of[four >> 28 - (starts & 7) & 15]
        value = four >> 28 - (starts & 7) - size & (1 << size) - 1
        diff = np.where((size > 0) & (value >> np.maximum(size - 1, 0) == 0), value - (1 << size) + 1, value)
        comp.coef[:, 0] = np.cumsum(diff) << al
        return True
    table = tables[16 | slots & 15]
    if not ah:
        # A one-bit code for "no zeros, then a value of seven bits": one byte a coefficient.
        if table != {(1, 0): 0x07} or len(stream) != blocks * band or stream.max(initial=0) > 127:
            return False
        v = np.arange(128, dtype=np.int32)
        comp.coef[:, ss : se + 1] = (np.where(v >= 64, v, v - 127) * (1 << al))[stream.reshape(blocks, band)]
        return True
    if {length for length, _ in table} != {4} or not comp.coef[:, ss : se + 1].all():
        return False
    bits, at, done, parts = np.unpackbits(stream), 0, 0, []
    while done < blocks:
        symbol = table.get((4, int(np.packbits(bits[at : at + 4])[0]) >> 4), 1) if at + 4 <= len(bits) else 1
        n = symbol >> 4
        if symbol & 15 or n == 15:
            return False
        run = (1 << n) + int("".join(map(str, bits[at + 4 : at + 4 + n])) or "0", 2)
        at += 4 + n
        parts.append(bits[at : at + run * band])
        at, done = at + run * band, done + run
    fix = np.concatenate(parts)
    if done != blocks or len(fix) != blocks * band:
        return False
    c = comp.coef[:, ss : se + 1]
    fix = fix.reshape(blocks, band).astype(np.int32) << al
    c += np.where(c > 0, fix, -fix)
    return True


def payload_of(image: Image) -> bytes:
    """The stored bytes: each coefficient's low eight bits, less one for negative ones."""
    c = np.concatenate([x.coef for x in image.components])[: image.payload_bytes // 64]
    return np.where(c > 0, c, c + 255).astype(np.uint8).tobytes()


@functools.cache
def _inverse() -> np.ndarray:
    """Zigzag coefficients to pixels, in units of 2 ** -20; whole numbers, so that products are exact."""
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, math.sqrt(0.5), 1.0)[:, None] / 2
    return np.rint(np.kron(basis, basis)[zigzag()] * (1 << 20))


def _plane(image: Image, comp: Component) -> np.ndarray:
    """The component's samples, as its blocks lie, 0 to 255."""
    rows = len(comp.coef) // comp.stride
    out = np.empty((len(comp.coef), 64), np.uint8)
    for s in range(0, len(comp.coef), 1 << 14):
        c = comp.coef[s : s + (1 << 14)] * image.quant[comp.quant]
        x = c.astype(float) @ _inverse()
        x += 1 << 19
        x *= 2.0**-20
        np.floor(x, out=x)
        x += 128
        out[s : s + len(c)] = np.clip(x, 0, 255, out=x)
    return out.reshape(rows, comp.stride, 8, 8).swapaxes(1, 2).reshape(rows * 8, comp.stride * 8)


@functools.cache
def _chroma() -> tuple[np.ndarray, ...]:
    """What a chroma sample adds: red by Cr, green by Cb and by Cr (2 ** -16), blue by Cb."""
    x = np.arange(256, dtype=np.int64) - 128
    whole = lambda f: ((round(f * 65536) * x + 32768) >> 16).astype(np.int16)
    return whole(1.402), -round(0.344136 * 65536) * x, -round(0.714136 * 65536) * x, whole(1.772)


def tensor(image: Image) -> np.ndarray:
    """Height x width x 3, RGB, 8 bits, chroma at full resolution."""
    y, cb, cr = (_plane(image, c) for c in image.components)
    red, green_b, green_r, blue = _chroma()
    green = ((green_b[cb] + green_r[cr] + 32768) >> 16).astype(np.int16)
    tall, wide = len(y) // len(cb), y.shape[1] // cb.shape[1]
    out = np.empty((image.height, image.width, 3), np.uint8)
    for channel, add in enumerate((red[cr], green, blue[cb])):
        full = y.reshape(len(cb), tall, cb.shape[1], wide) + add[:, None, :, None]
        out[:, :, channel] = np.clip(full, 0, 255).reshape(y.shape)[: image.height, : image.width]
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and CRC-32 of the tensor."""
    n = rgb.shape[0] * rgb.shape[1]
    means = [int(s) * 1000 // n for s in rgb.sum((0, 1), dtype=np.int64)]
    return f"{rgb.shape[0]}x{rgb.shape[1]}x3:{','.join(map(str, means))}:{zlib.crc32(rgb.tobytes()):08x}"


# ---- tables ----------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes of its UTF-8, and ``media``, its JPEG file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in words.text_batches(batches):
            media = [encode(pad(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame, tensors: bool = True) -> DataFrame:
    """``media`` with payload, height, width and (unless left out) the RGB tensor's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in words.text_batches(batches, "media"):
            images = [decode(f) for f in files]
            columns = [pa.array([payload_of(i) for i in images], pa.binary()), pa.array([i.height for i in images], pa.int32()), pa.array([i.width for i in images], pa.int32())]
            if tensors:
                columns.append(pa.array([tensor(i).tobytes() for i in images], pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "payload", "height", "width", "tensor"][: 1 + len(columns)])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, payload binary, height int, width int" + ", tensor binary" * tensors)


def digests(media: DataFrame) -> DataFrame:
    """Per stored file: what is read back from it, as digests."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in words.text_batches(batches, "media"):
            rows = []
            for f in files:
                image = decode(f)
                payload = payload_of(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature(tensor(image))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=names)

    return media.mapInArrow(run, schema)

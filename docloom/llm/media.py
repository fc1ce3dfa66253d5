"""Media columns: progressive JPEG, written and read with numpy.

Reading accumulates the scans of a progressive JPEG (spectral selection and successive approximation) into arrays of
quantised coefficients, transforms them back with one matrix product, upsamples chroma and gives full-resolution RGB.
Writing stores a payload without loss in the format's own unit, the quantised coefficient: 64 bytes are a block in
zigzag order, six blocks (four of luma, one each of chroma) a unit of a 4:2:0 image.  Bytes are shifted to 256..511 in
AC places, so every one has the same size category, and runs of them can be decoded without a loop; the decoder checks
that before it relies on it, and otherwise goes symbol by symbol.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A payload is padded to a positive multiple of so many bytes, with this one.
UNIT, PAD = 192, b" "
#: Added to a byte in an AC place.
SHIFT = 256
#: Most units of 16 pixels a side of a JPEG can have.
MOST_SIDE = 4095

# Fixed values of the JPEG standard: the zigzag order of an 8x8 block, as row * 8 + column.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))

_FREQ = np.arange(8)
_COS = np.cos((2 * _FREQ[None, :] + 1) * _FREQ[:, None] * math.pi / 16) * np.where(_FREQ == 0, math.sqrt(1 / 8), 0.5)[:, None]
#: Coefficients in zigzag order, times this, are samples in row order.
BASIS = np.einsum("ux,vy->uvxy", _COS, _COS).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, lengths: list[int], symbols: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, *lengths, *symbols]))


def _lengths(**counts: int) -> list[int]:
    return [counts.get(f"l{i}", 0) for i in range(1, 17)]


# DC categories 0 to 11 and end-of-band runs have codes of four bits, the one AC category a single bit.
_DC_BITS, _EOB_BITS = 4, 4
_HEAD = _segment(0xDB, bytes([0] + [1] * 64)) + _table(0, 0, _lengths(l4=12), list(range(12))) + _table(1, 0, _lengths(l1=1), [0x08]) + _table(1, 1, _lengths(l4=15), [r << 4 for r in range(15)])
_BANDS = ((1, 5), (6, 63))


def _stuffed(bits: np.ndarray) -> bytes:
    """Entropy-coded bytes of bits: filled up with ones, a zero byte after each 0xFF."""
    extra = -len(bits) % 8
    if extra:
        bits = np.concatenate([bits, np.ones(extra, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], ac: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    body = bytes([len(components)]) + b"".join(bytes([c, ac]) for c in components) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, body) + data


def _binary(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, highest first."""
    return ((values[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8)


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG that holds the payload (of whole blocks) in its coefficients."""
    blocks = len(payload) // 64
    units = -(-blocks // 6)
    columns = min(MOST_SIDE, math.isqrt(units - 1) + 1)
    rows = -(-units // columns)
    if rows > MOST_SIDE:
        raise ValueError("the payload is too long for one image")
    held = np.zeros((rows * columns * 6, 64), np.uint8)
    held[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    grid = held.reshape(rows, columns, 6, 64)
    luma = grid[:, :, :4].reshape(rows, columns, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    parts = [luma, grid[:, :, 4].reshape(-1, 64), grid[:, :, 5].reshape(-1, 64)]
    # DC: halves first, as differences within each component
    half = (grid[..., 0] >> 1).astype(np.int16)
    order = np.arange(half.size).reshape(half.shape)
    diff = np.zeros(half.size, np.int16)
    for own in (order[:, :, :4].ravel(), order[:, :, 4].ravel(), order[:, :, 5].ravel()):
        diff[own] = np.diff(half.ravel()[own], prepend=np.int16(0))
    size = np.frexp(np.abs(diff))[1]
    value = np.where(diff < 0, diff + (1 << size) - 1, diff)
    code = (size.astype(np.int32) << 8) | (value << (8 - size))  # category in four bits, then its bits from the left
    bits = _binary(code, 12)
    dc = bits[np.arange(12)[None, :] < (_DC_BITS + size)[:, None]]
    sof = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _HEAD, _segment(0xC2, sof), _scan([1, 2, 3], 0, 0, 0, 0, 1, _stuffed(dc))]
    for c, part in enumerate(parts, 1):
        for first, last in _BANDS:
            top = (part[:, first : last + 1] >> 1) | 0x80  # half of byte + 256
            nine = np.zeros((top.size, 9), np.uint8)
            nine[:, 1:] = np.unpackbits(top.reshape(-1, 1), axis=1)
            out.append(_scan([c], 0, first, last, 0, 1, _stuffed(nine.ravel())))
    out.append(_scan([1, 2, 3], 0, 0, 0, 1, 0, _stuffed(grid[..., 0].ravel() & 1)))
    for c, part in enumerate(parts, 1):
        low, bits = part[:, 1:] & 1, []
        for at in range(0, len(part), 0x7FFF):
            run = low[at : at + 0x7FFF]
            r = len(run).bit_length() - 1
            bits += [_binary(np.array([r]), _EOB_BITS)[0], _binary(np.array([len(run) - (1 << r)]), r)[0] if r else np.zeros(0, np.uint8), run.ravel()]
        out.append(_scan([c], 1, 1, 63, 1, 0, _stuffed(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


@dataclass
class Component:
    """Sampling factors, quantisation table slot, and coefficients (block rows, block columns, 64 in zigzag order)."""

    h: int
    v: int
    q: int
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))
    high: int = 0  # block rows and columns that the image really has
    wide: int = 0


@dataclass
class Image:
    width: int
    height: int
    components: dict[int, Component]
    tables: dict[int, np.ndarray]
    comment: bytes = b""


class _Codes:
    """A Huffman table: length and symbol of the code at the head of any 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.length, self.symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = at = 0
        for bits, count in enumerate(counts, 1):
            for _ in range(count):
                low = code << (16 - bits)
                self.length[low : low + (1 << (16 - bits))] = bits
                self.symbol[low : low + (1 << (16 - bits))] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1


_CODES: dict[bytes, _Codes] = {}


class _Bits:
    """The bits of a scan, read in order."""

    def __init__(self, data: bytes):
        self.all = np.unpackbits(np.frombuffer(data + b"\xff" * 4, np.uint8))
        self.data, self.at = data + b"\xff" * 4, 0

    def peek(self) -> int:
        i, o = self.at >> 3, self.at & 7
        return (int.from_bytes(self.data[i : i + 3], "big") >> (8 - o)) & 0xFFFF

    def symbol(self, codes: _Codes) -> int:
        head = self.peek()
        n = int(codes.length[head])
        if not n:
            raise ValueError("a code that its table does not have")
        self.at += n
        return int(codes.symbol[head])

    def take(self, n: int) -> int:
        value = self.peek() >> (16 - n)  # 16 at most
        self.at += n
        return value

    def many(self, n: int) -> np.ndarray:
        self.at += n
        if self.at > len(self.all):
            raise ValueError("the scan ends too early")
        return self.all[self.at - n : self.at]


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc_first(bits: _Bits, order: list[tuple[Component, int, int, int]], codes: list[_Codes], low: int) -> None:
    last = [0] * len(codes)
    for component, which, row, column in order:
        size = bits.symbol(codes[which])
        last[which] += _signed(bits.take(size), size)
        component.coefficients[row, column, 0] = last[which] << low


def _ac_first(bits: _Bits, part: np.ndarray, codes: _Codes, first: int, last: int, low: int) -> None:
    blocks, width = part.shape[0], last - first + 1
    head = bits.peek()
    n, symbol = int(codes.length[head]), int(codes.symbol[head])
    size = symbol & 15
    step = n + size
    if n and symbol >> 4 == 0 and 0 < size <= 8 and bits.at + blocks * width * step <= len(bits.all):
        grid = bits.all[bits.at : bits.at + blocks * width * step].reshape(-1, step)
        if (grid[:, :n] == grid[0, :n]).all():  # all coefficients have this one code: no loop is needed
            value = (np.packbits(grid[:, n:], axis=1)[:, 0] >> (8 - size)).astype(np.int16)
            value = np.where(grid[:, n] == 1, value, value - (1 << size) + 1)
            part[:, first : last + 1] = (value << low).reshape(blocks, width)
            bits.at += blocks * width * step
            return
    run = 0
    for block in part:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                block[k] = _signed(bits.take(size), size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _corrected(bits: _Bits, band: np.ndarray, bit: int) -> None:
    """One more bit for each coefficient of ``band`` that is not zero."""
    at = np.nonzero(band)
    more = bits.many(len(at[0])) * np.int16(bit)
    band[at] += np.where(band[at] > 0, more, -more)


def _ac_refine(bits: _Bits, part: np.ndarray, codes: _Codes, first: int, last: int, low: int) -> None:
    bit, at = 1 << low, 0
    while at < len(part):
        block, k = part[at], first
        while k <= last:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:  # the rest of this block and whole blocks after it
                run = (1 << zeros) + bits.take(zeros)
                _corrected(bits, part[at : at + 1, k : last + 1], bit)
                if run > 1:
                    _corrected(bits, part[at + 1 : at + run, first : last + 1], bit)
                at += run - 1
                break
            new = (bit if bits.take(1) else -bit) if size else 0
            while k <= last:
                if block[k]:
                    if bits.take(1):
                        block[k] += bit if block[k] > 0 else -bit
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        block[k] = new
                    k += 1
                    break
                k += 1
        at += 1


def decode(jpeg: bytes) -> Image:
    """The coefficients of a progressive JPEG of eight bits a sample, without restart intervals."""
    image = Image(0, 0, {}, {})
    codes: dict[int, _Codes] = {}
    at = 2
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.tables[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if body[: 17 + n] not in _CODES:
                    _CODES[body[: 17 + n]] = _Codes(body[1:17], body[17 : 17 + n])
                codes[body[0]] = _CODES[body[: 17 + n]]
                body = body[17 + n :]
        elif marker == 0xC2:
            image.height, image.width, n = struct.unpack_from(">HHB", body, 1)
            for i in range(n):
                name, hv, q = body[6 + 3 * i : 9 + 3 * i]
                image.components[name] = Component(hv >> 4, hv & 15, q)
            most_h, most_v = (max(getattr(c, s) for c in image.components.values()) for s in "hv")
            for c in image.components.values():
                c.high, c.wide = -(-image.height * c.v // (8 * most_v)), -(-image.width * c.h // (8 * most_h))
                c.coefficients = np.zeros((-(-image.height // (8 * most_v)) * c.v, -(-image.width // (8 * most_h)) * c.h, 64), np.int16)
        elif marker == 0xDA:
            end = at
            while True:
                end = jpeg.index(b"\xff", end)
                if jpeg[end + 1]:
                    break
                end += 2
            bits = _Bits(jpeg[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
            n = body[0]
            named = [(image.components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
            first, last, approximation = body[1 + 2 * n : 4 + 2 * n]
            _read_scan(image, bits, named, codes, first, last, approximation >> 4, approximation & 15)
        elif marker in (0xDD, 0xC0, 0xC1):
            raise ValueError("restart intervals and sequential images are not read")
        if jpeg[at : at + 2] == b"\xff\xd9":
            break
    return image


def _read_scan(image: Image, bits: _Bits, named: list[tuple[Component, int]], codes: dict[int, _Codes], first: int, last: int, high: int, low: int) -> None:
    if first == 0:
        if len(named) == 1:
            c = named[0][0]
            rows, columns = np.divmod(np.arange(c.high * c.wide), c.wide)
            order = [(c, 0, rows, columns)]
            steps = [(c, 0, int(r), int(k)) for r, k in zip(rows, columns, strict=True)] if not high else []
        else:
            h, v = named[0][0].h, named[0][0].v
            down, across = named[0][0].coefficients.shape[0] // v, named[0][0].coefficients.shape[1] // h
            steps = []
            for r in range(down):
                for k in range(across):
                    for which, (c, _) in enumerate(named):
                        steps += [(c, which, r * c.v + i, k * c.h + j) for i in range(c.v) for j in range(c.h)]
        if not high:
            _dc_first(bits, steps, [codes[t >> 4] for _, t in named], low)
        elif len(named) == 1:
            c, _, rows, columns = order[0]
            c.coefficients[rows, columns, 0] |= bits.many(len(rows)).astype(np.int16) << low
        else:
            each = [c.h * c.v for c, _ in named]
            grid = bits.many(down * across * sum(each)).astype(np.int16).reshape(down, across, -1) << low
            start = 0
            for (c, _), n in zip(named, each, strict=True):
                part = grid[:, :, start : start + n].reshape(down, across, c.v, c.h).transpose(0, 2, 1, 3)
                c.coefficients[..., 0] |= part.reshape(c.coefficients.shape[:2])
                start += n
        return
    c, t = named[0]
    part = c.coefficients[: c.high, : c.wide].reshape(-1, 64).copy()
    (_ac_refine if high else _ac_first)(bits, part, codes[0x10 | (t & 15)], first, last, low)
    c.coefficients[: c.high, : c.wide] = part.reshape(c.high, c.wide, 64)


def samples(component: Component, table: np.ndarray) -> np.ndarray:
    """A component's samples: dequantised, transformed back, shifted and clipped."""
    rows, columns, _ = component.coefficients.shape
    flat = (component.coefficients.reshape(-1, 64) * table) @ BASIS + 128
    return np.clip(flat, 0, 255).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)


def rgb(image: Image) -> np.ndarray:
    """The image as (height, width, 3) bytes; chroma samples are repeated to full resolution."""
    most_h, most_v = (max(getattr(c, s) for c in image.components.values()) for s in "hv")
    planes = []
    for c in image.components.values():
        plane = samples(c, image.tables[c.q])
        if most_v > c.v:
            plane = np.repeat(plane, most_v // c.v, 0)
        if most_h > c.h:
            plane = np.repeat(plane, most_h // c.h, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.empty((*y.shape, 3), np.float32)
    # The colour transform of JPEG files.
    out[..., 0] = y + 1.402 * cr
    out[..., 1] = y - 0.344136 * cb - 0.714136 * cr
    out[..., 2] = y + 1.772 * cb
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def payload_of(image: Image) -> bytes:
    """The payload that :func:`encode` stored."""
    a, b, c = image.components.values()
    rows, columns = b.coefficients.shape[:2]
    luma = a.coefficients.reshape(rows, 2, columns, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, columns, 4, 64)
    units = np.concatenate([luma, b.coefficients[:, :, None], c.coefficients[:, :, None]], axis=2).reshape(-1, 64)
    units[:, 1:] -= SHIFT
    return units.astype(np.uint8).tobytes()[: int(image.comment.split()[1])]


def padded(text: bytes) -> bytes:
    """The text, filled up to a positive multiple of UNIT bytes."""
    return text + PAD * (-len(text) % UNIT if text else UNIT)


def features(tensor: np.ndarray) -> str:
    """Size, mean and deviation of each channel, and mean steps across and down, as text."""
    small = tensor.astype(np.float32)
    mean, spread = small.mean((0, 1)), small.std((0, 1))
    across, down = np.abs(np.diff(small, axis=1)).mean(), np.abs(np.diff(small, axis=0)).mean()
    return f"{tensor.shape[1]}x{tensor.shape[0]};" + ",".join(f"{x:.2f}" for x in (*mean, *spread, across, down))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tensors: bool = False) -> DataFrame:
    """Each row's text as a progressive JPEG, read back: ``doc_id``, digests of payload and file, and ``feature``.

    A null text is an empty one.  Payload digests are of what was read back from the file's bytes.  With ``tensors``
    there are also ``media`` (the file), ``height``, ``width`` and ``rgb`` (height * width * 3 bytes).  Equal texts have
    equal values; other columns are ignored; an empty table gives an empty result; a text too long for one image (12 GB) is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    text = text or b""
                    stored = encode(padded(text))
                    image = decode(stored)
                    read, tensor = payload_of(image), rgb(image)
                    row = [len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(tensor)]
                    rows.append(row + [stored, tensor.shape[0], tensor.shape[1], tensor.tobytes()] * tensors)
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if tensors:
        names += ["media", "height", "width", "rgb"]
        kinds += [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        schema += ", media binary, height int, width int, rgb binary"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

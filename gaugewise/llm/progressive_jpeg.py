"""Progressive JPEG media columns: scans accumulate into coefficient arrays, numpy turns these into full-resolution RGB.

Entropy-coded segments (what lies between restart markers, of all images of a batch) are decoded side by side: each is
a lane, and one numpy step takes the next symbol of every lane. Any Huffman tables, scan scripts, restart intervals and
sampling factors do; images of one script are decoded together.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugewise.llm.common import id_and_text, passes, schema_of, text_bytes

#: A payload is a multiple of so many bytes: three blocks of 64 coefficients.
UNIT = 192
#: A stored image has chroma of half the width: a unit of its scans (MCU) is two blocks of luma and one of each chroma, 16 x 8 samples.
SAMPLING, MCU = ((2, 1), (1, 1), (1, 1)), 4
#: MCUs in one stored image; longer payloads are stored as several images, one after the other.
IMAGE_MCUS = 384
#: Payload bytes that are coded side by side.
PASS = 1_500_000
#: Scans of a stored payload: components, first and last coefficient, bits already sent, bits left to send.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 20, 0, 1) for c in range(3)),
    *(((c,), 21, 63, 0, 1) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 63, 1, 0) for c in range(3)),
)


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Natural place of each coefficient in the order of transmission: along antidiagonals, turning at the edges."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


@lru_cache(1)
def _inverse_transform() -> np.ndarray:
    """From 64 coefficients in order of transmission to 64 samples."""
    k, x = np.mgrid[0:8, 0:8]
    one = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.einsum("ay,bx->abyx", one, one).reshape(64, 64)[zigzag()]


def dc_table() -> tuple[list[int], list[int]]:
    """Code counts by length and symbols: sizes 0 to 11 in four bits each."""
    return [0, 0, 0, 12] + [0] * 12, list(range(12))


def ac_table() -> tuple[list[int], list[int]]:
    """One bit for a coefficient of seven bits without a run, two for the end of a block, eleven for all other symbols."""
    return [1, 1] + [0] * 8 + [254] + [0] * 5, [0x07, 0x00] + [s for s in range(256) if s not in (0x07, 0x00)]


def codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), as the lengths define them."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(64)
def _look_up(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that may come next, the symbol that they begin with and its length."""
    counts, symbols = list(table[:16]), list(table[16:])
    symbol, length = np.zeros(65536, np.int64), np.full(65536, 16, np.int64)
    for s, (code, n) in codes(counts, symbols).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


# Reading


@dataclass
class Image:
    """What the markers of one image say. scans: components, first, last, high, low, tables, restart interval, entropy-coded bytes."""

    width: int = 0
    height: int = 0
    sampling: list[tuple[int, int]] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    quantised_by: list[int] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[tuple] = field(default_factory=list)
    #: A number of two bytes that a comment of the image holds.
    comment: int = 0

    @cached_property
    def units(self) -> tuple[int, int]:
        """Rows and columns of MCUs."""
        h, v = (max(s[i] for s in self.sampling) for i in (0, 1))
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    def grid(self, c: int) -> tuple[int, int]:
        """Rows and columns of a component's blocks, filled up to whole MCUs."""
        return self.units[0] * self.sampling[c][1], self.units[1] * self.sampling[c][0]

    def own(self, c: int) -> tuple[int, int]:
        """Rows and columns of the blocks that a scan of the component alone has."""
        h, v = (max(s[i] for s in self.sampling) for i in (0, 1))
        return -(-(-(-self.height * self.sampling[c][1] // v)) // 8), -(-(-(-self.width * self.sampling[c][0] // h)) // 8)


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def parse(data: bytes, start: int = 0) -> tuple[Image, int]:
    """The image that begins at start, and where it ends."""
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("no image begins here")
    image, at, interval = Image(), start + 2, 0
    tables: dict[int, bytes] = {}
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xD9:
            return image, at + 2
        size = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                n = 128 if wide else 64
                image.quantisers[body[i] & 15] = np.frombuffer(body[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                i += 1 + n
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = body[i + 1 : i + 17 + n]
                i += 17 + n
        elif marker == 0xC2:
            image.height, image.width = struct.unpack(">HH", body[1:5])
            for i in range(body[5]):
                c = body[6 + 3 * i : 9 + 3 * i]
                image.ids.append(c[0])
                image.sampling.append((c[1] >> 4, c[1] & 15))
                image.quantised_by.append(c[2])
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not a progressive image")
        elif marker == 0xFE and len(body) == 2:
            image.comment = body[0] << 8 | body[1]
        elif marker == 0xDD:
            interval = body[0] << 8 | body[1]
        elif marker == 0xDA:
            n = body[0]
            parts = tuple(image.ids.index(body[1 + 2 * i]) for i in range(n))
            first, last, bits = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(body[2 + 2 * i] >> 4 if first == 0 else 0x10 | body[2 + 2 * i] & 15, b"") for i in range(n))
            end = _MARKER.search(data, at)
            end = end.start() if end else len(data)
            image.scans.append((parts, first, last, bits >> 4, bits & 15, used, interval, data[at:end]))
            at = end


class _Bits:
    """Entropy-coded bytes of many scans: stuffing and restart markers taken out, and where each segment begins."""

    def __init__(self, parts: list[bytes]):
        d = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        after = np.zeros(len(d), bool)
        after[1:] = d[:-1] == 0xFF
        begins = np.zeros(len(d), bool)
        begins[starts] = True
        after &= ~begins
        restart = after & (d >= 0xD0) & (d <= 0xD7)
        gone = after & (d == 0) | restart
        gone[:-1] |= restart[1:]
        gone[-1] = False
        begins[1:] |= restart[:-1]
        place = np.cumsum(~gone) - ~gone
        self.starts = place[begins].astype(np.int64) * 8
        self.of_part = np.searchsorted(np.flatnonzero(begins), starts)
        clean = np.concatenate((d[~gone], np.zeros(4, np.uint8))).astype(np.int64)
        self.word = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]

    def peek(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return self.word[pos >> 3] >> (32 - n - (pos & 7)) & ((1 << n) - 1)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


class _Lanes:
    """Segments of a scan: where each is in the bits, its next block, and the block at which it ends."""

    def __init__(self, images: list[Image], scan: int, n_units: np.ndarray):
        self.bits = bits = _Bits([x.scans[scan][7] for x in images])
        interval = images[0].scans[scan][6]
        each = np.maximum(n_units, 1) if not interval else interval
        n = -(-n_units // each)
        image = np.repeat(np.arange(len(n)), n)
        number = np.arange(len(image)) - np.repeat(np.cumsum(n) - n, n)
        base = np.cumsum(n_units) - n_units
        self.cur = base[image] + number * (each[image] if not interval else interval)
        self.end = np.minimum(self.cur + (each[image] if not interval else interval), (base + n_units)[image])
        self.pos = bits.starts[bits.of_part[image] + number]


def _order(images: list[Image], parts: tuple[int, ...], base: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each unit of a scan the blocks that it holds, and the number of units of each image."""
    out, n = [], []
    for i, x in enumerate(images):
        if len(parts) == 1:
            (rows, columns), width = x.own(parts[0]), x.grid(parts[0])[1]
            out.append((base[parts[0]][i] + np.arange(rows)[:, None] * width + np.arange(columns)).reshape(-1, 1))
        else:
            rows, columns = x.units
            blocks = []
            for c in parts:
                h, v = x.sampling[c]
                for dy in range(v):
                    for dx in range(h):
                        blocks.append((base[c][i] + (np.arange(rows)[:, None] * v + dy) * x.grid(c)[1] + np.arange(columns) * h + dx).reshape(-1))
            out.append(np.stack(blocks, axis=1))
        n.append(len(out[-1]))
    return np.concatenate(out), np.array(n)


def _dc(lanes: _Lanes, order: np.ndarray, which: list[int], coefficients: list[np.ndarray], high: int, low: int, tables: list[bytes]) -> None:
    pos, cur, end = lanes.pos, lanes.cur, lanes.end
    before = np.zeros((len(pos), len(coefficients)), np.int64)
    while len(cur):
        for j, c in enumerate(which):
            block = order[cur, j]
            if high:
                coefficients[c][block, 0] |= lanes.bits.peek(pos, 1) << low
                pos = pos + 1
                continue
            symbol, length = _look_up(tables[j])
            next16 = lanes.bits.peek(pos, 16)
            size = symbol[next16]
            pos = pos + length[next16]
            before[:, c] += _extend(lanes.bits.peek(pos, size), size)
            pos = pos + size
            coefficients[c][block, 0] = before[:, c] << low
        cur = cur + 1
        going = cur < end
        if not going.all():
            pos, cur, end, before = pos[going], cur[going], end[going], before[going]


def _ac_first(lanes: _Lanes, order: np.ndarray, into: np.ndarray, first: int, last: int, low: int, table: bytes) -> None:
    symbol, length = _look_up(table)
    pos, cur, end = lanes.pos, lanes.cur, lanes.end
    k, run = np.full(len(pos), first), np.zeros(len(pos), np.int64)
    while len(cur):
        skip = run > 0
        next16 = lanes.bits.peek(pos, 16)
        rs = symbol[next16]
        r, s = rs >> 4, rs & 15
        ends = (s == 0) & (r < 15)
        if skip.any():
            s, r, ends = np.where(skip, 0, s), np.where(skip, 0, r), ends | skip
            pos = np.where(skip, pos, pos + length[next16])
        else:
            pos = pos + length[next16]
        extra = np.where(ends, r, s)
        value = lanes.bits.peek(pos, extra)
        pos = pos + extra
        put = s > 0
        if put.all():
            k = k + r
            into[order[cur, 0], k] = _extend(value, s) << low
            k = k + 1
        else:
            at = np.flatnonzero(put)
            into[order[cur[at], 0], k[at] + r[at]] = _extend(value[at], s[at]) << low
            k = np.where(ends, last + 1, k + r + 1)
            run = np.where(skip, run - 1, np.where(ends, (1 << r) - 1 + value, run))
        over = k > last
        if over.any():
            cur, k = cur + over, np.where(over, first, k)
            going = cur < end
            if not going.all():
                pos, cur, end, k, run = (x[going] for x in (pos, cur, end, k, run))


def _ac_refine(lanes: _Lanes, order: np.ndarray, into: np.ndarray, first: int, last: int, low: int, table: bytes) -> None:
    symbol, length = _look_up(table)
    pos, cur, end = lanes.pos, lanes.cur, lanes.end
    n = len(pos)
    k, run, zeros, new, need, bit = np.full(n, first), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), 1 << low
    while len(cur):
        at = np.flatnonzero(need & (run == 0))
        if len(at):
            next16 = lanes.bits.peek(pos[at], 16)
            rs = symbol[next16]
            r, s = rs >> 4, rs & 15
            p = pos[at] + length[next16]
            ends = (s == 0) & (r < 15)
            extra = np.where(ends, r, s)
            value = lanes.bits.peek(p, extra)
            pos[at] = p + extra
            run[at] = np.where(ends, (1 << r) + value, 0)
            zeros[at] = r
            new[at] = np.where(s > 0, np.where(value > 0, bit, -bit), 0)
            need[at] = False
        block = order[cur, 0]
        c = into[block, k]
        old = c != 0
        one = lanes.bits.peek(pos, 1)
        if old.all():
            into[block, k] = c + np.where((one > 0) & (np.abs(c) & bit == 0), np.sign(c) * bit, 0)
            pos = pos + 1
        else:
            pos = pos + old
            place = ~old & (run == 0) & (zeros == 0)
            into[block, k] = np.where(old, c + np.where((one > 0) & (np.abs(c) & bit == 0), np.sign(c) * bit, 0), np.where(place, new, c))
            zeros = zeros - (~old & (run == 0) & (zeros > 0))
            need = need | place
        k = k + 1
        over = k > last
        if over.any():
            cur, k, need = cur + over, np.where(over, first, k), need | over
            run = run - (over & (run > 0))
            going = cur < end
            if not going.all():
                pos, cur, end, k, run, zeros, new, need = (x[going] for x in (pos, cur, end, k, run, zeros, new, need))


def coefficients(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image and component its quantised coefficients: blocks (in rows, filled up to whole MCUs) by order of transmission."""
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, x in enumerate(images):
        groups[tuple(x.sampling), tuple(s[:7] for s in x.scans)].append(i)
    out: list[list[np.ndarray]] = [[] for _ in images]
    for (sampling, script), members in groups.items():
        own = [images[i] for i in members]
        blocks = [[x.grid(c)[0] * x.grid(c)[1] for x in own] for c in range(len(sampling))]
        base = {c: np.cumsum([0, *n])[:-1] for c, n in enumerate(blocks)}
        sums = [np.zeros((sum(n), 64), np.int64) for n in blocks]
        orders = {parts: _order(own, parts, base) for parts in {x[0] for x in script}}
        for s, (parts, first, last, high, low, tables, _) in enumerate(script):
            order, n_units = orders[parts]
            lanes = _Lanes(own, s, n_units)
            if first == 0:
                which = [c for c in parts for _ in range(sampling[c][0] * sampling[c][1] if len(parts) > 1 else 1)]
                _dc(lanes, order, which, sums, high, low, [tables[parts.index(c)] for c in which])
            elif high:
                _ac_refine(lanes, order, sums[parts[0]], first, last, low, tables[0])
            else:
                _ac_first(lanes, order, sums[parts[0]], first, last, low, tables[0])
        for c, n in enumerate(blocks):
            for i, part in zip(members, np.split(sums[c], np.cumsum(n)[:-1])):
                out[i].append(part)
    return out


def _samples(blocks: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(blocks * quantiser @ _inverse_transform() + 128.5 + 1e-7), 0, 255)


def _to_rgb(planes: list[np.ndarray]) -> np.ndarray:
    """Full-range YCbCr (or one component, for grey) to RGB bytes, on the last axis."""
    if len(planes) == 1:
        planes = [planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128)]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=-1)
    return np.clip(np.floor(rgb + 0.5 + 1e-7), 0, 255).astype(np.uint8)


def tensor(image: Image, blocks: list[np.ndarray]) -> np.ndarray:
    """The image as height x width x 3 bytes; chroma is upsampled by repetition."""
    h, v = (max(s[i] for s in image.sampling) for i in (0, 1))
    planes = []
    for c, b in enumerate(blocks):
        rows, columns = image.grid(c)
        plane = _samples(b, image.quantisers[image.quantised_by[c]]).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane = plane.repeat(v // image.sampling[c][1], axis=0).repeat(h // image.sampling[c][0], axis=1)
        planes.append(plane[: image.height, : image.width])
    return _to_rgb(planes)


def decode(data: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive images, decoded together."""
    images = [parse(x)[0] for x in data]
    return [tensor(x, b) for x, b in zip(images, coefficients(images))]


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int, sampling: tuple, quantiser: bytes, interval: int) -> bytes:
    parts = b"".join(bytes((c + 1, h << 4 | v, 0)) for c, (h, v) in enumerate(sampling))
    out = b"\xff\xd8" + _segment(0xDB, b"\0" + quantiser) + _segment(0xC2, struct.pack(">BHHB", 8, height, width, len(sampling)) + parts)
    for kind, (counts, symbols) in ((0x00, dc_table()), (0x10, ac_table())):
        out += _segment(0xC4, bytes((kind, *counts, *symbols)))
    return out + (_segment(0xDD, struct.pack(">H", interval)) if interval else b"")


def _scan_head(parts: tuple[int, ...], first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes((len(parts), *(x for c in parts for x in (c + 1, 0)), first, last, high << 4 | low)))


@lru_cache(4 * IMAGE_MCUS)
def _payload_head(mcus: int, blocks: int) -> bytes:
    """blocks: how many are the payload's, as a comment of the image; the rest fill the last MCU."""
    return _head(16 * mcus, 8, SAMPLING, b"\1" * 64, 1) + _segment(0xFE, struct.pack(">H", blocks))


def _laid_out(data: np.ndarray, lengths: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Rows of entropy-coded bytes, one a unit, stuffed and with restart markers before all but the first of an image; and where each row begins."""
    width = data.shape[1]
    wide = np.zeros((len(data), 2 + 2 * width), np.uint8)
    keep = np.zeros(wide.shape, bool)
    inner = number > 0
    wide[:, 0], wide[:, 1] = 0xFF, 0xD0 + (number - 1) % 8
    keep[:, 0] = keep[:, 1] = inner
    wide[:, 2::2] = data
    valid = np.arange(width) < lengths[:, None]
    keep[:, 2::2] = valid
    keep[:, 3::2] = valid & (data == 0xFF)
    return wide[keep].tobytes(), np.concatenate(([0], np.cumsum(keep.sum(axis=1))))


def store(payloads: list[bytes]) -> list[bytes]:
    """Progressive images, one after the other for a long payload, whose coefficients are the payload's bytes.

    A byte is the coefficient of eight bits that its own bits stand for in a scan: 128 to 255 as they are, 0 to 127
    less 255. So all coefficients differ from zero, and both kinds of AC scan have a fixed length. Blocks go to MCUs in
    order: two of luma, one of each chroma.
    """
    own = np.array([len(p) // 64 for p in payloads])
    mcus = -(-own // MCU)
    raw = np.frombuffer(b"".join([p + b"\x80" * (int(m) * MCU * 64 - len(p)) for p, m in zip(payloads, mcus)]), np.uint8).reshape(-1, MCU, 64).astype(np.int16)
    value = np.where(raw >= 128, raw, raw - 255)
    number = np.concatenate([np.arange(n) % IMAGE_MCUS for n in mcus])
    scans, per_mcu = [], []
    for parts, first, last, high, low in SCRIPT:
        if first == 0 and not high:
            acc, n = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
            dc = (value[:, :, 0] >> low).astype(np.int64)
            for d in (dc[:, 0], dc[:, 1] - dc[:, 0], dc[:, 2], dc[:, 3]):
                size = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)
                acc = acc << 4 + size | size << size | np.where(d < 0, d + (1 << size) - 1, d)
                n += 4 + size
            size = -(-n // 8)
            acc = acc << (size * 8 - n) | (1 << (size * 8 - n)) - 1
            data = np.stack([acc >> np.maximum(8 * (size - 1 - i), 0) & 255 for i in range(7)], axis=1).astype(np.uint8)
            scans.append(_laid_out(data, size, number))
            per_mcu.append(1)
            continue
        if first == 0:
            bits = np.concatenate((value[:, :, 0] & 1, np.ones((len(raw), 8 - MCU), np.int16)), axis=1)
            scans.append(_laid_out(np.packbits(bits.astype(bool), axis=1), np.ones(len(raw), np.int64), number))
            per_mcu.append(1)
            continue
        luma = parts[0] == 0
        blocks = value[:, :2].reshape(-1, 64) if luma else value[:, parts[0] + 1]
        places = np.stack((2 * number, 2 * number + 1), axis=1).ravel() if luma else number
        per_mcu.append(2 if luma else 1)
        if not high:
            v = blocks[:, first : last + 1]
            data = np.where(v > 0, v >> 1, 127 - (-v >> 1)).astype(np.uint8)
            scans.append(_laid_out(data, np.full(len(v), data.shape[1]), places))
        else:
            ones = np.ones((len(blocks), 7), bool)
            bits = np.concatenate((ones[:, :1], ~ones[:, :1], (np.abs(blocks[:, 1:]) & 1).astype(bool), ones), axis=1)
            scans.append(_laid_out(np.packbits(bits, axis=1), np.full(len(blocks), 9), places))
    heads = [_scan_head(*s) for s in SCRIPT]
    out, at = [], 0
    for n, blocks in zip(mcus.tolist(), own.tolist()):
        parts = []
        for a in range(at, at + n, IMAGE_MCUS):
            b = min(a + IMAGE_MCUS, at + n)
            parts.append(_payload_head(b - a, min(blocks - (a - at) * MCU, IMAGE_MCUS * MCU)))
            for head, (data, place), k in zip(heads, scans, per_mcu):
                parts += (head, data[place[a * k] : place[b * k]])
            parts.append(b"\xff\xd9")
        out.append(b"".join(parts))
        at += n
    return out


def split(data: bytes) -> list[Image]:
    """The images that lie one after the other."""
    out, at = [], 0
    while at < len(data):
        image, at = parse(data, at)
        out.append(image)
    return out


def read(stored: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The payloads back from stored images, and for each the full-resolution RGB tensor of its images, side by side.

    All images are 8 samples high, so those of many payloads are one wide image to the inverse transform and the
    upsampling of chroma.
    """
    images = [split(x) for x in stored]
    flat = [y for x in images for y in x]
    planes = [np.concatenate(x) for x in zip(*coefficients(flat))]
    value = np.concatenate((planes[0].reshape(-1, 2, 64), planes[1][:, None], planes[2][:, None]), axis=1)
    raw = np.where(value > 0, value, value + 255).astype(np.uint8).reshape(-1, 64)
    wide = Image(16 * len(value), 8, list(SAMPLING), flat[0].ids, flat[0].quantised_by, flat[0].quantisers)
    rgb = tensor(wide, planes)
    mcus = np.cumsum([0, *[sum(y.units[1] for y in x) for x in images]]).tolist()
    payloads = [raw[a * MCU :][: sum(y.comment for y in x)].tobytes() for a, x in zip(mcus, images)]
    return payloads, [rgb[:, 16 * a : 16 * b] for a, b in zip(mcus, mcus[1:])]


def _code_scan(parts_of_unit: list[list[tuple[int, int]]], all_blocks: list[np.ndarray], first: int, last: int, high: int, low: int, interval: int) -> bytes:
    """Any scan, bit by bit. parts_of_unit: for each unit the (component, block) pairs that it holds."""
    dc, ac = codes(*dc_table()), codes(*ac_table())
    out, bits = bytearray(), []

    def put(value: int, n: int) -> None:
        bits.extend(value >> i & 1 for i in range(n - 1, -1, -1))

    def flush() -> None:
        bits.extend([1] * (-len(bits) % 8))
        for b in np.packbits(np.array(bits, bool)).tobytes():
            out.append(b)
            if b == 0xFF:
                out.append(0)
        bits.clear()

    before: dict[int, int] = {}
    for u, unit in enumerate(parts_of_unit):
        if interval and u and u % interval == 0:
            flush()
            out.extend((0xFF, 0xD0 + (u // interval - 1) % 8))
            before.clear()
        for c, b in unit:
            block = all_blocks[c][b]
            if first == 0:
                d = int(block[0]) >> low
                if high:
                    put(d & 1, 1)
                    continue
                diff = d - before.get(c, 0)
                before[c] = d
                size = abs(diff).bit_length()
                put(*dc[size])
                put(diff if diff >= 0 else diff + (1 << size) - 1, size)
                continue
            was = [abs(int(x)) >> high if high else 0 for x in block]
            now = [abs(int(x)) >> low for x in block]
            fresh = [k for k in range(first, last + 1) if now[k] and not was[k]]
            run, late = 0, []
            for k in range(first, (fresh[-1] if fresh else first - 1) + 1):
                if was[k]:
                    late.append(now[k] & 1)
                    continue
                if not now[k]:
                    run += 1
                    if run == 16:
                        put(*ac[0xF0])
                        for x in late:
                            put(x, 1)
                        run, late = 0, []
                    continue
                size = 1 if high else now[k].bit_length()
                put(*ac[run << 4 | size])
                if high:
                    put(int(block[k] > 0), 1)
                else:
                    put(now[k] if block[k] > 0 else (1 << size) - 1 - now[k], size)
                for x in late:
                    put(x, 1)
                run, late = 0, []
            if not fresh or fresh[-1] < last:
                put(*ac[0x00])
                for x in late + [now[k] & 1 for k in range((fresh[-1] if fresh else first - 1) + 1, last + 1) if was[k]]:
                    put(x, 1)
    flush()
    return bytes(out)


def encode(rgb: np.ndarray, sampling: tuple = ((2, 2), (1, 1), (1, 1)), quantiser: int = 2, interval: int = 0, script: tuple = SCRIPT) -> bytes:
    """A progressive image of height x width x 3 bytes, with chroma averaged over the sampling. Plain and slow; store() is for payloads."""
    image = Image(rgb.shape[1], rgb.shape[0], list(sampling), [1, 2, 3])
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    full = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    h, v = (max(s[i] for s in sampling) for i in (0, 1))
    blocks = []
    for c, plane in enumerate(full):
        rows, columns = image.units[0] * 8 * v, image.units[1] * 8 * h
        plane = np.pad(plane, ((0, rows - plane.shape[0]), (0, columns - plane.shape[1])), mode="edge")
        sy, sx = v // sampling[c][1], h // sampling[c][0]
        plane = plane.reshape(rows // sy, sy, columns // sx, sx).mean(axis=(1, 3)) - 128
        n = plane.shape[0] // 8, plane.shape[1] // 8
        cells = plane.reshape(n[0], 8, n[1], 8).transpose(0, 2, 1, 3).reshape(-1, 64)
        blocks.append(np.rint(cells @ _inverse_transform().T / quantiser).astype(np.int64))
    return encode_blocks(image, blocks, bytes([quantiser]) * 64, interval, script)


def encode_blocks(image: Image, blocks: list[np.ndarray], quantiser: bytes, interval: int = 0, script: tuple = SCRIPT) -> bytes:
    """A progressive image of quantised coefficients."""
    out = [_head(image.width, image.height, tuple(image.sampling), quantiser, interval)]
    base = {c: np.zeros(1, np.int64) for c in range(len(blocks))}
    for parts, first, last, high, low in script:
        order, _ = _order([image], parts, base)
        which = [c for c in parts for _ in range(image.sampling[c][0] * image.sampling[c][1] if len(parts) > 1 else 1)]
        units = [list(zip(which, row)) for row in order.tolist()]
        out += [_scan_head(parts, first, last, high, low), _code_scan(units, blocks, first, last, high, low, interval)]
    return b"".join([*out, b"\xff\xd9"])


# Spark


def media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False, with_tensor: bool = False) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and media; and height, width, rgb: the full-resolution tensor by rows).

    A text's UTF-8, filled up with spaces to a positive multiple of 192 bytes, is stored as the coefficients of
    progressive images with chroma of half the width; everything else but n_bytes comes from the stored bytes: the
    payload read back, and the full-resolution RGB tensor after the inverse transform and upsampling, whose mean red,
    green and blue are the feature. Null counts as the empty text. Repeated rows and equal texts
    get equal values; a long text is many images, so memory follows the batch's bytes only through the text itself. An
    empty table gives an empty one. Other columns of df are not looked at.
    """
    base = id_and_text(df, id_col, text_col)
    more = (("media", "binary"),) * with_media + (("height", "int"), ("width", "int"), ("rgb", "binary")) * with_tensor
    schema = schema_of(base, ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in passes(batch, most=PASS):
                raw = text_bytes(part.column("text"))
                stored = store([x + b" " * (-len(x) % UNIT if x else UNIT) for x in raw])
                back, rgb = read(stored)
                means = [x.reshape(-1, 3).mean(axis=0) for x in rgb]
                columns = [
                    pa.array([len(x) for x in raw], pa.int64()), pa.array([len(x) for x in back], pa.int64()), pa.array(map(sha, back), pa.string()),
                    pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()), pa.array([len(x) for x in stored], pa.int64()), pa.array(map(sha, stored), pa.string()),
                    pa.array([f"{r:.4f},{g:.4f},{b:.4f}" for r, g, b in means], pa.string()),
                ]
                columns += [pa.array(stored, pa.binary())] * with_media
                if with_tensor:
                    columns += [pa.array([len(x) for x in rgb], pa.int32()), pa.array([x.shape[1] for x in rgb], pa.int32()), pa.array([x.tobytes() for x in rgb], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], schema.names)

    return base.mapInArrow(run, schema)


def tensors(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per row of df: doc_id, height, width, rgb (rows of bytes) of the progressive image in a binary column; nulls for null or other media."""
    from pyspark.sql import functions as F

    base = df.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))
    schema = schema_of(base, ("height", "int"), ("width", "int"), ("rgb", "binary"))

    def one(data: bytes | None) -> Image | None:
        try:
            return parse(data)[0] if data else None
        except (ValueError, IndexError, struct.error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "media", PASS):
                images = [one(x) for x in part.column("media").to_pylist()]
                good = [x for x in images if x is not None]
                found = iter([tensor(x, b) for x, b in zip(good, coefficients(good))] if good else [])
                rgb = [None if x is None else next(found) for x in images]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x and x.height for x in images], pa.int32()), pa.array([x and x.width for x in images], pa.int32()), pa.array([None if x is None else x.tobytes() for x in rgb], pa.binary())], schema.names)

    return base.mapInArrow(run, schema)

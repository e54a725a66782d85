"""Grey PNG images in numpy: decoding of whatever depth, encoding in 8 and 16 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type (grey, colours, grey with alpha, colours with alpha), and the weights of colours in grey.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
WEIGHTS = (0.299, 0.587, 0.114)


class PngError(ValueError):
    """Why a file could not be read."""


def _chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or len(data) < at + 12 + size:
            raise PngError("cut off")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise PngError(f"checksum of {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise PngError("cut off")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner the one nearest to left + above - corner; ties in that order."""
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of a filter byte and filtered bytes as plain bytes. step: bytes from a sample to the one on its left."""
    h, w = rows.shape[0], rows.shape[1] - 1
    above = np.zeros(w, np.uint8)
    out = np.empty((h, w), np.uint8)
    for y in range(h):
        kind, line = int(rows[y, 0]), rows[y, 1:]
        if kind == 0:
            above = line
        elif kind == 1:
            padded = np.zeros(-(-w // step) * step, np.uint8)
            padded[:w] = line
            above = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:w]
        elif kind == 2:
            above = line + above
        elif kind in (3, 4):
            got, up = line.tolist(), above.tolist()
            for x in range(w):
                a, b, c = (got[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                got[x] = (got[x] + guess) & 255
            above = np.array(got, np.uint8)
        else:
            raise PngError(f"filter {kind}")
        out[y] = above
    return out


def decode(data: bytes) -> np.ndarray:
    """h x w in uint8 (up to 8 bits) or uint16; colours become grey, alpha is left out. PngError says why a file is not read."""
    parts, head = [], None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
    if head is None:
        raise PngError("no header")
    w, h, depth, colour, _, _, interlaced = head
    if colour not in SAMPLES or depth not in (1, 2, 4, 8, 16) or (depth < 8 and colour):
        raise PngError(f"colour type {colour} with {depth} bits")
    if interlaced:
        raise PngError("interlaced")
    n = SAMPLES[colour]
    line = (w * n * depth + 7) // 8
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise PngError("compressed data") from e
    if len(raw) != h * (line + 1) or not raw:
        raise PngError("size of the data")
    plain = _unfiltered(np.frombuffer(raw, np.uint8).reshape(h, line + 1), max(n * depth // 8, 1))
    if depth == 16:
        plain = plain.view(">u2").astype(np.uint16)
    elif depth < 8:
        bits = np.unpackbits(plain, axis=1).reshape(h, -1, depth)[:, :w]
        plain = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8) * np.uint8(255 // ((1 << depth) - 1))
    pixels = plain.reshape(h, w, n)
    return pixels[..., 0] if n < 3 else np.rint(pixels[..., :3] @ np.array(WEIGHTS)).astype(pixels.dtype)


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """A PNG file of a uint8 or uint16 image; each row takes the filter with the least sum of signed residuals."""
    h, w = image.shape
    depth = image.dtype.itemsize
    x = np.ascontiguousarray(image.astype(">u2") if depth == 2 else image).view(np.uint8).reshape(h, w * depth).astype(np.int16)
    above = np.vstack([np.zeros((1, x.shape[1]), np.int16), x[:-1]])
    left, corner = (np.hstack([np.zeros((h, depth), np.int16), a[:, :-depth]]) for a in (x, above))
    made = np.stack([x, x - left, x - above, x - (left + above) // 2, x - _paeth(left, above, corner)]).astype(np.uint8)
    best = np.abs(made.view(np.int8).astype(np.int64)).sum(2).argmin(0)
    rows = np.hstack([best[:, None].astype(np.uint8), made[best, np.arange(h)]])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8 * depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")

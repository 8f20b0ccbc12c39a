"""PNG files as arrays, in NumPy: all colour kinds and depths, palettes, the five filters, both orders of rows.

Filters refer to the pixel on the left and the row above, so a picture is undone along its diagonals: all pixels of a
diagonal at once, whatever filter each row has. Alpha is left out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour kind; first column and row and steps of the seven passes of interlaced files.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunks(data: bytes) -> dict[bytes, bytes]:
    out: dict[bytes, bytes] = {}
    at = len(_MAGIC)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("a broken piece")
        out[kind] = out.get(kind, b"") + body
        at += 12 + size
        if kind == b"IEND":
            break
    return out


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows that begin with their filter's number; ``step``: bytes from a pixel to the next."""
    kind = lines[:, 0].astype(np.int32)
    if kind.max(initial=0) > 4:
        raise ValueError("an unknown filter")
    height, n = len(lines), (lines.shape[1] - 1) // step
    raw = lines[:, 1:].reshape(height, n, step).astype(np.int32)
    out = np.zeros((height + 1, n + 1, step), np.int32)
    for t in range(n + height - 1):
        r = np.arange(max(0, t - n + 1), min(height - 1, t) + 1)
        x = t - r
        left, up, corner = out[r + 1, x], out[r, x + 1], out[r, x]
        guess = left + up - corner
        a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        own = kind[r][:, None]
        out[r + 1, x + 1] = (raw[r, x] + np.select([own == 1, own == 2, own == 3, own == 4], [left, up, (left + up) >> 1, paeth], 0)) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)


def read_png(data: bytes) -> np.ndarray:
    """Height, width and three channels; ``ValueError`` for what is no whole PNG file."""
    if not data.startswith(_MAGIC):
        raise ValueError("no PNG file")
    chunks = _chunks(data)
    try:
        width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        stream = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8)
        channels = CHANNELS[colour]
    except (KeyError, struct.error, zlib.error) as wrong:
        raise ValueError("no whole PNG file") from wrong
    values = np.zeros((height, width, channels), np.uint8)
    at = 0
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        size = -(-w * channels * depth // 8)
        lines = stream[at : at + h * (size + 1)]
        if len(lines) < h * (size + 1):
            raise ValueError("rows are missing")
        at += len(lines)
        rows = _unfiltered(lines.reshape(h, size + 1), max(1, channels * depth // 8))
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
            rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, : w * channels]
            rows = rows if colour == 3 else (rows.astype(np.int32) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        values[y0::dy, x0::dx] = rows.reshape(h, w, channels)
    if colour == 3:
        palette = np.frombuffer(chunks.get(b"PLTE", b""), np.uint8).reshape(-1, 3)
        if values.max(initial=0) >= len(palette):
            raise ValueError("a colour is missing")
        return palette[values[:, :, 0]]
    return np.repeat(values[:, :, :1], 3, axis=2) if channels < 3 else values[:, :, :3]


def write_png(picture: np.ndarray) -> bytes:
    """A PNG file of three channels, without filters."""
    height, width, _ = picture.shape
    rows = np.zeros((height, 1 + 3 * width), np.uint8)
    rows[:, 1:] = picture.reshape(height, -1)
    piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return _MAGIC + piece(b"IHDR", head) + piece(b"IDAT", zlib.compress(rows.tobytes())) + piece(b"IEND", b"")

"""Small PNG images without an imaging library: 8-bit grey, RGB and RGBA, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels of each colour type, and the smallest width and height that a vision model should see.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
LEAST_WIDTH, LEAST_HEIGHT = 400, 150


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x 3 bytes; raises ValueError for what isn't such a PNG."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, body, head = len(SIGNATURE), b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    width, height, deep = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * deep)
    out = np.zeros((height, width * deep), np.uint8)
    for y in range(height):
        above = out[y - 1] if y else np.zeros(width * deep, np.uint8)
        out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, deep)
    pixels = out.reshape(height, width, deep)
    return np.repeat(pixels[..., :1], 3, axis=2) if deep < 3 else pixels[..., :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, deep: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = np.zeros(len(line) + deep, np.int64)
    up = np.concatenate([np.zeros(deep, np.int64), above.astype(np.int64)])
    for k in range(len(line)):
        a, b, c = out[k], up[k + deep], up[k]
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((a, b, c), key=lambda x, p=p: abs(p - x))
        out[k + deep] = (line[k] + guess) & 255
    return out[deep:].astype(np.uint8)


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1).astype(np.uint8)], axis=1)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def png_size(data: bytes) -> tuple[int, int] | None:
    return struct.unpack(">II", data[16:24]) if data.startswith(SIGNATURE) and len(data) >= 24 else None


def box_on(width: int, height: int, box: dict) -> tuple[int, int, int, int] | None:
    """Columns and rows of a box with l, t, r, b, measured from the bottom if its coord_origin says so, inside the image; None where
    sides are missing or nothing is left."""
    sides = [box.get(k) for k in "ltrb"]
    if any(s is None for s in sides):
        return None
    left, top, right, bottom = sides
    if str(box.get("coord_origin") or "").upper() == "BOTTOMLEFT":
        top, bottom = height - top, height - bottom
    inside = lambda v, most: max(0, min(most, int(v)))
    (x0, x1), (y0, y1) = sorted((left, right)), sorted((top, bottom))
    x0, x1, y0, y1 = inside(x0, width), inside(x1, width), inside(y0, height), inside(y1, height)
    return (x0, x1, y0, y1) if x1 > x0 and y1 > y0 else None


def cropped(data: bytes, box: dict | None) -> bytes:
    """The part of a PNG in the box, the whole of it where the box holds nothing."""
    pixels = decode_png(data)
    at = box_on(pixels.shape[1], pixels.shape[0], box or {})
    return encode_png(pixels if at is None else pixels[at[2] : at[3], at[0] : at[1]])


def enlarged(data: bytes) -> bytes:
    """Small images blown up by one factor until they are wide and high enough for a vision model; others as they are, in RGB."""
    pixels = decode_png(data)
    height, width, _ = pixels.shape
    factor = max(1.0, LEAST_WIDTH / width, LEAST_HEIGHT / height)
    if factor > 1:
        rows, cols = (np.minimum((np.arange(round(n * factor)) / factor).astype(int), n - 1) for n in (height, width))
        pixels = pixels[rows][:, cols]
    return encode_png(pixels)

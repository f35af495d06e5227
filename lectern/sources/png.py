"""Grey PNG files without an imaging library: encoding any, decoding what the encoder or other tools write as 8-bit grey, colour or with alpha."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Channels by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(image: np.ndarray, dpi: int | None = None) -> bytes:
    """A grey image; ``dpi`` is stored as pixels per metre."""

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    height, width = image.shape
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = image
    density = chunk(b"pHYs", struct.pack(">IIB", round(dpi / 0.0254), round(dpi / 0.0254), 1)) if dpi else b""
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + density + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> tuple[np.ndarray, float | None]:
    """(pixels of height x width or height x width x channels, dpi if stored)."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    at, packed, header, dpi = 8, b"", None, None
    while at < len(data):
        n, tag = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(tag + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a broken PNG file")
        if tag == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif tag == b"pHYs" and body[8] == 1:
            dpi = struct.unpack(">I", body[:4])[0] * 0.0254
        elif tag == b"IDAT":
            packed += body
        at += 12 + n
    width, height, bits, colour, _, _, interlaced = header
    if bits != 8 or colour not in CHANNELS or interlaced:
        raise ValueError("only 8-bit grey and colour without interlacing")
    channels = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.int64)
    for y in range(height):
        out[y] = _unfilter(int(raw[y, 0]), raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(width * channels, np.int64), channels)
    pixels = out.astype(np.uint8)
    return (pixels if channels == 1 else pixels.reshape(height, width, channels)), dpi


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) & 255
    if kind not in (3, 4):
        raise ValueError("an unknown PNG filter")
    out = np.zeros(len(line) + step, np.int64)
    up = np.r_[np.zeros(step, np.int64), above]
    for k in range(step, len(out)):
        a, b, c = out[k - step], up[k], up[k - step]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
            guess = near[2]
        out[k] = (line[k - step] + guess) & 255
    return out[step:]

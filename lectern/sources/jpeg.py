"""What a JPEG file says about itself: how it is to be turned, and its resolution.

Pixels come from the JVM's decoder (:func:`lectern.sources.files.with_pixels`).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# Marker and tag numbers of the formats.
START, APP0, APP1, SCAN = 0xD8, 0xE0, 0xE1, 0xDA
ORIENTATION, X_RESOLUTION, RESOLUTION_UNIT = 0x0112, 0x011A, 0x0128


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of the segments before the picture."""
    if data[:2] != bytes([0xFF, START]):
        raise ValueError("no JPEG file")
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        if data[at + 1] == 0xFF:  # filling
            at += 1
            continue
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == SCAN:
            return
        yield marker, data[at + 4 : at + 2 + size]
        at += 2 + size


def _tags(tiff: bytes) -> dict[int, float]:
    """Numbers of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}
    start = struct.unpack_from(order + "I", tiff, 4)[0]
    found: dict[int, float] = {}
    if start + 2 > len(tiff):
        return {}
    for k in range(struct.unpack_from(order + "H", tiff, start)[0]):
        at = start + 2 + 12 * k
        if at + 12 > len(tiff):
            break
        tag, kind = struct.unpack_from(order + "HH", tiff, at)
        if kind == 3:
            found[tag] = struct.unpack_from(order + "H", tiff, at + 8)[0]
        elif kind == 5 and (place := struct.unpack_from(order + "I", tiff, at + 8)[0]) + 8 <= len(tiff):
            above, below = struct.unpack_from(order + "II", tiff, place)
            found[tag] = above / below if below else 0.0
    return found


def describe(data: bytes) -> tuple[int, float | None]:
    """(orientation 1 to 8, dots per inch if stored)."""
    turn, dpi = 1, None
    for marker, body in segments(data):
        if marker == APP0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            unit, across = body[7], struct.unpack_from(">H", body, 8)[0]
            if across and unit in (1, 2):
                dpi = across * (2.54 if unit == 2 else 1.0)
        elif marker == APP1 and body[:6] == b"Exif\0\0":
            tags = _tags(body[6:])
            turn = int(tags.get(ORIENTATION, 1)) if 1 <= tags.get(ORIENTATION, 1) <= 8 else 1
            if dpi is None and tags.get(X_RESOLUTION):
                dpi = tags[X_RESOLUTION] * (2.54 if tags.get(RESOLUTION_UNIT) == 3 else 1.0)
    return turn, dpi


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """The picture as it is meant to be seen: 2, 4, 5, 7 are mirrored, 5 to 8 have rows and columns exchanged."""
    if turn >= 5:
        pixels = pixels.swapaxes(0, 1)
    if turn in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels

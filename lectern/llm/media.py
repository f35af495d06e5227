"""Media columns: what binary columns hold is told from their bytes, not from their declared type.

An Aho-Corasick automaton over magic bytes locates every possible start of a known
format in one pass.  A validator for each format then confirms structure and
lengths, so that the letters ``BM`` in prose are not taken for a bitmap.  A confirmed
format at the start corrects the declared type; confirmed formats further in are
carved out as embedded media.

Formats: wav (RIFF/WAVE, PCM), webp, png, jpeg, gif, bmp (uncompressed 24 bit and paletted), tiff,
mp4 (and its kin), mp3 (with a tag), zip (a whole archive, or else one complete entry), gzip, pdf
(header and last trailer), flac, ogg.  Compressed parts are unpacked to be checked, in bounded pieces.

Scale: each value is handled for itself in an Arrow map over the scan; nothing is
shuffled, gathered or kept between rows.

Cases: null and empty values give a null type and no embedded media; any bytes are
accepted; other columns are carried along; keys of :func:`carve` that are called like one of its own
columns come out with ``key_`` before their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Magic bytes by format, and how far into the file they stand where that isn't the start.
MAGIC = {
    "wav": b"RIFF",
    "webp": b"RIFF",
    "jpeg": b"\xff\xd8\xff",
    "tiff_le": b"II*\0",
    "tiff_be": b"MM\0*",
    "mp4": b"ftyp",
    "mp3": b"ID3",
    "png": b"\x89PNG\r\n\x1a\n",
    "gif87": b"GIF87a",
    "gif89": b"GIF89a",
    "bmp": b"BM",
    "zip": b"PK\x03\x04",
    "gzip": b"\x1f\x8b\x08",
    "pdf": b"%PDF-",
    "flac": b"fLaC",
    "ogg": b"OggS",
}
BEHIND = {"mp4": 4}
NAMES = {"gif87": "gif", "gif89": "gif", "tiff_le": "tiff", "tiff_be": "tiff"}
SAMPLE_RATE = 8_000
PIECE = 1 << 20  # unpacked at once


def wav(samples: bytes) -> bytes:
    """A mono PCM file of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) & 1)
    body = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wav_samples(data: bytes) -> bytes:
    """The samples of a file that :func:`_wav` has confirmed."""
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= end:
        tag, n = struct.unpack_from("<4sI", data, at)
        if tag == b"data":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _wav(data: memoryview, at: int) -> int:
    if len(data) < at + 44 or data[at + 8 : at + 12] != b"WAVE":
        return 0
    end, pos, seen = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, set()
    if end > len(data):
        return 0
    while pos + 8 <= end:
        tag, n = struct.unpack_from("<4sI", data, pos)
        if pos + 8 + n > end or tag == b"fmt " and n < 16 or tag == b"data" and b"fmt " not in seen:
            return 0
        if tag == b"fmt ":
            kind, channels, rate, byte_rate, align, bits = struct.unpack_from("<HHIIHH", data, pos + 8)
            if kind != 1 or not channels or bits % 8 or align != channels * bits // 8 or byte_rate != rate * align:
                return 0
        seen.add(tag)
        pos += 8 + n + (n & 1)
    return end - at if pos == end and {b"fmt ", b"data"} <= seen else 0


def _png(data: memoryview, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        n, tag = struct.unpack_from(">I4s", data, pos)
        if pos + 12 + n > len(data) or first and (tag != b"IHDR" or n != 13) or zlib.crc32(data[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", data, pos + 8 + n)[0]:
            return 0
        pos, first = pos + 12 + n, False
        if tag == b"IEND":
            return pos - at
    return 0


def _gif(data: memoryview, at: int) -> int:
    if len(data) < at + 13:
        return 0
    flags, pos, images = data[at + 10], at + 13, 0
    pos += 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(pos: int) -> int:
        while pos < len(data) and data[pos]:
            pos += 1 + data[pos]
        return pos + 1

    while pos < len(data):
        mark = data[pos]
        if mark == 0x3B:
            return pos + 1 - at if images else 0
        if mark == 0x21:
            pos = blocks(pos + 2)
        elif mark == 0x2C and pos + 10 < len(data):
            flags = data[pos + 9]
            pos = blocks(pos + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
            images += 1
        else:
            return 0
    return 0


def _bmp(data: memoryview, at: int) -> int:
    if len(data) < at + 54:
        return 0
    size, reserved, offset, header, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    rows = abs(height) * ((width * bits + 31) // 32 * 4) if width > 0 else -1
    ok = not reserved and header >= 40 and planes == 1 and bits in (1, 4, 8, 24, 32) and not packing and rows > 0 and offset >= 14 + header and size == offset + rows and at + size <= len(data)
    return size if ok else 0


def _jpeg(data: memoryview, at: int) -> int:
    """Segments up to the end marker; entropy-coded data has no other marker than restarts."""
    pos, frame = at + 2, False
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xFF:
            pos += 1
            continue
        if marker == 0xD9:
            return pos + 2 - at if frame else 0
        n = int.from_bytes(data[pos + 2 : pos + 4], "big")
        if n < 2 or marker in (0, 1) or 0xD0 <= marker <= 0xD8 or pos + 2 + n > len(data):
            return 0
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            frame = n >= 8
        pos += 2 + n
        if marker == 0xDA:
            if not frame:
                return 0
            rest = bytes(data[pos:])
            k = rest.find(b"\xff")
            while 0 <= k < len(rest) - 1 and (rest[k + 1] == 0 or 0xD0 <= rest[k + 1] <= 0xD7):
                k = rest.find(b"\xff", k + 2)
            if k < 0:
                return 0
            pos += k
    return pos + 2 - at if frame and pos + 2 <= len(data) and bytes(data[pos : pos + 2]) == b"\xff\xd9" else 0


def _webp(data: memoryview, at: int) -> int:
    if len(data) < at + 20 or data[at + 8 : at + 12] != b"WEBP":
        return 0
    end, pos, first = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, True
    if end > len(data):
        return 0
    while pos + 8 <= end:
        tag, n = struct.unpack_from("<4sI", data, pos)
        if first and tag not in (b"VP8 ", b"VP8L", b"VP8X") or pos + 8 + n > end:
            return 0
        pos, first = pos + 8 + n + (n & 1), False
    return end - at if pos in (end, end + 1) and not first else 0


def _tiff(data: memoryview, at: int) -> int:
    """Directories, the values that they point to, and strips or tiles."""
    order = "<" if data[at] == 0x49 else ">"
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    if len(data) < at + 8:
        return 0
    place, end, seen = struct.unpack_from(order + "I", data, at + 4)[0], 8, set()
    while place:
        if place in seen or place < 8 or at + place + 2 > len(data):
            return 0
        seen.add(place)
        n = struct.unpack_from(order + "H", data, at + place)[0]
        after = place + 2 + 12 * n
        if not n or at + after + 4 > len(data):
            return 0
        found: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + place + 2 + 12 * k)
            width = sizes.get(kind, 0) * count
            value = place + 2 + 12 * k + 8
            if not width:
                return 0
            if width > 4:
                value = struct.unpack_from(order + "I", data, at + value)[0]
                end = max(end, value + width)
            if at + value + width > len(data):
                return 0
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                found[tag] = list(struct.unpack_from(order + str(count) + "HI"[kind - 3], data, at + value))
        starts, lengths = found.get(273, found.get(324, [])), found.get(279, found.get(325, []))
        if not {256, 257} <= {struct.unpack_from(order + "H", data, at + place + 2 + 12 * k)[0] for k in range(n)} or len(starts) != len(lengths):
            return 0
        end = max([end, after + 4, *(a + b for a, b in zip(starts, lengths, strict=True))])
        place = struct.unpack_from(order + "I", data, at + after)[0]
    return end if seen and at + end <= len(data) else 0


def _mp4(data: memoryview, at: int) -> int:
    """Boxes one after the other; there must be a movie or a fragment of one."""
    pos, kinds = at, []
    while pos + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, pos)
        if n == 1 and pos + 16 <= len(data):
            n = struct.unpack_from(">Q", data, pos + 8)[0]
        elif n == 0:
            n = len(data) - pos
        if n < 8 or pos + n > len(data) or not kind.isalnum() or kinds and kind == b"ftyp":
            break
        kinds.append(kind)
        pos += n
    return pos - at if kinds[:1] == [b"ftyp"] and {b"moov", b"moof"} & set(kinds) else 0


# Kilobits a second by version and layer (third), and samples a second by version.
MP3_RATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _mp3(data: memoryview, at: int) -> int:
    """A tag and at least two frames of the third layer after it."""
    if len(data) < at + 10 or data[at + 3] > 4 or any(data[at + k] & 0x80 for k in range(6, 10)):
        return 0
    pos, frames = at + 10 + sum(data[at + 9 - k] << 7 * k for k in range(4)), 0
    while pos + 4 <= len(data) and data[pos] == 0xFF and data[pos + 1] & 0xE6 == 0xE2:
        version, rate, samples = data[pos + 1] >> 3 & 3, data[pos + 2] >> 4, data[pos + 2] >> 2 & 3
        if version == 1 or rate in (0, 15) or samples == 3:
            break
        n = (144 if version == 3 else 72) * 1000 * MP3_RATES[3 if version == 3 else 2][rate] // MP3_SAMPLES[version][samples] + (data[pos + 2] >> 1 & 1)
        if pos + n > len(data):
            break
        pos, frames = pos + n, frames + 1
    return pos - at if frames > 1 else 0


def _inflated(data: memoryview, limit: int) -> tuple[int, int, int] | None:
    """(size, checksum, bytes used) of raw deflated data, unpacked piece by piece; None if broken or larger than ``limit``."""
    unpack, size, crc, rest = zlib.decompressobj(-15), 0, 0, data
    try:
        while not unpack.eof:
            piece = unpack.decompress(rest, PIECE)
            size, crc, rest = size + len(piece), zlib.crc32(piece, crc), unpack.unconsumed_tail
            if size > limit or not piece and not rest and not unpack.eof:
                return None
    except zlib.error:
        return None
    return size, crc, len(data) - len(unpack.unused_data)


def _entry(data: memoryview, at: int) -> int:
    """A local entry whose sizes stand before it."""
    if len(data) < at + 30:
        return 0
    flags, method, _, _, crc, packed, plain, name, extra = struct.unpack_from("<HHHHIIIHH", data, at + 6)
    body = at + 30 + name + extra
    if flags & 8 or not name or body + packed > len(data) or method not in (0, 8):
        return 0
    if method == 0:
        return body + packed - at if packed == plain and zlib.crc32(data[body : body + packed]) == crc else 0
    return body + packed - at if _inflated(data[body : body + packed], plain) == (plain, crc, packed) else 0


def _zip(data: memoryview, at: int) -> int:
    """Up to the end record whose directory names the entry here; without one, the entry alone."""
    rest = bytes(data[at:])
    end = rest.find(b"PK\x05\x06")
    while 0 <= end <= len(rest) - 22:
        entries, size, start, comment = struct.unpack_from("<HIIH", rest, end + 10)
        pos, n, first = start, 0, False
        while start + size == end and rest[pos : pos + 4] == b"PK\x01\x02" and pos + 46 <= end:
            name, extra, note = struct.unpack_from("<HHH", rest, pos + 28)
            local = struct.unpack_from("<I", rest, pos + 42)[0]
            if rest[local : local + 4] != MAGIC["zip"]:
                break
            first |= local == 0
            pos, n = pos + 46 + name + extra + note, n + 1
        if n and n == entries and pos == end and first and end + 22 + comment <= len(rest):
            return end + 22 + comment
        end = rest.find(b"PK\x05\x06", end + 1)
    return _entry(data, at)


def _gzip(data: memoryview, at: int) -> int:
    unpack, rest = zlib.decompressobj(31), data[at:]
    try:
        while not unpack.eof:
            piece = unpack.decompress(rest, PIECE)
            rest = unpack.unconsumed_tail
            if not piece and not rest and not unpack.eof:
                return 0
    except zlib.error:
        return 0
    return len(data) - at - len(unpack.unused_data)


def _pdf(data: memoryview, at: int) -> int:
    """Up to the last trailer before another header: a changed file has a trailer for each change."""
    rest = bytes(data[at:])
    other = rest.find(b"%PDF-", 1)
    end = rest.rfind(b"%%EOF", 0, other if other > 0 else len(rest))
    return end + 5 if rest[5:6].isdigit() and end > 0 and b"startxref" in rest[:end] else 0


def _flac(data: memoryview, at: int) -> int:
    if len(data) < at + 42 or data[at + 4] & 0x7F or int.from_bytes(data[at + 5 : at + 8], "big") != 34:
        return 0
    pos = at + 4
    while pos + 4 <= len(data):
        head, n = data[pos], int.from_bytes(data[pos + 1 : pos + 4], "big")
        pos += 4 + n
        if head & 0x80:
            return len(data) - at if pos + 2 <= len(data) and data[pos] == 0xFF and data[pos + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(data: memoryview, at: int) -> int:
    pos = at
    while pos + 27 <= len(data) and data[pos : pos + 4] == b"OggS" and data[pos + 4] == 0:
        n = data[pos + 26]
        body = pos + 27 + n
        end = body + sum(data[pos + 27 : body])
        if body > len(data) or end > len(data):
            return 0
        pos, last = end, data[pos + 5] & 4
        if last:
            return pos - at
    return 0


VALIDATORS: dict[str, Callable[[memoryview, int], int]] = {"wav": _wav, "webp": _webp, "jpeg": _jpeg, "tiff_le": _tiff, "tiff_be": _tiff, "mp4": _mp4, "mp3": _mp3, "png": _png, "gif87": _gif, "gif89": _gif, "bmp": _bmp, "zip": _zip, "gzip": _gzip, "pdf": _pdf, "flac": _flac, "ogg": _ogg}


class Sniffer:
    """Confirmed (offset, length, type) of the outermost media in some bytes, in order."""

    def __init__(self) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        kinds: dict[bytes, list[str]] = {}
        for kind, magic in MAGIC.items():
            kinds.setdefault(magic, []).append(kind)
        for magic, several in kinds.items():
            self._automaton.add_word(magic.decode("latin-1"), (several, len(magic)))
        self._automaton.make_automaton()

    def __call__(self, data: bytes) -> list[tuple[int, int, str]]:
        found, view, behind = [], memoryview(data), 0
        for end, (kinds, n) in self._automaton.iter(data.decode("latin-1")):
            for kind in kinds:
                at = end + 1 - n - BEHIND.get(kind, 0)
                if at >= behind and (length := VALIDATORS[kind](view, at)):
                    found.append((at, length, NAMES.get(kind, kind)))
                    behind = at + length
        return found

    def inside(self, data: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
        """The type that the first byte starts, if any, and what is embedded after or in it."""
        found = self(data)
        if not found or found[0][0]:
            return None, found
        at, length, kind = found[0]
        embedded = found[1:]
        if kind in ("wav", "bmp"):  # raw samples can hold further files
            embedded = [(a + 12, n, k) for a, n, k in self(data[12:length]) if k != kind or a] + embedded
        return kind, embedded


def sniff(df: DataFrame, column: str, declared: str | None = None) -> DataFrame:
    """``df`` with ``media_type`` (corrected), ``type_wrong`` and ``embedded`` (offset, length, type).

    Columns of these names are replaced.
    """
    kept = df.drop("media_type", "type_wrong", "embedded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", media_type string, type_wrong boolean, embedded array<struct<offset: bigint, length: bigint, type: string>>"
    embedded_type = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            seen = [sniffer.inside(v.as_py() or b"") for v in batch.column(batch.schema.get_field_index(column))]
            said = batch.column(batch.schema.get_field_index(declared)).to_pylist() if declared else [None] * len(seen)
            types = [kind for kind, _ in seen]
            columns = [pa.array(types, pa.string()), pa.array([bool(s and k and s != k) for s, k in zip(said, types, strict=True)], pa.bool_()), pa.array([[{"offset": a, "length": n, "type": k} for a, n, k in e] for _, e in seen], embedded_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "media_type", "type_wrong", "embedded"])

    return kept.mapInArrow(look, schema)


def carve(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per embedded file: ``keys``, offset, length, type and its bytes."""
    own = ("offset", "length", "type", "bytes")
    names = [f"key_{k}" if k in own else k for k in keys]
    found = sniff(df.select(*[F.col(f"`{k}`").alias(f"_key_{n}") for n, k in enumerate(keys)], F.col(f"`{column}`").alias("_value")), "_value")
    each = found.select(*[F.col(f"_key_{n}").alias(name) for n, name in enumerate(names)], "_value", F.explode("embedded").alias("_e"))
    return each.select(*[F.col(f"`{n}`") for n in names], "_e.offset", "_e.length", "_e.type", F.substring(F.col("_value"), F.col("_e.offset").cast("int") + 1, F.col("_e.length").cast("int")).alias("bytes"))


def payload(text: bytes, unit: int = 192) -> bytes:
    """The text padded with spaces to a positive multiple of ``unit`` bytes."""
    return text + b" " * (-len(text) % unit if text else unit)


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text (null: empty) as the 8-bit samples of a wav file."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(v.as_py() or "").encode() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([wav(payload(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string, n_embedded int"


def digest(media: DataFrame) -> DataFrame:
    """Reads a media column back: checks its type, then the samples' digests and features.

    ``feature``: type, mean, deviation and mean step of the samples to 4 digits, and
    what is embedded.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        names = [part.strip().split(" ")[0] for part in DIGEST.split(",")]
        for batch in batches:
            rows = []
            for doc_id, n_bytes, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = value.as_py()
                kind, embedded = sniffer.inside(data)
                if kind != "wav":
                    raise ValueError(f"document {doc_id}: the stored bytes are no wav file")
                samples = wav_samples(data)
                x = np.frombuffer(samples, np.uint8)
                step = np.abs(np.diff(x.astype(np.int16))).mean()
                feature = f"{kind};mean={x.mean():.4f};std={x.std():.4f};step={step:.4f};embedded={','.join(k for *_, k in embedded)}"
                rows.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature, kind, len(embedded)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)

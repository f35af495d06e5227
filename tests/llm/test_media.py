from __future__ import annotations

import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest

from lectern.llm import media as M


def png():
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def bmp():
    rows = b"\0" * 8
    return struct.pack("<2sIHHI", b"BM", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 20)
    whole = out.getvalue()
    return whole[: whole.index(b"PK\x01\x02")]


def flac():
    return b"fLaC" + b"\x80\x00\x00\x22" + b"\0" * 34 + b"\xff\xf8\0\0"


def ogg():
    return b"OggS\0\x06" + b"\0" * 20 + b"\x01\x03abc"


FILES = {"wav": M.wav(b"abc"), "png": png(), "gif": gif(), "bmp": bmp(), "zip": zipped(), "gzip": gzip.compress(b"x" * 50, mtime=0), "pdf": b"%PDF-1.4\nstartxref\n9\n%%EOF", "flac": flac(), "ogg": ogg()}


def test_types_and_carving():
    sniff = M.Sniffer()
    for kind, data in FILES.items():
        assert sniff.inside(data)[0] == kind, kind
        if kind != "flac":  # whose length is not in its header
            inside = b"some BM RIFF PK text " + data + b" and more"
            assert [(a, n, k) for a, n, k in sniff(inside)] == [(21, len(data), kind)], kind
        for cut in (1, len(data) // 2):
            assert sniff.inside(data[:-cut])[0] != kind or kind in ("flac", "pdf"), kind
    assert sniff.inside(M.wav(b"BM text " + FILES["png"]))[1] == [(44 + 8, len(FILES["png"]), "png")]


def test_prose_is_no_media():
    rng = random.Random(1)
    text = " ".join(rng.choice(["BM", "RIFF", "GIF89a", "PK\x03\x04", "%PDF-", "fLaC", "OggS", "word", "\x1f\x8b\x08"]) for _ in range(3000))
    assert M.Sniffer().inside(text.encode("latin-1")) == (None, [])


def test_declared_types_are_corrected(spark):
    rows = [(1, bytearray(FILES["png"]), "jpg"), (2, bytearray(FILES["png"]), "png"), (3, None, "png"), (4, bytearray(b""), None), (5, bytearray(b"text"), "wav")]
    out = {r["id"]: r for r in M.sniff(spark.createDataFrame(rows, "id int, data binary, declared string").selectExpr("*", "1 as embedded"), "data", "declared").collect()}
    assert [(out[k]["media_type"], out[k]["type_wrong"]) for k in range(1, 6)] == [("png", True), ("png", False), (None, False), (None, False), (None, False)]


def test_carving_out(spark):
    data = b"head " + FILES["gif"] + b" mid " + FILES["zip"]
    rows = M.carve(spark.createDataFrame([(1, bytearray(data), "x"), (2, None, "x")], "id int, data binary, type string"), "data", ["id"]).orderBy("offset").collect()
    assert [(r["id"], r["type"], bytes(r["bytes"])) for r in rows] == [(1, "gif", FILES["gif"]), (1, "zip", FILES["zip"])]


def test_round_trip_of_texts(spark, make):
    texts = [None, "", "a", "é" * 96, "x" * 192, "x" * 193, "RIFF BM " * 5000, "same", "same"]
    got = {r["doc_id"]: r for r in M.digest(M.as_media(make(list(enumerate(texts))))).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        stored = M.wav(full)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and M.wav_samples(stored) == full
    assert got[7]["feature"] == got[8]["feature"] and M.digest(M.as_media(make([]))).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["n_bytes"] for r in M.digest(M.as_media(docs)).collect()}
    assert got == {r["doc_id"]: len(r["text"].encode()) for r in docs.collect()}


def more_media():
    """Files of the formats above, made by hand or by the standard library."""
    import gzip
    import io
    import struct
    import zipfile

    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    jpeg = b"\xff\xd8" + seg(0xE0, b"JFIF\0" + bytes(9)) + seg(0xDB, bytes(65)) + seg(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 17, 0])) + seg(0xDA, bytes(6)) + b"ab\xff\x00cd\xff\xd0ef\xff\xd9"
    chunk = b"VP8L" + struct.pack("<I", 5) + b"/abcd\0"
    webp = b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body
    mp4 = box(b"ftyp", b"isom\0\0\2\0") + box(b"mdat", b"x" * 40) + box(b"moov", box(b"mvhd", bytes(20)))
    frame = b"\xff\xfb\x90\x00" + bytes(413)
    mp3 = b"ID3\3\0\0" + bytes([0, 0, 0, 5]) + b"title" + frame * 3
    tags = [(256, 3, 1, 4), (257, 3, 1, 2), (273, 4, 1, 8), (279, 4, 1, 8)]
    tiff = b"II*\0" + struct.pack("<I", 16) + b"pixels!!" + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 50)
        z.writestr("b.txt", "there")
    plain = out.getvalue()

    class Pipe(io.RawIOBase):  # can't seek, so sizes follow the entries
        def __init__(self):
            self.data = b""

        def writable(self):
            return True

        def write(self, b):
            self.data += bytes(b)
            return len(b)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello " * 50)
        z.writestr("b.txt", "there")
    pdf = b"%PDF-1.4\nx startxref 1 %%EOF\nmore startxref 9 %%EOF"
    return [("jpeg", jpeg), ("webp", webp), ("mp4", mp4), ("mp3", mp3), ("tiff", tiff), ("zip", plain), ("zip", pipe.data), ("pdf", pdf), ("gzip", gzip.compress(bytes(30_000_000)))]


@pytest.mark.parametrize("k", range(9))
def test_more_formats(k):
    kind, data = more_media()[k]
    sniffer = M.Sniffer()
    assert sniffer.inside(data) == (kind, [])
    assert sniffer.inside(b"text before " + data + b" and after") == (None, [(12, len(data), kind)])
    if kind not in ("mp3", "pdf"):
        assert sniffer(data[:-3]) == [] or kind == "zip" and sniffer(data[:-3])[0][1] < len(data)


def test_all_in_a_row():
    files = more_media()
    data = b"-".join(d for _, d in files)
    assert [k for _, _, k in M.Sniffer()(data)] == [k for k, _ in files]


def test_magic_words_in_prose_are_nothing():
    assert M.Sniffer()(b"BM RIFF ID3 ftyp II*\0 MM\0* PK\3\4 %PDF- \xff\xd8\xff GIF89a OggS fLaC \x1f\x8b\x08 " * 20) == []


def test_carve_keeps_clashing_keys(spark):
    kind, data = more_media()[0]
    rows = spark.createDataFrame([(5, "t", b"xx" + data)], "offset int, type string, media binary")
    out = M.carve(rows, "media", ["offset", "type"])
    assert out.columns == ["key_offset", "key_type", "offset", "length", "type", "bytes"]
    r = out.first()
    assert (r["key_offset"], r["offset"], r["type"], bytes(r["bytes"])) == (5, 2, kind, data)

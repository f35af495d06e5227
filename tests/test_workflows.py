from __future__ import annotations

import json

import numpy as np
import pytest

from lectern import __main__ as cli
from lectern.operators import kernels
from lectern.plans import workflows as W
from lectern.sources import png


def log(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n", encoding="utf-8")


def record(image, status="ok", text="", **more):
    return {"input_path": f"/data/sample_set/test/1/2/{image}.jpg", "relative_input_path": f"test/1/2/{image}.jpg", "status": status, "text": text} | more


@pytest.fixture
def data(tmp_path):
    names = "page_key,split,writer_id,page_id,image_index,image_path,vocab_id,ground_truth_text,word_label_path,page_label_path"
    rows = [f"test_1_2,test,1,2,{k},x/sample_set/test/1/2/{k}.jpg,{k},{t},w,p" for k, t in ((1, "abcd"), (2, "two  words"), (10, "ten"))]
    (tmp_path / "manifest.csv").write_text("\n".join([names, *rows]) + "\n", encoding="utf-8")
    log(tmp_path / "runs/one/raw/results.jsonl", [record(1, text="abxd"), record(1, "error"), "{broken", "", record(2, text="two words"), record(10, "empty_output"), record(99, text="out")])
    log(tmp_path / "runs/two/raw/results.jsonl", [record(1, text="abcd"), record(2, "error"), record(2, text="two wards")])
    return tmp_path


def test_evaluate(spark, data):
    tables = W.evaluate(spark, str(data / "runs"), str(data / "manifest.csv"), str(data / "out"))
    rows = {r["configuration"]: r for r in tables["summary"].collect()}
    one, two = rows["one/raw"], rows["two/raw"]
    assert (one["completed_records"], one["exact_matches"], one["empty_outputs"], one["completed_pages"]) == (3, 1, 1, 1)
    assert one["corpus_cer"] == (1 + 0 + 3) / (4 + 9 + 3) and one["corpus_wer"] == (1 + 0 + 1) / 4
    assert (two["completed_records"], two["coverage"], two["partial_pages"]) == (2, 2 / 3, 1)
    page = tables["pages"].where("configuration = 'one/raw'").first()
    assert (page["ground_truth_text"], page["prediction_text"]) == ("abcd two words ten", "abxd two words")
    assert "CONFIGURATION 2:" in (data / "out/report.txt").read_text()


def test_compare(spark, data):
    one, two = (str(data / f"runs/{k}/raw/results.jsonl") for k in ("one", "two"))
    tables = W.compare(spark, one, two, "one", "two", str(data / "manifest.csv"), str(data / "cmp"))
    words = {r["image"]: r for r in tables["words"].collect()}
    assert set(words) == {"1", "2", "10", "99"}
    assert words["1"]["review_reason"] == "one_missing_or_error;one_empty;agreement_below_threshold"
    assert words["2"]["agreement_score"] > 0.85 and not words["2"]["human_review"]
    assert words["10"]["review_reason"] == "two_missing_or_error;both_empty;agreement_below_threshold"
    summary = json.loads((data / "cmp/summary.json").read_text())
    assert (summary["compared_word_regions"], summary["flagged_pages"], summary["input_kind"]) == (4, 1, "raw")
    whole = W.compare(spark, one, two, "one", "two", complete_only=True)
    assert whole["words"].count() == 0 and whole["excluded"].count() == 1 and whole["summary"].first()["total_pages_for_human_review"] == 1
    with pytest.raises(ValueError):
        W.compare(spark, one, two, "one", "two", limit=1, sample=1)


def test_review_pages(spark, data):
    page = W.review_pages(spark, str(data / "runs/one/raw/results.jsonl"), str(data / "manifest.csv"), str(data / "rev"), limit=5).first()
    assert page["ocr_regions"] == ["[OCR_MISSING]", "two words", "[OCR_MISSING]", "out"]
    assert json.loads((data / "rev/selection.json").read_text()) == {"limit": 5, "selected": 1}


def test_ground_truth(spark, tmp_path):
    (tmp_path / "img/test/1/2").mkdir(parents=True)
    (tmp_path / "img/test/1/2/1.jpg").write_bytes(b"x")
    (tmp_path / "m.tsv").write_text("image_path\tvocab_id\tlabel\ntest/1/2/1.jpg\t7\tone\ntest/1/2/2.jpg\t8\ttwo\nodd\t9\tx\n", encoding="utf-8")
    tables = W.ground_truth(spark, str(tmp_path / "m.tsv"), str(tmp_path / "img"), str(tmp_path / "gt"))
    assert {(r["image_path"], r["issue"]) for r in tables["issues"].collect()} == {("test/1/2/2.jpg", "missing_image"), ("odd", "malformed_path")}
    assert (tmp_path / "gt/labels/pages/test_1_2.txt").read_text() == "one\ntwo\n"
    assert (tmp_path / "gt/labels/words/test_1_2/2.txt").read_text() == "two\n"


def picture():
    image = np.full((120, 260), 235, np.uint8)
    image[50:58, 40:220] = 20
    return image


def test_images_from_folder_to_folder(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/1.png").write_bytes(png.encode(picture(), 300))
    (tmp_path / "in/a/2.png").write_bytes(b"broken")
    done = {r["relative"]: r for r in W.prepare_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), kernels.Settings(strength=0)).collect()}
    assert done["a/1.png"]["status"] == "ok" and done["a/2.png"]["status"] == "error"
    pixels, dpi = png.decode((tmp_path / "out/a/1.png").read_bytes())
    assert set(np.unique(pixels)) == {0, 255} and abs(dpi - 300) < 0.1
    tables = W.corpus_profile(spark, str(tmp_path / "in"))
    assert tables["unreadable"].first()[0] == 1
    assert tuple(tables["sizes"].first())[:3] == (260, 120, 1)
    row = tables["statistics"].where("measure = 'brightness'").first()
    assert row["mean"] == pytest.approx(picture().mean()) and row["std"] == 0.0
    (tmp_path / "in/a/1.PNG").write_bytes(b"x")
    with pytest.raises(ValueError):
        W.prepare_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def write_jpeg(spark, path, pixels, turn=None, dpi=None):
    """By the JVM; the header parts are added by hand."""
    import struct

    awt, height, width = spark._jvm.java.awt.image, *pixels.shape[:2]
    image = awt.BufferedImage(width, height, awt.BufferedImage.TYPE_INT_RGB)
    for y in range(height):
        for x in range(width):
            image.setRGB(x, y, int(pixels[y, x]) * 0x010101)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(path)))
    data = path.read_bytes()
    if dpi:
        at = data.index(b"JFIF\0")
        data = data[: at + 7] + struct.pack(">BHH", 1, dpi, dpi) + data[at + 12 :]
    if turn:
        tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, turn, 0, 0)
        body = b"Exif\0\0" + tiff
        data = data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]
    path.write_bytes(data)


def test_jpeg_files_are_profiled_and_prepared(spark, tmp_path):
    (tmp_path / "in/a b").mkdir(parents=True)
    write_jpeg(spark, tmp_path / "in/a b/1.jpg", picture(), dpi=300)
    write_jpeg(spark, tmp_path / "in/a b/2.JPG", picture().T, turn=6, dpi=300)
    (tmp_path / "in/a b/3.jpg").write_bytes(b"broken")
    (tmp_path / "in/4.png").write_bytes(png.encode(picture(), 300))
    tables = W.corpus_profile(spark, str(tmp_path / "in"))
    assert {r["file_type"]: r["n"] for r in tables["types"].collect()} == {"jpg": 3, "png": 1}
    assert [tuple(r)[:3] for r in tables["sizes"].collect()] == [(260, 120, 2), (120, 260, 1)]
    assert tables["unreadable"].first()[0] == 1
    row = tables["statistics"].where("measure = 'brightness'").first()
    assert row["n"] == 3 and abs(row["mean"] - picture().mean()) < 1
    for kind, suffix in W.SUFFIXES.items():
        done = {r["relative"]: r for r in W.prepare_folder(spark, str(tmp_path / "in"), str(tmp_path / kind), kernels.Settings(strength=0), "binarize", kind).collect()}
        assert {k: r["status"] for k, r in done.items()} == {"a b/1.jpg": "ok", "a b/2.JPG": "ok", "a b/3.jpg": "error", "4.png": "ok"}
        assert done["a b/3.jpg"]["error"] and done["4.png"]["error"] is None
        shapes = [png.decode((tmp_path / kind / f"{stem}{suffix}").read_bytes())[0].shape for stem in ("a b/1", "a b/2", "4")]
        assert shapes[0] == shapes[2] == ((120, 530) if kind == "test" else (120, 260))
        assert shapes[1] == shapes[0]  # turned by a quarter


@pytest.mark.parametrize("turn", range(1, 9))
def test_orientations(turn):
    from lectern.sources import jpeg

    # where the first row and column of the stored picture are to be seen, by number
    edges = {1: "top left", 2: "top right", 3: "bottom right", 4: "bottom left", 5: "left top", 6: "right top", 7: "right bottom", 8: "left bottom"}
    stored = np.zeros((4, 6), np.uint8)
    stored[0, :], stored[:, 0] = 1, 2
    stored[0, 0] = 3
    seen = jpeg.upright(stored, turn)
    side = {"top": seen[0], "bottom": seen[-1], "left": seen[:, 0], "right": seen[:, -1]}
    row, column = edges[turn].split()
    assert set(side[row].tolist()) == {1, 3} and set(side[column].tolist()) == {2, 3}


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (6, 5, 3)).astype(np.int64)
    lines = []
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        row, up = image[y].reshape(-1), image[y - 1].reshape(-1) if y else np.zeros(15, np.int64)
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, up[:-3]]
        paeth = [min((a, b, c), key=lambda v, p=a + b - c: abs(p - v)) for a, b, c in zip(left, up, corner, strict=True)]
        guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: np.array(paeth)}[kind]
        lines.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (png.decode(data)[0] == image).all()


def test_command_line():
    args = cli.parser().parse_args(["compare", "a", "b", "--model-a", "x", "--model-b", "y", "--output-dir", "o", "--sample-pages", "3"])
    assert cli._chosen(args) == {"limit": None, "sample": 3, "keys": None, "seed": 42} and args.review_threshold == 0.7

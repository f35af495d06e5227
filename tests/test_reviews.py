"""Review and recognition runs with recorded answers, interrupted and resumed."""

from __future__ import annotations

import json

import pytest

from lectern.plans import reviews as R
from lectern.plans import workflows as W

WORDS = {1: ["one", "twoo", ""], 2: ["three", "four"], 3: ["five"]}


@pytest.fixture
def log(tmp_path):
    rows = [{"input_path": f"/data/sample_set/test/1/{p}/{k}.jpg", "relative_input_path": f"test/1/{p}/{k}.jpg", "status": "ok" if t else "empty_output", "text": t} for p, words in WORDS.items() for k, t in enumerate(words, 1)]
    path = tmp_path / "runs/results.jsonl"
    path.parent.mkdir(parents=True)
    path.write_text("\n".join(map(json.dumps, rows)) + "\n", encoding="utf-8")
    return str(path)


USAGE = {"input_tokens": 10, "output_tokens": 3, "total_tokens": 13}
ERRORS = {
    "test_1_1": {"errors": [{"region_index": 2, "error": "twoo", "correction": "two", "reason": "double letter"}, {"region_index": 2, "error": "twoo", "correction": "two", "reason": "again"}, {"region_index": 9, "error": "x", "correction": "y", "reason": "nowhere"}], "usage": USAGE},
    "test_1_2": {"errors": [], "usage": None},
    "test_1_3": {"errors": [{"region_index": 1, "error": "five", "correction": "five", "reason": "same"}], "usage": USAGE},
}
FLUENCY = {
    "test_1_1": {"score": 2, "reason": "r", "error_examples": ["twoo", "twoo", "[OCR_MISSING]", "absent"], "usage": USAGE},
    "test_1_2": {"score": 5, "reason": "r", "error_examples": [], "usage": USAGE},
    "test_1_3": {"score": 9, "reason": "out of range", "error_examples": [], "usage": USAGE},
}


def asked(folder, answers, broken=()):
    """Plays answers back and leaves a mark for every question; broken pages fail."""
    folder.mkdir(exist_ok=True)

    def factory():
        def answer(row):
            (folder / f"{row['page_key']}-{len(list(folder.iterdir()))}").write_text(row["prompt"])
            if row["page_key"] in broken:
                raise RuntimeError("connection lost")
            return answers[row["page_key"]]

        return answer

    return factory


def marks(folder):
    return sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir())


def test_errors_are_resumed_and_checked(spark, log, tmp_path):
    out = str(tmp_path / "errors")
    first = R.review_run(spark, R.ERRORS, log, asked(tmp_path / "m1", ERRORS, {"test_1_2"}), out)
    summary = first["summary"].first()
    assert (summary["successful_pages"], summary["failures_this_run"], summary["processed_this_run"], summary["resumed_pages"]) == (2, 1, 3, 0)
    second = R.review_run(spark, R.ERRORS, log, asked(tmp_path / "m2", ERRORS), out)
    assert marks(tmp_path / "m2") == ["test_1_2"]  # only what was not answered
    summary = json.loads((tmp_path / "errors/run_summary.json").read_text())
    assert (summary["successful_pages"], summary["resumed_pages"], summary["failures_this_run"]) == (3, 2, 0)
    assert (summary["total_detected_errors"], summary["total_rejected_detections"], summary["median_detected_errors_per_page"]) == (1, 3, 0.0)
    assert summary["usage"] == {"input_tokens": 20, "output_tokens": 6, "total_tokens": 26}
    rows = {r["page_key"]: r for r in second["results"].collect()}
    assert [d["correction"] for d in rows["test_1_1"]["detections"]] == ["two"] and rows["test_1_2"]["detections"] == []
    assert rows["test_1_1"]["formatted_corrections"] == ["region 2: twoo → two (double letter)"]
    assert (rows["test_1_1"]["flagged_region_rate"], rows["test_1_1"]["missing_word_rate"]) == (0.5, 1 / 3)
    third = R.review_run(spark, R.ERRORS, log, asked(tmp_path / "m3", ERRORS), out, prompt_version="2", keys=["test_1_3"])
    assert marks(tmp_path / "m3") == ["test_1_3"] and third["summary"].first()["resumed_pages"] == 0  # another question
    R.review_run(spark, R.ERRORS, log, asked(tmp_path / "m4", ERRORS), out, overwrite=True, limit=2)
    assert marks(tmp_path / "m4") == ["test_1_1", "test_1_2"]


def test_a_run_that_breaks_off_keeps_its_batches(spark, log, tmp_path, monkeypatch):
    from lectern.sources import sinks

    out, real, calls = str(tmp_path / "fluency"), sinks.append_jsonl, []

    def once(rows, path):
        if calls:
            raise KeyboardInterrupt
        calls.append(path)
        real(rows, path)

    monkeypatch.setattr(sinks, "append_jsonl", once)
    with pytest.raises(KeyboardInterrupt):
        R.review_run(spark, R.FLUENCY, log, asked(tmp_path / "m1", FLUENCY), out, batch_pages=1)
    monkeypatch.setattr(sinks, "append_jsonl", real)
    before = {r["page_key"] for r in R.stored(spark, f"{out}/answers", R.STORED).collect()}
    done = R.review_run(spark, R.FLUENCY, log, asked(tmp_path / "m2", FLUENCY), out, batch_pages=1)
    assert set(marks(tmp_path / "m2")) == set(FLUENCY) - before
    summary = done["summary"].first()
    assert (summary["successful_pages"], summary["mean_score"], summary["total_rejected_error_examples"]) == (2, 3.5, 3)
    assert summary["score_counts"].asDict() == {"1": 0, "2": 1, "3": 0, "4": 0, "5": 1}
    row = done["results"].where("page_key = 'test_1_1'").first()
    assert row["error_examples"] == ["twoo"]


def test_compare_joins_side_results(spark, log, tmp_path):
    R.review_run(spark, R.ERRORS, log, asked(tmp_path / "m1", ERRORS), str(tmp_path / "errors"))
    R.review_run(spark, R.FLUENCY, log, asked(tmp_path / "m2", FLUENCY), str(tmp_path / "fluency"))
    made = W.compare(spark, log, log, "one", "two", fluency=(str(tmp_path / "fluency/results"), None), errors=(None, str(tmp_path / "errors/results")))
    rows = {r["page_key"]: r for r in made["combined"].collect()}
    one = rows["test_1_1"]
    assert (one["model_a_fluency_score"], one["model_b_fluency_score"], one["model_b_detected_errors"], one["model_a_detected_errors"]) == (2, None, 1, None)
    assert one["model_b_combined_failure_rate"] == 2 / 3 and rows["test_1_3"]["model_a_fluency_score"] is None
    assert "combined" not in W.compare(spark, log, log, "one", "two")


def test_recognition_is_resumed(spark, tmp_path):
    for name in ("test/1/2/1.png", "test/1/2/2.jpg", "test/1/3/1.png"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(name.encode())

    def reader(broken):
        def factory():
            def read(row):
                if row["relative"] == broken:
                    raise RuntimeError("no memory")
                if row["relative"].endswith("jpg"):
                    return {"blocks": [{"html": "<p>b&amp;c</p>", "reading_order": 2, "skipped": False, "error": False}, {"html": "<p>తెలుగు</p>", "reading_order": 1, "skipped": False, "error": False}]}
                return {"text": bytes(row["content"]).decode()}

            return read

        return factory

    out = str(tmp_path / "out")
    first = {r["relative"]: r for r in R.recognition_run(spark, str(tmp_path / "in"), reader("test/1/3/1.png"), out).collect()}
    assert {k: r["status"] for k, r in first.items()} == {"test/1/2/1.png": "empty_output", "test/1/2/2.jpg": "ok", "test/1/3/1.png": "error"}
    assert first["test/1/2/2.jpg"]["text"] == "తెలుగు" and first["test/1/2/1.png"]["suspicious_output"]
    assert (tmp_path / "out/texts/test/1/2/2.txt").read_text() == "తెలుగు\n"
    second = {r["relative"]: r for r in R.recognition_run(spark, str(tmp_path / "in"), reader(None), out, letters="a-z", script="latin").collect()}
    assert second["test/1/3/1.png"]["text"] == "test png" and second["test/1/2/2.jpg"]["written_at"] == first["test/1/2/2.jpg"]["written_at"]
    with pytest.raises(ValueError):
        R.recognition_run(spark, str(tmp_path / "in"), reader(None), out, first_page=7, last_page=7)

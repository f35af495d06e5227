from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.operators import agreement, logs, metrics, profile, review, truth


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_latest_in_three_ways(spark):
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "error"), ("b", 1, "error"), ("b", 2, "empty_output"), ("c", 1, None)], "k string, pos int, status string")
    last = lambda mode: {r["k"]: r["status"] for r in logs.latest(log, ["k"], mode=mode).collect()}
    assert last("completed") == {"a": "ok", "b": "empty_output"}
    assert last("any") == {"a": "error", "b": "empty_output", "c": None}
    assert last("ok") == {"a": "ok"}
    with pytest.raises(ValueError):
        logs.latest(log, ["k"], mode="first")


def test_malformed_lines_are_counted_once(spark):
    lines = spark.createDataFrame([('{"input_path": "test/1/2/3.png", "status": "ok", "psm": "eight"}',), ("{bad",), ("  ",), ('{"input_path": "x.png", "status": "error"}',)], "value string")
    assert logs.quality_counts(logs.parse_lines(lines)).first().asDict() == {"lines": 3, "malformed": 1, "unmapped": 1, "not_completed": 1}


def test_input_kind_and_guard(spark):
    frame = lambda *paths: spark.createDataFrame([(p,) for p in paths], "input_path string")
    kind = lambda df: logs.input_kind(df).first()[0]
    raw, processed = frame("/a/sample_set/1.png"), frame("/a/Processed_x/1.png", "/processed/sample_set/2.png")
    assert [kind(x) for x in (raw, processed, frame("/a/sample_set/1.png", "/b/1.png"), frame())] == ["raw", "processed", "mixed", "mixed"]
    with pytest.raises(ValueError):
        logs.check_same_kind(raw, processed)
    assert logs.check_same_kind(raw, processed, allow=True) == "raw_vs_processed"


def test_review_reasons(spark):
    schema = "split string, writer_id string, page_id string, image string, page_key string, input_path string, status string, text string"
    key = ("t", "1", "1")
    a = spark.createDataFrame([(*key, "1", "t_1_1", "p", "error", ""), (*key, "2", "t_1_1", "p", "ok", "x"), (*key, "3", "t_1_1", "", "ok", "same")], schema)
    b = spark.createDataFrame([(*key, "2", "t_1_1", "q", "empty_output", ""), (*key, "3", "t_1_1", "q3", "ok", " same ")], schema)
    inventory = a.select("split", "writer_id", "page_id", "image", "page_key", F.lit("inv").alias("image_path"))
    pairs = agreement.aligned(a, b, inventory, ["split", "writer_id", "page_id", "image"])
    words = agreement.words(pairs, "a", "b")
    assert rows(words.select("image", "review_reason", "agreement_score", "source_image_path")) == [
        ("1", "a_missing_or_error;b_missing_or_error;both_empty;agreement_below_threshold", 0.0, "p"),
        ("2", "b_empty;agreement_below_threshold", 0.0, "p"),
        ("3", "", 1.0, "q3"),
    ]
    same = agreement.words(pairs, "m", "m").where("image = '1'").first()["review_reason"]
    assert same == "m_missing_or_error;both_empty;agreement_below_threshold"
    page = agreement.pages(words, order="image").first()
    assert (page["model_a_text"], page["model_b_text"], page["flagged_word_regions"], page["review_reason"]) == ("x same", "same", 2, "word_regions_flagged;incomplete_page")
    with pytest.raises(ValueError):
        agreement.words(pairs, "a", "b", threshold=1.5)


def test_combined_report_blanks_the_rate(spark):
    pages = spark.createDataFrame([("p", 0.25, 0.75)], "page_key string, model_a_missing_word_rate double, model_b_missing_word_rate double")
    none = spark.createDataFrame([], "page_key string, score int, reason string")
    errors = spark.createDataFrame([], "page_key string, detected_error_count int, flagged_region_count int, expected_words int, missing_or_error_words int")
    row = agreement.combined(pages, {"a": none, "b": none}, {"a": errors, "b": errors}).first()
    assert row["model_a_missing_word_rate"] is None and row["model_b_missing_word_rate"] is None
    some = spark.createDataFrame([("p", 1, 2, 4, 4), ("q", 0, 0, 0, 0)], errors.schema)
    assert rows(agreement.error_rates(some).select("page_key", "flagged_region_rate", "missing_word_rate", "combined_failure_rate")) == [("p", 0.0, 1.0, 1.5), ("q", 0.0, 0.0, 0.0)]


def test_page_building_marks_what_is_missing(spark):
    keys = "split string, writer_id string, page_id string, image string"
    latest = spark.createDataFrame([("t", "1", "2", "10", "ok", " a  b "), ("t", "1", "2", "2", "error", "z"), ("t", "1", "2", "3", "empty_output", "")], f"{keys}, status string, text string")
    inventory = spark.createDataFrame([("t", "1", "2", str(k)) for k in (2, 3, 4, 10)] + [("t", "9", "9", "1")], keys)
    page = review.build_pages(latest, inventory).collect()
    assert len(page) == 1
    assert page[0]["ocr_regions"] == ["[OCR_MISSING]"] * 3 + ["a b"]
    assert (page[0]["completed_words"], page[0]["expected_words"], page[0]["missing_or_error_words"]) == (2, 4, 3)


def test_detections(spark):
    e = "array<struct<region_index: int, error: string, correction: string, reason: string>>"
    found = [(1, "ab", "cd", "r"), (9, "ab", "cd", "r"), (1, "ab", "ab", "r"), (1, " ab ", "cd", "again"), (1, "[OCR_MISSING]", "x", "r"), (2, "ab", "cd", "r"), (0, "ab", "cd", "r"), (2, "x", "y", "")]
    answers = spark.createDataFrame([("p", ["xx ab", "[OCR_MISSING]"], found)], f"page_key string, ocr_regions array<string>, errors {e}")
    checked = review.valid_detections(answers)
    assert [r["accepted"] for r in checked.orderBy("position").collect()] == [True] + [False] * 7
    assert review.formatted_corrections(checked).first()["formatted_corrections"] == ["region 1: ab → cd (r)"]


def test_selection(spark):
    pages = spark.createDataFrame([(f"t_{w}_{p}", "t", str(w)) for w in (2, 10) for p in range(3)], "page_key string, split string, writer_id string")
    assert [r["page_key"] for r in review.select_pages(pages, limit=4).collect()] == ["t_2_0", "t_2_1", "t_2_2", "t_10_0"]
    sample = [r["writer_id"] for r in review.select_pages(pages, sample=4).collect()]
    assert sorted(sample) == ["10", "10", "2", "2"]
    assert review.select_pages(pages, sample=99).count() == 6
    assert [r["page_key"] for r in review.select_pages(pages, keys=["t_10_2", "t_2_0", "t_10_2"]).collect()] == ["t_10_2", "t_2_0"]
    for bad in ({"limit": 0}, {"sample": 0}, {"limit": 1, "sample": 1}, {"keys": ["no"]}):
        with pytest.raises(ValueError):
            review.select_pages(pages, **bad)


def test_statistics(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double")
    assert rows(profile.describe(frame, "v", ("k",)).select("k", "n", "std")) == [("a", 1, 0.0), ("b", 2, 2**0.5)]
    assert tuple(profile.describe(frame.limit(0), "v").first()) == (0, None, None, None, None)
    medians = spark.createDataFrame([(x,) for x in (1, 2, 4, 9)], "v int")
    assert review.mean_median(medians, "v").first()["median"] == 3.0
    fluency = spark.createDataFrame([(1,)] * 2 + [(2,)] * 37 + [(3,)], "score int")
    assert tuple(review.mean_median(fluency, "score").first()) == (1.975, 2.0)
    assert rows(review.score_histogram(fluency)) == [(1, 2), (2, 37), (3, 1), (4, 0), (5, 0)]


def test_corpus_rates_are_not_means(spark):
    done = spark.createDataFrame([("c", "k1", "p", "ok", "ab"), ("c", "k2", "p", "ok", "wxyzwxyz")], "configuration string, k string, input_path string, status string, text string")
    manifest = spark.createDataFrame([("g", "k1", "1", "xy"), ("g", "k2", "2", "wxyzwxyz"), ("g", "k3", "3", "q")], "page_key string, k string, image string, ground_truth_text string")
    words = metrics.word_metrics(done, manifest, ["k"])
    row = metrics.summary(words, metrics.page_metrics(words, manifest, ("configuration",)), manifest).first()
    assert (row["corpus_cer"], row["mean_word_cer"], row["coverage"], row["exact_accuracy"], row["partial_pages"]) == (0.2, 0.5, 2 / 3, 0.5, 1)


def test_ground_truth_issues_and_order(spark):
    given = spark.createDataFrame([("/d/test/1/2/3.jpg", "4", "w"), ("bad.png", "", ""), ("val/1/2/10.jpg", "5", " "), ("train/1/2/2.jpg", "6", "z")], "image_path string, vocab_id string, label string")
    there = given.where("image_path like '%3.jpg'").select("image_path")
    issues = {(r["image_path"], r["issue"]) for r in truth.row_issues(given, there).collect()}
    assert issues == {("bad.png", "malformed_path"), ("bad.png", "empty_label"), ("bad.png", "missing_vocab_id"), ("val/1/2/10.jpg", "missing_image"), ("val/1/2/10.jpg", "empty_label"), ("train/1/2/2.jpg", "missing_image")}
    kept = truth.in_order(truth.manifest(given)).collect()
    assert [r["page_key"] for r in kept] == ["train_1_2", "test_1_2"]


def test_scale_and_ranks(spark):
    from lectern.operators.ranking import global_rank

    frame = spark.createDataFrame([(50, 600.0), (200, 150.0), (200, None), (200, -1.0)], "w int, dpi double")
    assert [(r["scale"], r["dpi_valid"]) for r in profile.scale_factor(frame, "w", "dpi").collect()] == [(2.0, True), (2.0, True), (1.0, False), (1.0, False)]
    ranked = global_rank(spark.range(50).withColumn("g", F.col("id") % 4), [F.col("g")], [F.col("id")])
    assert [r["id"] for r in ranked.orderBy("rank").collect()] == sorted(range(50), key=lambda k: (k % 4, k))
    assert [r["rank"] for r in ranked.orderBy("rank").collect()] == list(range(1, 51))
    nulls = global_rank(spark.createDataFrame([(None, 2), ("a", 1), (None, 1)], "g string, id int"), [F.col("g")], [F.col("id")])
    assert [(r["g"], r["id"]) for r in nulls.orderBy("rank").collect()] == [(None, 1), (None, 2), ("a", 1)]

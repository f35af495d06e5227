"""Runs that ask an outside recogniser or model and can be interrupted and resumed.

Work that has a stored answer to the same question is not asked again.  Answers are appended
in batches, each committed whole, so an interrupted run loses one batch at most.  Checked
records, tables and a summary come from the stored answers alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import html
from lectern.functions import text as T
from lectern.operators import agreement, logs, review
from lectern.plans.workflows import KEYS, records
from lectern.sources import files, recognisers, sinks

USAGE = "usage struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint>"
PAGE = "page_key string, split string, writer_id string, page_id string, ocr_regions array<string>, ocr_text string, completed_words bigint, expected_words bigint, missing_or_error_words bigint"
#: What a stored answer must share with the question to count.
SAME = ("page_key", "ocr_regions", "source_results", "model", "prompt_version")
STORED = f"{PAGE}, source_results string, model string, prompt_version string, prompt string, written_at bigint, status string, error string, elapsed_seconds double"


@dataclass(frozen=True)
class Review:
    """A kind of question about pages: the answer's columns, and what is made of them."""

    answer: str
    checked: Callable[[DataFrame], DataFrame]
    totals: Callable[[DataFrame], DataFrame]


def _counts(answers: DataFrame, counted: DataFrame, names: Sequence[str]) -> DataFrame:
    return answers.join(counted, "page_key", "left").na.fill(0, list(names))


def _fluency(answers: DataFrame) -> DataFrame:
    """The answers with their accepted examples; a score outside 1 to 5 makes an error of the answer."""
    each = review.valid_examples(answers.select("page_key", "ocr_regions", F.col("error_examples").alias("examples")))
    kept = each.groupBy("page_key").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("accepted"), F.struct("position", "example")))), lambda x: x["example"]).alias("accepted_examples"), F.count_if(~F.col("accepted")).alias("rejected_error_example_count"))
    joined = _counts(answers, kept, ["rejected_error_example_count"])
    return joined.withColumn("error_examples", F.coalesce("accepted_examples", F.array().cast("array<string>"))).drop("accepted_examples").where(F.col("score").between(1, 5))


def _fluency_totals(checked: DataFrame) -> DataFrame:
    numbers = [F.count_if(F.col("score") == k).cast("bigint").alias(str(k)) for k in range(1, 6)]
    return checked.agg(F.avg("score").alias("mean_score"), F.median("score").alias("median_score"), F.struct(*numbers).alias("score_counts"), F.coalesce(F.sum("rejected_error_example_count"), F.lit(0)).alias("total_rejected_error_examples"))


def _errors(answers: DataFrame) -> DataFrame:
    """The answers with their accepted detections, in order, and their counts."""
    each = review.valid_detections(answers.select("page_key", "ocr_regions", "errors"))
    found = F.struct("position", "region_index", "error", "correction", "reason")
    kept = each.where("accepted").groupBy("page_key").agg(F.array_sort(F.collect_list(found)).alias("detections"))
    joined = _counts(answers.drop("errors").join(kept, "page_key", "left"), review.detection_totals(each), ["detected_error_count", "rejected_detection_count", "flagged_region_count"])
    joined = joined.join(review.formatted_corrections(each), "page_key", "left")
    fields = lambda d: F.struct(*[d[n].alias(n) for n in ("region_index", "error", "correction", "reason")])
    return joined.withColumn("detections", F.coalesce(F.transform("detections", fields), F.array().cast("array<struct<region_index: int, error: string, correction: string, reason: string>>")))


def _error_totals(checked: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return checked.agg(total("detected_error_count").alias("total_detected_errors"), total("rejected_detection_count").alias("total_rejected_detections"), F.avg("detected_error_count").alias("mean_detected_errors_per_page"), F.median("detected_error_count").alias("median_detected_errors_per_page"))


FLUENCY = Review(f"score int, reason string, error_examples array<string>, {USAGE}", _fluency, _fluency_totals)
ERRORS = Review(f"errors array<struct<region_index: int, error: string, correction: string, reason: string>>, {USAGE}", _errors, _error_totals)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier runs have appended; nothing where there was none."""
    return spark.read.schema(schema).json(path) if _there(spark, path) else spark.createDataFrame([], schema)


def review_run(
    spark: SparkSession, kind: Review, log: str, factory: Callable[[], recognisers.Recogniser], out: str, inventory_csv: str | None = None, *,
    model: str = "model", prompt_version: str = "1", input_kind: str = "auto", overwrite: bool = False, batch_pages: int = 500, partitions: int | None = None, dry_run: bool = False, **choice: object,
) -> dict[str, DataFrame]:
    """Asks about the chosen pages of a log what ``out`` does not answer yet.

    Gives pages (the selection), results (one checked record per answered page, as in ``out/results``), table
    and summary (also as ``out/run_summary.json``).  With ``dry_run`` only the pages.
    """
    latest = logs.latest(records(files.read_log(spark, log), False), KEYS)
    inventory = files.read_inventory(spark, inventory_csv).select("key.*").distinct() if inventory_csv else latest.select(*KEYS)
    available = review.build_pages(latest, inventory)
    pages = review.select_pages(available, **choice)
    if dry_run:
        return {"pages": pages}
    if input_kind == "auto":
        input_kind = logs.input_kind(latest).first()["input_kind"]
    names = [part.strip().split(" ")[0] for part in PAGE.split(", ")]
    work = pages.select(*names).withColumns({"source_results": F.lit(log), "model": F.lit(model), "prompt_version": F.lit(prompt_version), "prompt": T.numbered("ocr_regions")})
    sinks.write_json(f"{out}/selection.json", {**choice, "source_results": log, "selected": pages.count()})
    place, schema = f"{out}/answers", f"{STORED}, {kind.answer}"
    known = stored(spark, place, schema)
    resumed, pending = (0, work) if overwrite else (logs.resumed(work, known, SAME).count(), logs.pending(work, known, SAME))
    pending = spark.createDataFrame(pending.toArrow(), pending.schema) if (n_pending := pending.count()) <= batch_pages else pending
    began = spark.sql("select unix_micros(current_timestamp())").first()[0]
    batches = max(1, -(-n_pending // batch_pages))
    for k in range(batches if n_pending else 0):
        mine = pending.where(F.pmod(F.xxhash64("page_key"), F.lit(batches)) == k) if batches > 1 else pending
        answers = recognisers.apply(mine.withColumn("written_at", F.lit(began + k)), factory, kind.answer, partitions)
        sinks.append_jsonl(answers, place)
    given = stored(spark, place, schema)
    good = logs.latest(given.where("status = 'ok'").join(work.select(*SAME), list(SAME), "left_semi"), ["page_key"], "written_at")
    checked = kind.checked(good).withColumns({"input_kind": F.lit(input_kind), "missing_word_rate": F.when(F.col("expected_words") > 0, F.col("missing_or_error_words") / F.col("expected_words")).otherwise(0.0)})
    if kind is ERRORS:
        checked = checked.join(agreement.error_rates(checked).select("page_key", "flagged_region_rate", "combined_failure_rate"), "page_key")
    sinks.rebuild_jsonl(checked, f"{out}/results", ["page_key"])
    results = spark.read.schema(checked.schema).json(f"{out}/results")
    failures = given.where((F.col("written_at") >= began) & (F.col("status") != "ok")).count()
    usage = review.usage_totals(results)
    facts = {"available_pages": available.count(), "selected_pages": pages.count(), "resumed_pages": resumed, "processed_this_run": n_pending, "failures_this_run": failures, "input_kind": input_kind, "evaluator_model": model}
    summary = kind.totals(results).crossJoin(results.agg(F.count("*").alias("successful_pages"))).crossJoin(usage.select(F.struct("*").alias("usage")))  # one row each
    summary = summary.withColumns({k: F.lit(v) for k, v in facts.items()})
    table = results.drop("ocr_regions", "ocr_text", "prompt")
    sinks.write_csv(table, f"{out}/table")
    sinks.write_json(f"{out}/run_summary.json", summary.first().asDict(recursive=True))
    return {"pages": pages, "results": results, "table": table, "summary": summary}


RECOGNISED = "relative string, input_path string, written_at bigint, status string, error string, elapsed_seconds double, text string, suspicious_output boolean, suspicious_reason string"
BLOCKS = "text string, blocks array<struct<html: string, reading_order: int, skipped: boolean, error: boolean>>"


def recognition_run(spark: SparkSession, root: str, factory: Callable[[], recognisers.Recogniser], out: str, *, first_page: int | None = None, last_page: int | None = None, overwrite: bool = False, letters: str = T.TELUGU, script: str = "telugu", partitions: int | None = None) -> DataFrame:
    """Recognises the images below ``root`` that ``out/results`` has no finished record of; gives the latest record of each.

    The recogniser gets relative, path and content and answers with ``text`` or with ``blocks`` of HTML.  A
    record has the cleaned text and whether it looks wrong; each finished text is also a file of its own in ``out/texts``.
    """
    images = files.find_images(spark, root, files.RECOGNISER_IMAGES, derived=True, content=True)
    if first_page is not None and last_page is not None:
        images = files.page_range(images, first_page, last_page)
    place = f"{out}/results"
    if not overwrite:
        done = stored(spark, place, RECOGNISED).where(T.completed("status"))
        images = images.join(done.select("relative").distinct(), "relative", "left_anti")
    began = spark.sql("select unix_micros(current_timestamp())").first()[0]
    answers = recognisers.apply(images.select("relative", F.col("path").alias("input_path"), "content"), factory, BLOCKS, partitions)
    read = T.normalize(F.coalesce(F.nullif("text", F.lit("")), html.response_text(F.coalesce("blocks", F.array().cast("array<struct<html: string, reading_order: int, skipped: boolean, error: boolean>>")))))
    ok = F.col("status") != "error"
    flagged = answers.withColumn("found", T.script_flags(read, letters, script=script))
    rows = flagged.select("relative", "input_path", F.lit(began).alias("written_at"), F.when(ok, T.output_status("found.text")).otherwise("error").alias("status"), "error", "elapsed_seconds", F.when(ok, F.col("found.text")).otherwise("").alias("text"), F.when(ok, F.col("found.suspicious_output")).alias("suspicious_output"), F.when(ok, F.col("found.suspicious_reason")).alias("suspicious_reason"))
    sinks.append_jsonl(rows, place)
    given = stored(spark, place, RECOGNISED)
    fresh = given.where((F.col("written_at") == began) & T.completed("status"))
    sinks.write_texts(fresh.withColumn("file", T.output_path("relative", "texts", ".txt")), out, "file", "text")
    return logs.latest(given, ["relative"], "written_at")

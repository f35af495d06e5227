"""From files to files: the engine's entry points over a folder of logs, tables or images.

Each takes paths and parameters, reads with :mod:`lectern.sources`, computes with
:mod:`lectern.operators` and writes with the sinks; the tables are also returned.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import agreement, kernels, logs, metrics, profile, review, truth
from lectern.sources import files, jpeg, png, sinks

KEYS = ("split", "writer_id", "page_id", "image")
SUMMARY = ("configuration", "completed_records", "coverage", "completed_pages", "partial_pages", "empty_outputs", "exact_matches", "exact_accuracy", "mean_word_cer", "mean_word_wer", "mean_page_cer", "mean_page_wer", "corpus_cer", "corpus_wer")


def records(parsed: DataFrame, strict: bool, extra: Sequence[str] = ()) -> DataFrame:
    """Log lines as key columns, page_key, input_path, status, text, suspicious_output, pos."""
    key = T.record_image_key("record.relative_input_path", "record.input_path", strict)
    rows = parsed.where("not malformed").withColumn("key", key).where("key is not null")
    return rows.select(*extra, "key.*", "pos", "record.input_path", "record.status", "record.text", F.coalesce("record.suspicious_output", F.lit(False)).alias("suspicious_output")).withColumn("page_key", T.page_key())


def evaluate(spark: SparkSession, results: str, manifest_csv: str, out: str | None = None) -> dict[str, DataFrame]:
    """Word, page and summary tables of every configuration below ``results``, in one pass over all logs.

    The last completed record of an image counts; images outside the manifest don't.
    """
    manifest = files.read_manifest(spark, manifest_csv).select("key.*", T.page_key("key.split", "key.writer_id", "key.page_id").alias("page_key"), "ground_truth_text", "image_path")
    parsed = files.read_configurations(spark, results)
    done = logs.latest(records(parsed, True, ("configuration",)).drop("page_key"), ["configuration", *KEYS], mode="completed")
    words = metrics.word_metrics(done, manifest, KEYS)
    pages = metrics.page_metrics(words, manifest, ("configuration",))
    tables = {"words": words, "pages": pages, "summary": metrics.summary(words, pages, manifest)}
    if out:
        for name, table in tables.items():
            sinks.write_csv(table, f"{out}/{name}")
        sinks.write_report(f"{out}/report.txt", tables["summary"].orderBy("configuration"), SUMMARY)
    return tables


FLUENCY_SIDE = "page_key string, status string, score int, reason string"
ERROR_SIDE = "page_key string, status string, detected_error_count bigint, flagged_region_count bigint, expected_words bigint, missing_or_error_words bigint"


def side_results(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """The last successful record of each page in a review's log; none without a log."""
    if path is None:
        return spark.createDataFrame([], schema)
    rows = files.read_log(spark, path, schema).where("not malformed").select("path", "pos", "record.*").where("page_key <> ''")
    return logs.latest(rows.withColumn("at", F.struct("path", "pos")), ["page_key"], "at", mode="ok").drop("path", "pos", "at")


def compare(spark: SparkSession, log_a: str, log_b: str, model_a: str, model_b: str, inventory_csv: str | None = None, out: str | None = None, threshold: float = agreement.THRESHOLD, complete_only: bool = False, allow_mismatched: bool = False, fluency: tuple[str | None, str | None] = (None, None), errors: tuple[str | None, str | None] = (None, None), **choice) -> dict[str, DataFrame]:
    """Word, page, unpaired and excluded tables and a summary of two logs.

    The last record of an image counts whatever its status.  Pages are chosen before
    anything is scored; ``choice`` is that of :func:`lectern.operators.review.select_pages`.
    ``fluency`` and ``errors`` are logs of both models' reviews; where any is given there is also a
    combined table, in which pages without a review keep nulls.
    """
    a, b = (logs.latest(records(files.read_log(spark, path), False), KEYS) for path in (log_a, log_b))
    kind = logs.check_same_kind(a, b, allow_mismatched)
    if inventory_csv:
        inventory = files.read_inventory(spark, inventory_csv).select("key.*", "image_path").dropDuplicates(list(KEYS)).withColumn("page_key", T.page_key())
    else:
        inventory = a.limit(0).select(*KEYS, F.col("input_path").alias("image_path"), "page_key")
    pairs = agreement.aligned(a, b, inventory, KEYS)
    done = agreement.completeness(pairs)
    excluded = done.where("not complete").drop("complete").withColumn("review_reason", F.lit("incomplete_page_excluded_by_complete_pages_only"))
    if complete_only:
        pairs = pairs.join(done.where("complete").select("page_key"), "page_key", "left_semi")
    else:
        excluded = excluded.limit(0)
    if any(v is not None for v in choice.values()):
        chosen = review.select_pages(pairs.select("page_key", "split", "writer_id").distinct(), **choice)
        pairs = pairs.join(chosen.select("page_key"), "page_key", "left_semi")
    words = agreement.words(pairs, model_a, model_b, threshold).withColumn("input_kind", F.lit(kind))
    pages = agreement.pages(words, "image", threshold)
    unpaired = logs.pages_unpaired(a, b, model_a, model_b)
    tables = {"words": words, "review": words.where("human_review"), "pages": pages, "unpaired": unpaired, "excluded": excluded}
    if any((*fluency, *errors)):
        tables["combined"] = agreement.combined(pages, {s: side_results(spark, path, FLUENCY_SIDE) for s, path in zip("ab", fluency, strict=True)}, {s: side_results(spark, path, ERROR_SIDE) for s, path in zip("ab", errors, strict=True)})
    tables["summary"] = agreement.summary(words, pages, unpaired.count(), excluded.count())
    if out:
        for name, table in tables.items():
            sinks.write_csv(table, f"{out}/{name}")
        sinks.write_json(f"{out}/summary.json", {"model_a": model_a, "model_b": model_b, "input_kind": kind, "review_threshold": threshold, **tables["summary"].first().asDict()})
    return tables


def review_pages(spark: SparkSession, log: str, inventory_csv: str | None = None, out: str | None = None, **choice) -> DataFrame:
    """Chosen pages with their ordered regions; the selection is written beside them."""
    latest = logs.latest(records(files.read_log(spark, log), False), KEYS)
    inventory = files.read_inventory(spark, inventory_csv).select("key.*").distinct() if inventory_csv else latest.select(*KEYS)
    pages = review.select_pages(review.build_pages(latest, inventory), **choice)
    if out:
        sinks.write_by_page(pages, f"{out}/pages")
        sinks.write_json(f"{out}/selection.json", {**choice, "selected": pages.count()})
    return pages


def ground_truth(spark: SparkSession, mapping_tsv: str, image_root: str, out: str) -> dict[str, DataFrame]:
    """The manifest in order, page and word labels, and a row for every issue."""
    rows = files.read_mapping(spark, mapping_tsv)
    images = files.find_images(spark, image_root)
    issues = truth.row_issues(rows, images.select(F.col("relative").alias("image_path")))
    manifest = truth.manifest(rows)
    sinks.write_csv(truth.in_order(manifest), f"{out}/manifest", one_file=True)
    sinks.write_csv(issues, f"{out}/warnings")
    sinks.write_texts(manifest, out, "word_label_path", "ground_truth_text")
    labels = truth.page_labels(manifest).withColumn("path", F.concat(F.lit("labels/pages/"), "page_key", F.lit(".txt")))
    sinks.write_texts(labels, out, "path", "labels")
    return {"manifest": manifest, "issues": issues}


def _pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """The decoder's bytes as an image: grey, or red, green, blue and alpha if there."""
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image[..., 0] if channels == 1 else image[..., [2, 1, 0, *range(3, channels)]]


def corpus_profile(spark: SparkSession, root: str, top: int = 10, limit: int | None = None) -> dict[str, DataFrame]:
    """File types, the commonest sizes, brightness, contrast and blur of the images below ``root``.

    Unreadable images are counted and left out.  Every image is decoded once, by the JVM; the tables come from
    one kept row of numbers per image.
    """
    images = files.with_pixels(spark, root, files.find_images(spark, root, limit=limit).select("path", "relative"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, height, width, channels, data in frame.itertuples(index=False):
                if data is None:  # an unreadable image is counted
                    rows.append((path, None, None, None, None, None))
                    continue
                grey = kernels.flatten_alpha(_pixels(int(height), int(width), int(channels), data)).astype(np.float64)
                wide = np.pad(grey, 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey, 1, mode="edge")
                edges = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * grey
                rows.append((path, grey.shape[1], grey.shape[0], grey.mean(), grey.std(), edges.var()))
            out = pd.DataFrame(rows, columns=["relative", "width", "height", "brightness", "contrast", "blur"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    measured = images.select("relative", "height", "width", "nChannels", "data").mapInPandas(measure, "relative string, width int, height int, brightness double, contrast double, blur double").persist(StorageLevel.DISK_ONLY)
    seen = measured.where("width is not null")
    names = ("width", "height", "brightness", "contrast", "blur")
    long = seen.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])).alias("v")).select("v.*")
    grid = spark.createDataFrame([(n,) for n in names], "measure string")
    statistics = grid.join(profile.describe(long, "value", ("measure",)), "measure", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return {"types": profile.file_types(files.find_images(spark, root, derived=True), "relative").orderBy("file_type"), "sizes": profile.most_common(seen, ("width", "height"), "relative", top), "statistics": statistics, "unreadable": measured.agg(F.count_if(F.col("width").isNull()).alias("unreadable"))}


#: Single stages by name; each takes an image, the settings and the resolution.
STAGES: dict[str, Callable[[np.ndarray, kernels.Settings, float | None], np.ndarray]] = {
    "standardize": lambda image, s, dpi: kernels.standardize(image, dpi, s),
    "crop": lambda image, s, _: kernels.crop(image, s, 0),
    "contrast": lambda image, s, _: kernels.enhance(image, s.factor),
    "denoise": lambda image, s, _: kernels.denoise(image, s),
    "deskew": lambda image, s, _: kernels.deskew(image, s.max_skew),
    "border": lambda image, s, _: kernels.crop(image, s, s.border),
    "binarize": lambda image, s, _: kernels.binarize(image),
    "all": lambda image, s, dpi: kernels.prepare(image, s, dpi),
}
SUFFIXES = {"image": ".png", "after": ".after.png", "test": ".test.png"}


def side_by_side(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Both images on white, top edges level, ten pixels apart."""
    out = np.full((max(before.shape[0], after.shape[0]), before.shape[1] + 10 + after.shape[1]), 255, np.uint8)
    out[: before.shape[0], : before.shape[1]] = before
    out[: after.shape[0], before.shape[1] + 10 :] = after
    return out


def prepare_folder(spark: SparkSession, root: str, out: str, settings: kernels.Settings = kernels.Settings(), stage: str = "all", kind: str = "image") -> DataFrame:
    """Runs a stage over every image below ``root`` and writes PNG files under the same names in ``out``.

    PNG files are decoded here; JPEG and others by the JVM, turned as their headers say.  ``kind`` is
    ``image``, ``after`` (the same under ``.after.png``) or ``test`` (before and after side by side).  Two inputs for one
    output are an error before anything runs; a broken image is a row with its error.  The
    statuses are those of a finished run.
    """
    work_on, suffix = STAGES[stage], SUFFIXES[kind]
    listed = files.find_images(spark, root).withColumn("output", T.output_path("relative", out.rstrip("/"), suffix))
    twice = truth.collisions(listed, "relative", "output").head(1)
    if twice:
        raise ValueError(f"two images would be written to {twice[0]['output']}")
    headers = files.find_images(spark, root, content=True).select("path", "relative", F.lower("relative").rlike(r"\.png$").alias("is_png"), "content")

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, relative, content in frame[["path", "relative", "content"]].itertuples(index=False):
                try:
                    rows.append((path, relative, *jpeg.describe(bytes(content))))
                except (ValueError, struct.error):
                    rows.append((path, relative, 1, None))
            yield pd.DataFrame(rows, columns=["path", "relative", "turn", "dpi"])

    def done(relative: str, image: Callable[[], tuple[np.ndarray, float | None]]) -> tuple[str, bytes | None, str | None]:
        try:
            pixels, dpi = image()
            before = kernels.flatten_alpha(pixels)
            after = work_on(before, settings, dpi)
            return relative, png.encode(side_by_side(before, after) if kind == "test" else after, settings.dpi), None
        except Exception as problem:  # noqa: BLE001  one bad image is one row
            return relative, None, f"{type(problem).__name__}: {problem}"

    def own(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([done(r, lambda c=c: png.decode(bytes(c))) for r, c in frame.itertuples(index=False)], columns=["relative", "body", "problem"])

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def decoded(height: float, width: float, channels: float, data: bytes | None, turn: int, dpi: float) -> tuple[np.ndarray, float | None]:
            if data is None:
                raise ValueError("unreadable")
            return jpeg.upright(_pixels(int(height), int(width), int(channels), data), int(turn)), None if dpi != dpi else dpi

        for frame in frames:
            yield pd.DataFrame([done(row[0], lambda row=row: decoded(*row[1:])) for row in frame.itertuples(index=False)], columns=["relative", "body", "problem"])

    schema = "relative string, body binary, problem string"
    told = headers.where("not is_png").mapInPandas(tell, "path string, relative string, turn int, dpi double")
    ready = headers.where("is_png").select("relative", "content").mapInPandas(own, schema)
    ready = ready.unionByName(files.with_pixels(spark, root, told).select("relative", "height", "width", "nChannels", "data", "turn", "dpi").mapInPandas(others, schema))
    name = lambda: F.ltrim(T.output_path("relative", "", suffix), F.lit("/"))
    written = sinks.put_files(ready.select(name().alias("path"), F.col("body").alias("content"), F.col("problem").alias("error")), out)
    return listed.select("relative", "output", name().alias("path")).join(written, "path").drop("path")

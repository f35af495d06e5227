"""Append logs: one record per key, resume, and set comparison of logs.

The latest record comes in three kinds that differ where a later attempt failed:
filter first and take the last (``completed``), take the last whatever its status
(``any``), or filter on plain success (``ok``).  The window keeps at most one row per key
and partition before its exchange, so repeated attempts hardly cost a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.schemas import RECOGNITION

MODES = ("completed", "any", "ok")


def latest(log: DataFrame, keys: Sequence[str], pos: str = "pos", mode: str = "any") -> DataFrame:
    """The record with the greatest ``pos`` of each key; see the module for the modes."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode == "completed":
        log = log.where(T.completed("status"))
    elif mode == "ok":
        log = log.where(F.col("status") == "ok")
    order = Window.partitionBy(*keys).orderBy(F.col(pos).desc())
    return log.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def parse_lines(lines: DataFrame, schema: str = RECOGNITION, line: str = "value") -> DataFrame:
    """Non-blank lines with ``record`` and ``malformed``; a malformed line has a null record.

    A line is malformed if it is no JSON; a field of another type is null.
    """
    lines = lines.where(F.trim(line) != "")
    bad = F.try_parse_json(line).isNull()
    return lines.withColumn("malformed", bad).withColumn("record", F.when(~bad, F.from_json(line, schema)))


def quality_counts(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """One row: lines, malformed, unmapped (no image key) and not completed ones."""
    key = T.record_image_key("record.relative_input_path", "record.input_path", strict)
    good = ~F.col("malformed")
    return parsed.agg(
        F.count("*").alias("lines"),
        F.count_if("malformed").alias("malformed"),
        F.count_if(good & key.isNull()).alias("unmapped"),
        F.count_if(good & ~T.completed("record.status")).alias("not_completed"),
    )


def in_manifest(log: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.join(manifest.select(*keys).distinct(), list(keys), "left_semi")


def not_in_manifest(log: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.join(manifest.select(*keys).distinct(), list(keys), "left_anti")


def resumed(work: DataFrame, stored: DataFrame, same: Sequence[str]) -> DataFrame:
    """Work whose stored response is valid: ok, and equal in every column of ``same``."""
    return work.join(stored.where("status = 'ok'").select(*same).distinct(), list(same), "left_semi")


def pending(work: DataFrame, stored: DataFrame, same: Sequence[str]) -> DataFrame:
    return work.join(stored.where("status = 'ok'").select(*same).distinct(), list(same), "left_anti")


def pages_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page_key").intersect(b.select("page_key"))


def pages_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page_key").union(b.select("page_key")).distinct()


def pages_unpaired(a: DataFrame, b: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Pages that only one log has, and which one lacks them."""
    left = a.select("page_key").distinct().withColumn("present_in_model_a", F.lit(True))
    right = b.select("page_key").distinct().withColumn("present_in_model_b", F.lit(True))
    both = left.join(right, "page_key", "full_outer").na.fill(False)
    lacking = F.when(F.col("present_in_model_a"), model_b).otherwise(model_a)
    return both.where(F.col("present_in_model_a") != F.col("present_in_model_b")).withColumn("review_reason", F.concat(F.lit("missing_entire_page_from_"), lacking))


def input_kind(log: DataFrame, path: str = "input_path") -> DataFrame:
    """One row: processed if a folder of every path says so, else raw if every path is in the sample set, else mixed."""
    processed = F.exists(F.split(F.coalesce(F.col(path), F.lit("")), "/"), lambda p: F.contains(F.lower(p), F.lit("processed")))
    raw = F.contains(F.coalesce(F.col(path), F.lit("")), F.lit("sample_set"))
    return log.agg(F.every(processed).alias("p"), F.every(raw).alias("r")).select(F.when(F.col("p"), "processed").when(F.col("r"), "raw").otherwise("mixed").alias("input_kind"))


def check_same_kind(a: DataFrame, b: DataFrame, allow: bool = False) -> str:
    """The common input kind, or both where ``allow`` is set."""
    kind_a, kind_b = (input_kind(x).first()["input_kind"] for x in (a, b))
    if kind_a != kind_b and not allow:
        raise ValueError(f"input kinds differ: {kind_a} and {kind_b}")
    return kind_a if kind_a == kind_b else f"{kind_a}_vs_{kind_b}"

"""Corpus profile: counts, histograms and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def describe(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation (0 for one value), least and greatest; all null for none."""
    spread = F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), spread.alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def most_common(rows: DataFrame, keys: Sequence[str], position: str, k: int = 10) -> DataFrame:
    """The k most frequent values; those seen first come first among equals."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(k)


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("value")).agg(F.count("*").alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("value").agg(F.sum("n").alias("n"))


def file_types(paths: DataFrame, path: str = "path") -> DataFrame:
    """Counts of file types; files without one are ``none``."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return paths.groupBy(F.coalesce(F.nullif(kind, F.lit("")), F.lit("none")).alias("file_type")).agg(F.count("*").alias("n"))


def scale_factor(rows: DataFrame, width: str, dpi: str, target_dpi: int = 300, min_width: int = 100) -> DataFrame:
    """How far an image is enlarged: up to the target resolution and the least width, never below 1."""
    valid = F.col(dpi).isNotNull() & (F.col(dpi) > 0)
    by_dpi = F.when(valid & (F.col(dpi) < target_dpi), F.lit(float(target_dpi)) / F.col(dpi)).otherwise(1.0)
    by_width = F.when(F.col(width) < min_width, F.lit(float(min_width)) / F.col(width)).otherwise(1.0)
    scaled = rows.withColumns({"dpi_valid": F.coalesce(valid, F.lit(False)), "scale": F.greatest(by_dpi, by_width, F.lit(1.0))})
    return scaled.withColumn("new_width", F.bround(F.col(width) * F.col("scale")).cast("int"))

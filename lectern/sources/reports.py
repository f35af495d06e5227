"""Text reports of blocks ``CONFIGURATION n:`` with ``name: value`` lines, read as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"^\s*CONFIGURATION\s+\d+\s*:"
FIELD = r"^\s*([A-Za-z_ ]+?)\s*:\s*(.*?)\s*$"


def parse_report(lines: DataFrame, fields: Sequence[str], report: str | None = None) -> DataFrame:
    """One row per block of (pos, value) lines; a block begins at its header and ends before the next.

    ``report``: a column that tells reports apart; the running block number is taken
    within each, so many reports are read side by side.
    """
    by = [report] if report else []
    order = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_block", F.sum(F.when(F.col("value").rlike(HEADER), 1).otherwise(0)).over(order)).where("_block > 0")
    named = marked.select(*by, "_block", F.lower(F.replace(F.regexp_extract("value", FIELD, 1), F.lit(" "), F.lit("_"))).alias("f"), F.regexp_extract("value", FIELD, 2).alias("v"))
    return named.groupBy(*by, "_block").agg(*[F.max(F.when(F.col("f") == name, F.col("v"))).alias(name) for name in fields]).drop("_block")

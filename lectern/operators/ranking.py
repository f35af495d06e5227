"""Positions in a global order without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(rows: DataFrame, groups: Sequence[Column], within: Sequence[Column], name: str = "rank") -> DataFrame:
    """``name``: position by ``groups``, then ``within``.

    Only the groups' counts meet in one task; rows are ranked inside their groups.
    """
    keys = [f"_g{k}" for k in range(len(groups))]
    keyed = rows.withColumns(dict(zip(keys, groups, strict=True)))
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(k).alias(f"_of{k}") for k in keys], before.alias("_start"))
    ranked = keyed.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys).orderBy(*within)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys])  # null groups have ranks too
    placed = ranked.join(starts, same).withColumn(name, (F.col("_start") + F.col("_inner")).cast("int"))
    return placed.drop(*keys, *[f"_of{k}" for k in keys], "_start", "_inner")

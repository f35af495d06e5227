"""Outside recognisers and models as pluggable sources.

A recogniser is a factory: called once per partition, it gives a function from one row
to a dictionary.  Failures become rows with status ``error``, so a job never stops for
one image or page.  Nothing here talks to a network by itself.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Recogniser = Callable[[dict], dict]


def apply(rows: DataFrame, factory: Callable[[], Recogniser], answer: str, partitions: int | None = None) -> DataFrame:
    """The columns of ``rows`` with status, error, elapsed_seconds and the ``answer`` columns (a DDL string).

    ``partitions`` bounds how many recognisers run at a time.
    """
    names = StructType.fromDDL(answer).names
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", status string, error string, elapsed_seconds double, {answer}"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognise = None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                began = time.monotonic()
                try:
                    recognise = recognise or factory()
                    found, status, error = recognise(row), None, None
                    status = found.get("status", "ok")
                except Exception as problem:  # noqa: BLE001  one bad row is one row
                    found, status, error = {}, "error", f"{type(problem).__name__}: {problem}"
                out.append({**row, "status": status, "error": error, "elapsed_seconds": time.monotonic() - began} | {n: found.get(n) for n in names})
            yield pd.DataFrame(out, columns=[*frame.columns, "status", "error", "elapsed_seconds", *names])

    return (rows.repartition(partitions) if partitions else rows).mapInPandas(work, schema)


def recorded(answers: dict[str, dict], key: str = "page_key") -> Callable[[], Recogniser]:
    """A recogniser that plays back recorded answers."""

    def factory() -> Recogniser:
        def answer(row: dict) -> dict:
            return answers[row[key]]

        return answer

    return factory

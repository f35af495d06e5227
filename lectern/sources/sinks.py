"""Sinks.  Tables are published by Spark's commit protocol; small reports by renaming a finished file."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _publish(path: str, content: str) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.write(content)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str, value: Mapping) -> None:
    """A small document, indented."""
    _publish(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """Nulls are blank, arrays and structs are JSON texts, booleans true and false."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in rows.schema]
    out = rows.select(*flat)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Adds finished records to a log; an earlier run's files stay."""
    rows.write.mode("append").json(path)


def rebuild_jsonl(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    rows.orderBy(*order).write.mode("overwrite").json(path)


def write_by_page(rows: DataFrame, path: str, page: str = "page_key") -> None:
    """One folder of JSON per page."""
    rows.write.mode("overwrite").partitionBy(page).json(path)


def put_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes a file per row (path, content, error) below ``root`` and gives back (path, status, error), finished and stored.

    ``root`` is a folder that all executors share, or a URI that they can write to.  Each file appears
    whole, by renaming, so a task that runs again does no harm.  A row with an error writes nothing and keeps it.
    The job runs once, here: the result is read from the table of statuses in ``root/_written``.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = (pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root))
        for batch in batches:
            out: list[tuple[str, str, str | None]] = []
            for name, body, problem in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if problem is not None:
                    out.append((name, "error", problem))
                    continue
                try:
                    folder, _, last = f"{base.rstrip('/')}/{name}".rpartition("/")
                    store.create_dir(folder, recursive=True)
                    part = f"{folder}/.{last}.{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as stream:
                        stream.write(body.as_buffer())
                    store.move(part, f"{folder}/{last}")
                    out.append((name, "ok", None))
                except OSError as failure:
                    out.append((name, "error", str(failure)))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "status", "error"])

    written = f"{root.rstrip('/')}/_written/{uuid.uuid4().hex}"
    rows.select("path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")), "error").mapInArrow(put, "path string, status string, error string").write.parquet(written)
    return rows.sparkSession.read.parquet(written)


def write_texts(rows: DataFrame, root: str, path: str = "relative", text: str = "text") -> DataFrame:
    """One text file per row; see :func:`put_files`."""
    ready = rows.select(F.col(path).alias("path"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("content"), F.lit(None).cast("string").alias("error"))
    done = put_files(ready, root)
    broken = done.where("status = 'error'").select("error").limit(1).collect()
    if broken:
        raise OSError(broken[0]["error"])
    return done


def write_report(path: str, rows: DataFrame, fields: Sequence[str], failures: Sequence[str] = ()) -> None:
    """Blocks ``CONFIGURATION n:`` of one row each, then failures; for a table of configurations."""
    lines: list[str] = []
    for n, row in enumerate(rows.select(*fields).collect(), 1):
        lines += [f"CONFIGURATION {n}:", *[f"  {f}: {'' if row[f] is None else row[f]}" for f in fields], ""]
    if failures:
        lines += ["FAILURES:", *[f"  {f}" for f in failures], ""]
    _publish(path, "\n".join(lines))

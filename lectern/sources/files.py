"""File sources: images by folder, logs, manifests, label files, page keys.

Discovery reads file metadata only: the content column is pruned unless it is used.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.logs import parse_lines
from lectern.schemas import MANIFEST, RECOGNITION, SELECTED_MAPPING

# Suffixes by use.
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "webp", "gif")
RECOGNISER_IMAGES = ("jpg", "jpeg", "png")
#: Paths of some hundred bytes each.
BROADCAST_PATHS = 500_000


def _listing(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``, whatever scheme the reader put before it."""
    return F.regexp_replace(path, "^.*?" + "".join("\\" + c if c in "\\.[]{}()*+?^$|" else c for c in root.rstrip("/").removeprefix("file:")) + "/", "")


def _chosen(files: DataFrame, root: str, limit: int | None, content: bool) -> DataFrame:
    """path, relative and length in natural order; with ``content`` in no order, so that no file's bytes are sorted."""
    found = files.select("path", _relative(F.col("path"), root).alias("relative"), "length")
    if limit is not None:
        found = found.orderBy(T.natural_key("relative"), "relative").limit(limit)
    elif not content:
        found = found.orderBy(T.natural_key("relative"), "relative")
    if not content:
        return found
    if limit is None:
        return files.select("path", _relative(F.col("path"), root).alias("relative"), "length", "content")
    return files.select("path", "content").join(found, "path").select("path", "relative", "length", "content")


def find_images(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGES, derived: bool = False, any_case: bool = True, limit: int | None = None, content: bool = False) -> DataFrame:
    """path, relative, length of images below ``root`` in natural order, or with their content in no order.

    Without ``derived``, stems that end in ``.after`` or ``.test`` are left out.  With a
    limit the first in natural order are taken, so the choice is the same each time.
    """
    files = _listing(spark, root)
    name = F.lower("path") if any_case else F.col("path")
    files = files.where(name.rlike(rf"\.({'|'.join(suffixes)})$"))
    if not derived:
        files = files.where(~F.col("path").rlike(r"\.(after|test)\.[^./]+$"))
    return _chosen(files, root, limit, content)


def find_pngs(spark: SparkSession, root: str, any_case: bool = True, content: bool = False) -> DataFrame:
    """PNG files without side-by-side ``.test`` outputs; case-sensitive discovery keeps ``.after`` ones."""
    files = _listing(spark, root)
    name = F.lower("path") if any_case else F.col("path")
    return _chosen(files.where(name.rlike(r"\.png$") & ~F.col("path").rlike(r"\.test\.[^./]+$")), root, None, content)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images (origin, height, width, nChannels, mode, data); unreadable ones have a null size.

    The JVM's decoders know JPEG, PNG of every kind, GIF, BMP and TIFF.
    """
    return spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root).select("image.*").withColumn("readable", F.col("height") > 0)


def with_pixels(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """The images of ``chosen`` (path and other columns, not their content) with height, width, nChannels, data; null where unreadable.

    Paths are few bytes each: up to ``BROADCAST_PATHS`` they go to the images, beyond the images are dealt out by path.
    """
    paths = chosen.withColumn("_path", _plain_path("path"))
    if paths.count() <= BROADCAST_PATHS:
        paths = F.broadcast(paths)
    pixels = read_images(spark, root).select(_plain_path("origin").alias("_path"), *[F.when(F.col("readable"), F.col(c)).alias(c) for c in ("height", "width", "nChannels", "data")])
    return pixels.join(paths, "_path").drop("_path")


def _plain_path(path: str) -> Column:
    """Without scheme and escapes: readers differ in them."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))


def page_folders(files: DataFrame, path: str = "relative") -> DataFrame:
    """Distinct page folders three levels deep, of file paths ``split/writer/page/file``."""
    return files.select(F.regexp_extract(path, r"^([^/]+/[^/]+/[^/]+)/[^/]+$", 1).alias("folder")).where("folder <> ''").distinct()


def page_range(files: DataFrame, first: int, last: int, path: str = "relative") -> DataFrame:
    """Files of the pages numbered first to last; an absent page is an error."""
    numbered = files.withColumn("page", F.regexp_extract(path, r"([0-9]+)/[^/]+$", 1).try_cast("int"))
    chosen = numbered.where(F.col("page").between(first, last))
    have = {r["page"] for r in chosen.select("page").distinct().collect()}  # at most last - first + 1 rows
    absent = sorted(set(range(first, last + 1)) - have)
    if absent:
        raise ValueError(f"no such pages: {absent[:10]}")
    return chosen


def numbered_lines(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, pos, value) of text files, pos from 1; a byte order mark is dropped.

    Files are read in splits.  Lines of a split follow each other in a task, so their number there is known
    without a shuffle; only a row per split, its count of lines, is summed up over a file's splits.
    """
    lines = spark.read.option("recursiveFileLookup", True).options(**options).text(path)
    lines = lines.select("value", _plain_path("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("path", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    numbered = lines.join(splits, ["path", "block"]).withColumn("pos", F.col("row") + F.col("shift"))
    return numbered.select("path", "pos", F.when(F.col("pos") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")).alias("value"))


def read_log(spark: SparkSession, path: str, schema: str = RECOGNITION) -> DataFrame:
    """JSON lines with their position: path, pos, value, malformed, record."""
    return parse_lines(numbered_lines(spark, path), schema)


def read_configurations(spark: SparkSession, root: str) -> DataFrame:
    """Every results.jsonl below ``root`` in one read, with its configuration's fields."""
    lines = numbered_lines(spark, root, pathGlobFilter="results.jsonl")
    return parse_lines(lines.withColumn("c", T.config_fields(_relative(F.col("path"), root))).select("c.*", "path", "pos", "value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with normalised texts; a path that is no image key is an error."""
    rows = spark.read.csv(path, schema=MANIFEST, header=True, multiLine=True, escape='"')
    key = T.image_key_strict("image_path")
    checked = F.when(key.isNull(), F.raise_error(F.concat(F.lit("no image path: "), F.coalesce("image_path", F.lit(""))))).otherwise(key)
    return rows.withColumn("key", checked).withColumn("ground_truth_text", T.normalize("ground_truth_text"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Image paths whose key can be told; nothing else is read."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select("image_path")
    return rows.withColumn("key", T.image_key_lenient("image_path")).where("key is not null")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated mapping; its three columns must be there."""
    header = spark.read.csv(path, sep="\t", header=True)
    lacking = {"image_path", "vocab_id", "label"} - set(header.columns)
    if lacking:
        raise ValueError(f"missing columns: {sorted(lacking)}")
    return header.select(*[c.split()[0] for c in SELECTED_MAPPING.split(", ")])


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """vocab_id (the line's number) and label; an empty vocabulary or entry is an error."""
    lines = numbered_lines(spark, path).select(F.col("pos").cast("bigint").alias("vocab_id"), F.trim("value").alias("label"))
    facts = lines.agg(F.count("*").alias("n"), F.count_if(F.col("label") == "").alias("empty")).first()
    if not facts["n"] or facts["empty"]:
        raise ValueError("the vocabulary is empty or has empty entries")
    return lines


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, label) of ``path label`` lines; a repeated image is an error."""
    pattern = r"^(\S+)\s+(.*)$"
    rows = numbered_lines(spark, path).where(F.trim("value") != "").select(F.regexp_extract("value", pattern, 1).alias("image_path"), F.trim(F.regexp_extract("value", pattern, 2)).alias("label"))
    twice = rows.groupBy("image_path").count().where("count > 1").limit(10).collect()
    if twice:
        raise ValueError(f"repeated images: {[r['image_path'] for r in twice]}")
    return rows


def read_responses(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Stored responses, one JSON file each; broken files are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt").json(root)
    return rows.where("_corrupt is null").drop("_corrupt")


def read_page_keys(path: str) -> list[str]:
    """Page keys of a JSON list, of an object with page_keys, or of a table's first column; each once, in order."""
    content = Path(path).read_text(encoding="utf-8")
    if path.lower().endswith(".json"):
        value = json.loads(content)
        value = value.get("page_keys", []) if isinstance(value, dict) else value
        if not isinstance(value, list):
            raise ValueError("page keys are a list")
        keys = [str(k).strip() for k in value]
    else:
        keys = [line.strip().split(",")[0].strip() for line in content.splitlines()]
        keys = [k for k in keys if k.lower() != "page_key" and not k.startswith("#")]
    return list(dict.fromkeys(k for k in keys if k))

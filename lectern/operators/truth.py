"""Ground truth: labels by position, checks of a mapping, the manifest's order and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# What can be wrong with a row, in this order.
ISSUES = ("malformed_path", "missing_image", "empty_label", "missing_vocab_id")
PATH = r"^(?:.*/)?([^/]+)/([0-9]+)/([0-9]+)/([0-9]+)\.jpg$"


class MappingError(ValueError):
    """The ground truth contradicts itself."""


def by_position(images: DataFrame, lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Image number to the page's label line to the vocabulary's entry.

    ``images``: page_key, image_index; ``lines``: page_key, image_index, vocab_id (text);
    ``vocabulary``: vocab_id (bigint), label.
    """
    numbered = lines.withColumn("vocab_id", F.col("vocab_id").try_cast("bigint"))
    return images.join(numbered, ["page_key", "image_index"]).join(vocabulary, "vocab_id")


def bad_vocab_ids(lines: DataFrame, size: int) -> DataFrame:
    """Label lines whose id is no number between 1 and the vocabulary's size."""
    number = F.col("vocab_id").try_cast("bigint")
    return lines.where(number.isNull() | ~number.between(1, size))


def by_unique_label(images: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Images with a label to the only vocabulary id of that label; ambiguous and unknown labels are marked."""
    ids = vocabulary.groupBy("label").agg(F.count("*").alias("n_ids"), F.min("vocab_id").alias("vocab_id"))
    found = images.join(ids, "label", "left")
    kind = F.when(F.col("n_ids").isNull(), "unknown").when(F.col("n_ids") > 1, "ambiguous").otherwise("ok")
    return found.withColumn("mapping", kind).withColumn("vocab_id", F.when(F.col("mapping") == "ok", F.col("vocab_id"))).drop("n_ids")


def mismatches(mapping: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows of a mapping (image_path, label) that the canonical one lacks or contradicts."""
    other = canonical.select("image_path", F.col("label").alias("canonical_label"))
    joined = mapping.join(other, "image_path", "left")
    kind = F.when(F.col("canonical_label").isNull(), "absent").when(~F.col("label").eqNullSafe(F.col("canonical_label")), "mismatch").otherwise("ok")
    return joined.withColumn("check", kind)


def parse_paths(rows: DataFrame, path: str = "image_path") -> DataFrame:
    """split, writer_id, page_id, image_index of a path; null where it is none."""
    names = ("split", "writer_id", "page_id", "image_index")
    good = F.coalesce(F.col(path).rlike(PATH), F.lit(False))
    return rows.withColumns({n: F.when(good, F.regexp_extract(path, PATH, k + 1)) for k, n in enumerate(names)} | {"parsed": good})


def row_issues(rows: DataFrame, exists: DataFrame) -> DataFrame:
    """One row per issue of (image_path, vocab_id, label); ``exists`` has the image_path of real images."""
    marked = parse_paths(rows).join(exists.select("image_path", F.lit(True).alias("there")).distinct(), "image_path", "left")
    empty = lambda c: T.normalized_label(c) == ""
    found = F.array_compact(F.array(F.when(~F.col("parsed"), ISSUES[0]), F.when(F.col("parsed") & F.col("there").isNull(), ISSUES[1]), F.when(empty("label"), ISSUES[2]), F.when(empty("vocab_id"), ISSUES[3])))
    return marked.select("image_path", "vocab_id", "label", F.explode(found).alias("issue"))


def manifest(rows: DataFrame) -> DataFrame:
    """Usable rows in the manifest's columns; a missing image doesn't matter."""
    usable = parse_paths(rows).withColumn("label", T.normalized_label("label")).where("parsed").where((F.col("label") != "") & (T.normalized_label("vocab_id") != ""))
    page = T.page_key()
    return usable.select(page.alias("page_key"), "split", "writer_id", "page_id", "image_index", "image_path", "vocab_id", F.col("label").alias("ground_truth_text"), F.concat(F.lit("labels/words/"), page, F.lit("/"), "image_index", F.lit(".txt")).alias("word_label_path"), F.concat(F.lit("labels/pages/"), page, F.lit(".txt")).alias("page_label_path"))


def in_order(rows: DataFrame) -> DataFrame:
    """train, val, test, others; then by the numbers."""
    return rows.orderBy(T.split_order("split"), "split", F.col("writer_id").try_cast("int"), F.col("page_id").try_cast("int"), T.image_order(F.col("image_index").cast("string")))


def order_rank(rows: DataFrame, by: tuple[str, ...] = ("page_key",)) -> DataFrame:
    """Position of each image in its page, by number."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(T.image_order(F.col("image_index").cast("string")), "image_index")))


def page_labels(rows: DataFrame) -> DataFrame:
    """The labels of a page in image order, one per line."""
    members = F.array_sort(F.collect_list(F.struct(T.image_order(F.col("image_index").cast("string")).alias("n"), F.col("ground_truth_text").alias("t"))))
    return rows.groupBy("page_key").agg(F.array_join(F.transform(members, lambda x: x["t"]), "\n").alias("labels"))


def number_gaps(rows: DataFrame, page: str = "page_key", number: str = "image_index") -> DataFrame:
    """Numbers missing between 1 and a page's largest, one row each."""
    pages = rows.groupBy(page).agg(F.max(number).alias("largest"), F.collect_set(number).alias("have"))
    return pages.select(page, F.explode(F.array_except(F.sequence(F.lit(1), F.col("largest")), "have")).alias("missing"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def collisions(rows: DataFrame, source: str, output: str) -> DataFrame:
    """Outputs that several sources would be written to."""
    return rows.groupBy(output).agg(F.count_distinct(source).alias("n_sources"), F.min(source).alias("first_source")).where("n_sources > 1")


def page_range(pages: DataFrame, first: int, last: int, page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Pages numbered first to last, and the numbers among them that don't exist."""
    chosen = pages.where(F.col(page).between(first, last))
    wanted = pages.sparkSession.range(first, last + 1).withColumnRenamed("id", page)
    return chosen, wanted.join(pages.select(page), page, "left_anti")

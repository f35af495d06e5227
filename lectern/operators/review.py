"""Pages for review by a language model: building, choosing, checking the answers, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def build_pages(latest: DataFrame, inventory: DataFrame, keys: Sequence[str] = ("split", "writer_id", "page_id", "image")) -> DataFrame:
    """Ordered regions of every page that has a result.

    A missing, failed or empty image is a region with the missing mark; completed counts
    done images, whether empty or not.
    """
    records = latest.select(*keys, "status", "text")
    both = records.join(inventory.select(*keys), list(keys), "full_outer").withColumn("page_key", T.page_key())
    both = both.join(latest.select(T.page_key().alias("page_key")).distinct(), "page_key", "left_semi")
    done = T.completed("status")
    text = T.normalize("text")
    region = F.when(done & (text != ""), text).otherwise(T.OCR_MISSING)
    order = F.struct(T.natural_key(F.col(keys[-1]).cast("string")).alias("k"), F.col(keys[-1]).alias("i"), F.col("region").alias("t"))
    rolled = both.withColumn("region", region).withColumn("done", done).groupBy("page_key", *keys[:-1]).agg(F.array_sort(F.collect_list(order)).alias("m"), F.count_if("done").alias("completed_words"), F.count("*").alias("expected_words"), F.count_if(F.col("region") == T.OCR_MISSING).alias("missing_or_error_words"))
    return rolled.withColumn("ocr_regions", F.transform("m", lambda x: x["t"])).withColumn("ocr_text", F.array_join("ocr_regions", " ")).drop("m")


def first_pages(pages: DataFrame, limit: int) -> DataFrame:
    """The first pages in natural order."""
    if limit < 1:
        raise ValueError("the limit is at least 1")
    return pages.orderBy(T.natural_key("page_key"), "page_key").limit(limit)


def sample_pages(pages: DataFrame, count: int, seed: int, strata: Sequence[str] = ("split", "writer_id")) -> DataFrame:
    """A balanced sample: the strata take turns, each in the order of a seeded digest.

    The order is a digest's and not a particular random generator's.
    """
    if count < 1:
        raise ValueError("the count is at least 1")
    digest = F.md5(F.concat(F.lit(f"{seed}"), F.col("page_key")).cast("binary"))
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(digest, "page_key"))
    return pages.withColumn("_turn", turn).orderBy("_turn", *strata).limit(count).drop("_turn")


def pages_by_key(pages: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested pages (page_key, position) that exist, with their position."""
    return requested.join(pages, "page_key")


def absent_pages(pages: DataFrame, requested: DataFrame) -> DataFrame:
    return requested.join(pages.select("page_key"), "page_key", "left_anti")


def select_pages(pages: DataFrame, limit: int | None = None, sample: int | None = None, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """At most one of the ways to choose; unknown keys are an error that names ten of them."""
    if sum(x is not None for x in (limit, sample, keys)) > 1:
        raise ValueError("choose by a limit, a sample or keys, not by several")
    if limit is not None:
        return first_pages(pages, limit)
    if sample is not None:
        return sample_pages(pages, sample, seed)
    if keys is not None:
        order = list(dict.fromkeys(keys))
        requested = pages.sparkSession.createDataFrame([(k, n) for n, k in enumerate(order)], "page_key string, position int")
        lacking = [r["page_key"] for r in absent_pages(pages, requested).orderBy("position").limit(10).collect()]
        if lacking:
            raise ValueError("no such pages: " + ", ".join(lacking))
        return pages_by_key(pages, requested).orderBy("position").drop("position")
    return pages


def valid_detections(answers: DataFrame) -> DataFrame:
    """Detections of each page with ``accepted``.

    ``answers``: page_key, ocr_regions, errors (array of region_index, error, correction,
    reason).  Accepted are verbatim, changed, complete ones, each once, the first among
    the acceptable.
    """
    each = answers.select("page_key", "ocr_regions", F.posexplode("errors").alias("position", "e"))
    each = each.select("page_key", "position", F.col("e.region_index").alias("region_index"), *[T.normalize(f"e.{c}").alias(c) for c in ("error", "correction", "reason")], T.normalize(F.when(F.col("e.region_index") >= 1, F.try_element_at("ocr_regions", F.col("e.region_index").cast("int")))).alias("region"))
    sound = (F.col("error") != "") & (F.col("correction") != "") & (F.col("reason") != "") & (F.col("error") != F.col("correction")) & (F.col("error") != T.OCR_MISSING) & F.contains("region", "error")
    each = each.withColumn("sound", F.coalesce(sound, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("page_key", "region_index", "error", "correction", "sound").orderBy("position")) == 1
    return each.withColumn("accepted", F.col("sound") & first).drop("sound", "region")


def valid_examples(answers: DataFrame) -> DataFrame:
    """Examples of each page (page_key, ocr_regions, examples) with ``accepted``: verbatim in some region, each once."""
    each = answers.select("page_key", "ocr_regions", F.posexplode("examples").alias("position", "x")).withColumn("example", T.normalize("x"))
    sound = (F.col("example") != "") & (F.col("example") != T.OCR_MISSING) & F.exists("ocr_regions", lambda r: F.contains(T.collapse(r), F.col("example")))
    each = each.withColumn("sound", sound)
    first = F.row_number().over(Window.partitionBy("page_key", "example", "sound").orderBy("position")) == 1
    return each.withColumn("accepted", F.col("sound") & first).select("page_key", "position", "example", "accepted")


def detection_totals(checked: DataFrame) -> DataFrame:
    """Accepted, rejected and flagged regions per page."""
    return checked.groupBy("page_key").agg(F.count_if("accepted").alias("detected_error_count"), F.count_if(~F.col("accepted")).alias("rejected_detection_count"), F.count_distinct(F.when(F.col("accepted"), F.col("region_index"))).alias("flagged_region_count"))


def formatted_corrections(checked: DataFrame) -> DataFrame:
    """Accepted corrections of each page as lines, in their order."""
    line = F.concat(F.lit("region "), F.col("region_index").cast("string"), F.lit(": "), "error", F.lit(" → "), "correction", F.lit(" ("), "reason", F.lit(")"))
    rolled = checked.where("accepted").groupBy("page_key").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("t")))).alias("m"))
    return rolled.select("page_key", F.transform("m", lambda x: x["t"]).alias("formatted_corrections"))


def score_histogram(scores: DataFrame, column: str = "score", lowest: int = 1, highest: int = 5) -> DataFrame:
    """Counts of every score, those that don't occur included."""
    grid = scores.sparkSession.range(lowest, highest + 1).withColumnRenamed("id", "score")
    counts = scores.groupBy(F.col(column).cast("bigint").alias("score")).agg(F.count("*").alias("n"))
    return grid.join(counts, "score", "left").na.fill(0, ["n"])


def mean_median(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"))


def usage_totals(rows: DataFrame, usage: str = "usage", by: Sequence[str] = ()) -> DataFrame:
    """Sums of token usage; a record without usage counts 0."""
    names = ("input_tokens", "output_tokens", "total_tokens")
    return rows.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(f"{usage}.{n}"), F.lit(0))).alias(n) for n in names])

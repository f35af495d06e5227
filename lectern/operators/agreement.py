"""Two recognisers compared region by region, rolled up to pages and joined to side results.

Records of both logs and the inventory meet in full outer joins on the image key; only
the agreement ratio of texts that differ leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import distance as D
from lectern.functions import text as T

THRESHOLD = 0.70


def equality(a: Column, b: Column) -> Column:
    """A score of 0 or 1; two empty texts don't agree."""
    return F.when((a == b) & (a != ""), 1.0).otherwise(0.0)


def aligned(a: DataFrame, b: DataFrame, inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per image on pages that both logs have.

    Inputs have the key columns, page_key, and input_path, status, text (logs) or
    image_path (inventory), at most one row per key.
    """
    side = lambda log, s: log.select(*keys, "page_key", F.col("input_path").alias(f"path_{s}"), F.col("status").alias(f"status_{s}"), F.col("text").alias(f"raw_{s}"), F.lit(True).alias(f"has_{s}"))
    on = [*keys, "page_key"]
    both = side(a, "a").join(side(b, "b"), on, "full_outer").join(inventory.select(*on, "image_path"), on, "full_outer")
    common = a.select("page_key").intersect(b.select("page_key"))
    return both.join(common, "page_key", "left_semi")


def words(pairs: DataFrame, model_a: str, model_b: str, threshold: float = THRESHOLD, score: str = "ratio") -> DataFrame:
    """Statuses, usable texts, agreement and review reasons of aligned images.

    ``score`` is ``ratio``, ``equality`` or ``none``; with none no reason looks at it.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is between 0 and 1")
    done = {s: T.completed(f"status_{s}") for s in "ab"}
    status = {s: F.when(F.col(f"has_{s}"), F.coalesce(f"status_{s}", F.lit("missing"))).otherwise("missing") for s in "ab"}
    usable = {s: F.when(done[s], T.normalize(f"raw_{s}")).otherwise("") for s in "ab"}
    rows = pairs.withColumns({f"model_{s}_status": status[s] for s in "ab"} | {f"model_{s}_text": usable[s] for s in "ab"})
    a, b = F.col("model_a_text"), F.col("model_b_text")
    value = {"ratio": D.agreement, "equality": equality, "none": lambda a, b: F.lit(None).cast("double")}[score](a, b)
    rows = rows.withColumn("agreement_score", value)
    why = T.reasons(
        (~done["a"], f"{model_a}_missing_or_error"),
        (~done["b"], f"{model_b}_missing_or_error"),
        ((a == "") & (b == ""), "both_empty"),
        ((a == "") & (b != ""), f"{model_a}_empty"),
        ((a != "") & (b == ""), f"{model_b}_empty"),
        (F.col("agreement_score") < threshold, "agreement_below_threshold"),
    )
    path = F.coalesce(F.nullif("path_a", F.lit("")), F.nullif("path_b", F.lit("")), "image_path", F.lit(""))
    return rows.withColumns({"disagreement_score": 1 - F.col("agreement_score"), "review_reason": why, "source_image_path": path}).withColumn("human_review", F.col("review_reason") != "").drop("path_a", "path_b", "raw_a", "raw_b", "status_a", "status_b", "has_a", "has_b", "image_path")


def pages(word_rows: DataFrame, order: str = "image_index", threshold: float = THRESHOLD, score: str = "ratio") -> DataFrame:
    """Per page: counters, joined texts, their agreement and reasons."""
    done = lambda s: F.count_if(T.completed(f"model_{s}_status"))
    members = F.array_sort(F.collect_list(F.struct(T.natural_key(F.col(order).cast("string")).alias("k"), F.col("model_a_text").alias("a"), F.col("model_b_text").alias("b"))))
    rolled = word_rows.groupBy("page_key").agg(
        done("a").alias("model_a_completed_words"),
        done("b").alias("model_b_completed_words"),
        F.count_if(F.col("model_a_text") != "").alias("model_a_usable_words"),
        F.count_if(F.col("model_b_text") != "").alias("model_b_usable_words"),
        F.count("*").alias("expected_words"),
        F.count_if("human_review").alias("flagged_word_regions"),
        members.alias("m"),
    )
    text = lambda f: T.collapse(F.array_join(F.transform("m", lambda x: x[f]), " "))
    missing = lambda s: (F.col("expected_words") - F.col(f"model_{s}_usable_words")) / F.col("expected_words")
    rolled = rolled.withColumns({"model_a_text": text("a"), "model_b_text": text("b"), "model_a_missing_word_rate": missing("a"), "model_b_missing_word_rate": missing("b")}).drop("m")
    a, b = F.col("model_a_text"), F.col("model_b_text")
    rolled = rolled.withColumn("agreement_score", {"ratio": D.agreement, "equality": equality}[score](a, b))
    whole = (F.col("model_a_completed_words") == F.col("expected_words")) & (F.col("model_b_completed_words") == F.col("expected_words"))
    why = T.reasons((F.col("agreement_score") < threshold, "agreement_below_threshold"), (F.col("flagged_word_regions") > 0, "word_regions_flagged"), (~whole, "incomplete_page"))
    return rolled.withColumns({"disagreement_score": 1 - F.col("agreement_score"), "review_reason": why}).withColumn("human_review", F.col("review_reason") != "")


def completeness(pairs: DataFrame) -> DataFrame:
    """Completed and expected words of each page of aligned images."""
    counted = pairs.groupBy("page_key").agg(F.count_if(T.completed("status_a")).alias("model_a_completed_words"), F.count_if(T.completed("status_b")).alias("model_b_completed_words"), F.count("*").alias("expected_words"))
    whole = (F.col("model_a_completed_words") == F.col("expected_words")) & (F.col("model_b_completed_words") == F.col("expected_words"))
    return counted.withColumns({"completed_words": F.least("model_a_completed_words", "model_b_completed_words"), "complete": whole})


def error_rates(side: DataFrame) -> DataFrame:
    """Counts and rates of one side's error detection per page; a rate over nothing is 0."""
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    expected, missing, flagged = count("expected_words"), count("missing_or_error_words"), count("flagged_region_count")
    present = F.greatest(expected - missing, F.lit(0))
    share = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    return side.select("page_key", count("detected_error_count").alias("detected_errors"), flagged.alias("flagged_regions"), missing.alias("missing_words"), share(flagged, present).alias("flagged_region_rate"), share(missing, expected).alias("missing_word_rate"), share(flagged + missing, expected).alias("combined_failure_rate"))


def combined(page_rows: DataFrame, fluency: dict[str, DataFrame], errors: dict[str, DataFrame]) -> DataFrame:
    """Pages with both models' side results; pages without one keep nulls.

    ``model_x_missing_word_rate`` is the error detection's where this report is written,
    null where it has no row, whatever the page's own rate was.
    """
    out = page_rows.drop("model_a_missing_word_rate", "model_b_missing_word_rate")
    for s in "ab":
        scored = fluency[s].select("page_key", F.col("score").alias(f"model_{s}_fluency_score"), F.col("reason").alias(f"model_{s}_fluency_reason"))
        rated = error_rates(errors[s])
        rated = rated.select("page_key", *[F.col(c).alias(f"model_{s}_{c}") for c in rated.columns if c != "page_key"])
        out = out.join(scored, "page_key", "left").join(rated, "page_key", "left")
    return out


def summary(word_rows: DataFrame, page_rows: DataFrame, n_unpaired: int = 0, n_excluded: int = 0) -> DataFrame:
    """One row of totals; means and medians are of scores rounded to six digits."""
    w = word_rows.agg(F.count("*").alias("compared_word_regions"), F.count_if("human_review").alias("flagged_word_regions"), F.avg(F.bround("agreement_score", 6)).alias("mean_word_agreement"), F.median(F.bround("agreement_score", 6)).alias("median_word_agreement"))
    p = page_rows.agg(F.count("*").alias("compared_pages"), F.count_if("human_review").alias("flagged_pages"), F.avg(F.bround("agreement_score", 6)).alias("mean_page_agreement"), F.median(F.bround("agreement_score", 6)).alias("median_page_agreement"))
    total = F.col("flagged_pages") + F.lit(n_unpaired + n_excluded)
    return w.crossJoin(p).withColumns({"unpaired_pages": F.lit(n_unpaired), "excluded_incomplete_pages": F.lit(n_excluded), "total_pages_for_human_review": total})  # one row each

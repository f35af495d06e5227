"""Recognition quality against ground truth, per word, page and configuration.

All configurations are measured in one job.  Corpus rates are sums of edits over sums of
lengths; means of words and pages are of values rounded to six digits, as reports
print them; both are kept apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import distance as D
from lectern.functions import text as T

CONFIG = ("configuration",)


def word_metrics(completed: DataFrame, manifest: DataFrame, keys: Sequence[str], fold: bool = False) -> DataFrame:
    """Completed records joined to their true text, with edits, lengths and exact match.

    ``completed``: input_path, status, text, any configuration columns; ``manifest``:
    page_key, ground_truth_text and keys.  ``fold`` compares ASCII-folded texts.  A record
    without its image path takes the manifest's.
    """
    # one row can be much work, so rows are dealt by key and not by size; a merge join takes that dealing over
    n = int(completed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = normalized(completed.repartition(n, *keys), "text", "prediction_text").drop("text")
    truth = normalized(manifest, "ground_truth_text", "ground_truth_text")
    joined = compared(ready.join(truth.hint("merge"), list(keys)), fold).withColumn("_both", D.both_edits("_ref", "_hyp"))
    # of two equal texts there is no struct, and of a null one no number
    edits = lambda f: F.when(F.col("_ref") == F.col("_hyp"), 0).otherwise(F.col(f"_both.{f}"))
    measured = joined.withColumns({"edits": edits("edits"), "ref_chars": F.length("_ref"), "word_edits": edits("word_edits"), "ref_words": F.size(D.words("_ref"))})
    return measured.drop("_ref", "_hyp", "_both").withColumns({
        "cer": F.col("edits") / F.nullif("ref_chars", F.lit(0)),
        "wer": F.col("word_edits") / F.nullif("ref_words", F.lit(0)),
        "exact_match": F.col("ground_truth_text") == F.col("prediction_text"),
    })


def normalized(table: DataFrame, name: str, out: str) -> DataFrame:
    """``table`` with a text normalised; what takes a pattern is a column of its own, so it is done once a row."""
    return table.withColumn("_collapsed", T.collapse(name)).withColumn(out, T.nfc("_collapsed")).drop("_collapsed")


def compared(table: DataFrame, fold: bool) -> DataFrame:
    """``table`` with the texts that are compared as columns _ref and _hyp."""
    return table.withColumns({to: T.ascii_fold(c) if fold else F.col(c) for to, c in (("_ref", "ground_truth_text"), ("_hyp", "prediction_text"))})


def expected_sizes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("page_key").agg(F.count("*").alias("expected_words"))


def page_totals(words: DataFrame, manifest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edits and lengths summed per page, with completeness."""
    pages = words.groupBy(*by, "page_key").agg(F.count("*").alias("completed_words"), F.sum("edits").alias("edits"), F.sum("ref_chars").alias("ref_chars"), F.count_if("exact_match").alias("exact_matches"))
    sized = pages.join(expected_sizes(manifest), "page_key")
    return sized.withColumn("cer", F.col("edits") / F.nullif("ref_chars", F.lit(0))).withColumn("complete_page", F.col("completed_words") == F.col("expected_words"))


def page_texts(words: DataFrame, by: Sequence[str] = (), order: str = "image") -> DataFrame:
    """True and predicted texts of a page's words, in image order, joined by spaces."""
    members = F.array_sort(F.collect_list(F.struct(T.image_order(order).alias("n"), F.col(order).alias("o"), F.col("ground_truth_text").alias("t"), F.col("prediction_text").alias("p"))))
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = words.repartition(n, *by, "page_key").groupBy(*by, "page_key").agg(members.alias("m"))
    joined = lambda f: F.array_join(F.transform("m", lambda x: x[f]), " ")
    texts = pages.select(*by, "page_key", joined("t").alias("ground_truth_text"), joined("p").alias("prediction_text"), F.size("m").alias("completed_words"))
    return normalized(normalized(texts, "ground_truth_text", "ground_truth_text"), "prediction_text", "prediction_text").select(*texts.columns)


def page_metrics(words: DataFrame, manifest: DataFrame, by: Sequence[str] = (), order: str = "image", fold: bool = False) -> DataFrame:
    """Rates of the joined texts."""
    pages = page_texts(words, by, order).join(expected_sizes(manifest), "page_key")
    out = compared(pages, fold).withColumns({"cer": D.cer("_ref", "_hyp"), "wer": D.wer("_ref", "_hyp"), "complete_page": F.col("completed_words") == F.col("expected_words")})
    return out.drop("_ref", "_hyp")


def summary(words: DataFrame, pages: DataFrame, manifest: DataFrame, by: Sequence[str] = CONFIG) -> DataFrame:
    """One row per configuration.  ``pages`` has cer, wer and complete_page per configuration and page."""
    size = manifest.agg(F.count("*").alias("manifest_records"))
    mean = lambda c: F.avg(F.bround(c, 6))
    w = words.groupBy(*by).agg(
        F.count("*").alias("completed_records"),
        F.count_if(F.col("prediction_text") == "").alias("empty_outputs"),
        F.count_if("exact_match").alias("exact_matches"),
        mean("cer").alias("mean_word_cer"),
        mean("wer").alias("mean_word_wer"),
        (F.sum("edits") / F.sum("ref_chars")).alias("corpus_cer"),
        (F.sum("word_edits") / F.sum("ref_words")).alias("corpus_wer"),
    )
    p = pages.groupBy(*by).agg(F.count_if("complete_page").alias("completed_pages"), F.count_if(~F.col("complete_page")).alias("partial_pages"), mean("cer").alias("mean_page_cer"), mean("wer").alias("mean_page_wer"))
    joined = w.join(p, list(by)).crossJoin(F.broadcast(size))  # one row
    return joined.withColumn("coverage", F.col("completed_records") / F.col("manifest_records")).withColumn("exact_accuracy", F.col("exact_matches") / F.col("completed_records"))


def paired_improvement(words: DataFrame, baseline: str, candidate: str, keys: Sequence[str], metric: str = "cer") -> DataFrame:
    """Per page, the baseline's mean minus the candidate's over images that both have."""
    one = words.where(F.col("configuration") == baseline).select("page_key", *keys, F.col(metric).alias("baseline"))
    two = words.where(F.col("configuration") == candidate).select(*keys, F.col(metric).alias("candidate"))
    pairs = one.join(two, list(keys)).groupBy("page_key").agg(F.avg("baseline").alias("baseline_mean"), F.avg("candidate").alias("candidate_mean"), F.count("*").alias("pairs"))
    change = F.col("baseline_mean") - F.col("candidate_mean")
    return pairs.withColumn("improvement", change).withColumn("direction", F.when(F.abs(change) < 1e-9, "unchanged").when(change > 0, "better").otherwise("worse"))


def impact_rows(impact: DataFrame, comparison: str, level: str, metrics: Sequence[str]) -> DataFrame:
    """Chosen rows of an impact table with their improvement."""
    chosen = impact.where((F.col("comparison") == comparison) & (F.col("level") == level) & F.col("metric").isin(*metrics))
    return chosen.withColumn("improvement", F.col("baseline_mean") - F.col("candidate_mean"))

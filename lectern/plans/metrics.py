"""Queries of recognition quality.  Both engines compare ASCII-folded texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import logs, metrics
from lectern.operators.ranking import global_rank
from lectern.operators.truth import order_rank
from lectern.plans import fixtures as X
from lectern.plans.logs import KEYS, PAGE, latest_log, with_page
from lectern.plans.registry import query

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def norm_sql(x: str) -> str:
    return f"nfc_normalize(trim(regexp_replace(coalesce({x}, ''), '{WS}', ' ', 'g')))"


def fold_sql(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x20-\\x7e]', '?', 'g')"


def manifest(spark, sf_dir):
    words = with_page(X.word_images(spark, sf_dir))
    return words.select("page_key", *KEYS, F.col("image_index").cast("string").alias("image"), F.col("text").alias("ground_truth_text"), "image_path")


def measured(spark, sf_dir, *which):
    """Words of the logs ``which`` (the first by default), joined to the manifest in one go."""
    done = [latest_log(spark, sf_dir, w, "completed").select(*KEYS, "input_path", "status", "text").withColumn("configuration", F.lit(w)) for w in which or ("a",)]
    log = done[0]
    for more in done[1:]:
        log = log.unionByName(more)
    return metrics.word_metrics(log, manifest(spark, sf_dir), KEYS, fold=True)


def both_measured(spark, sf_dir):
    return measured(spark, sf_dir, "a", "b")


def words_sql(which: str) -> str:
    """words_<which>: the same columns."""
    return f"""
latest_{which} as ({X.FILTER_FIRST.format(log=f"log_{which}")}),
joined_{which} as (
  select '{which}' as configuration, {PAGE.replace("split", "w.split").replace("writer_id", "w.writer_id").replace("page_id", "w.page_id")} as page_key, w.image_index, w.image_path, l.input_path, l.status,
    {norm_sql("w.text")} as ground_truth_text, {norm_sql("l.text")} as prediction_text
  from latest_{which} l join word_images w on w.image_path = l.input_path),
folded_{which} as (select *, {fold_sql("ground_truth_text")} as ref, {fold_sql("prediction_text")} as hyp from joined_{which}),
tokens_{which} as (
  select *, list_filter(string_split(ref, ' '), lambda t: t <> '') as rt, list_filter(string_split(hyp, ' '), lambda t: t <> '') as ht,
    list_distinct(list_intersect(list_filter(string_split(ref, ' '), lambda t: t <> ''), list_filter(string_split(hyp, ' '), lambda t: t <> ''))) as common
  from folded_{which}),
words_{which} as (
  select *, cast(levenshtein(ref, hyp) as bigint) as edits, cast(length(ref) as bigint) as ref_chars, cast(len(rt) as bigint) as ref_words,
    cast(case when ref = hyp then 0 else levenshtein(
      array_to_string(list_transform(rt, lambda t: case when list_contains(common, t) then chr(cast(list_position(common, t) as integer) + 2) else chr(1) end), ''),
      array_to_string(list_transform(ht, lambda t: case when list_contains(common, t) then chr(cast(list_position(common, t) as integer) + 2) else chr(2) end), '')) end as bigint) as word_edits,
    ground_truth_text = prediction_text as exact_match
  from tokens_{which})"""


EXPECTED = f"expected as (select {PAGE} as page_key, cast(count(*) as bigint) as expected_words from word_images group by 1)"


@query("word_cer", f"{X.sql('a')}, {words_sql('a')} select page_key, image_index, edits, ref_chars, edits / nullif(ref_chars, 0) as cer from words_a")
def _(spark, sf_dir):
    return measured(spark, sf_dir).select("page_key", "image_index", F.col("edits").cast("bigint").alias("edits"), F.col("ref_chars").cast("bigint").alias("ref_chars"), "cer")


@query("word_wer", f"{X.sql('a')}, {words_sql('a')} select page_key, image_index, word_edits, ref_words, word_edits / nullif(ref_words, 0) as wer from words_a")
def _(spark, sf_dir):
    return measured(spark, sf_dir).select("page_key", "image_index", F.col("word_edits").cast("bigint").alias("word_edits"), F.col("ref_words").cast("bigint").alias("ref_words"), "wer")


@query("word_metrics_full", f"{X.sql('a')}, {words_sql('a')} select page_key, image_index, image_path, input_path, status, ground_truth_text, prediction_text, edits / nullif(ref_chars, 0) as cer, word_edits / nullif(ref_words, 0) as wer, exact_match from words_a")
def _(spark, sf_dir):
    return measured(spark, sf_dir).select("page_key", "image_index", "image_path", "input_path", "status", "ground_truth_text", "prediction_text", "cer", "wer", "exact_match")


@query("page_cer", f"""{X.sql("a")}, {words_sql("a")}, {EXPECTED},
pages as (select page_key, cast(count(*) as bigint) as completed_words, cast(sum(edits) as bigint) as edits, cast(sum(ref_chars) as bigint) as ref_chars, cast(count(*) filter (exact_match) as bigint) as exact_matches from words_a group by page_key)
select page_key, completed_words, expected_words, edits, ref_chars, edits / nullif(ref_chars, 0) as cer, exact_matches, completed_words = expected_words as complete_page from pages join expected using (page_key)""")
def _(spark, sf_dir):
    words = measured(spark, sf_dir)
    return metrics.page_totals(words, manifest(spark, sf_dir)).select("page_key", "completed_words", "expected_words", "edits", "ref_chars", "cer", "exact_matches", "complete_page")


PAGE_TEXTS = """
page_texts as (select configuration, page_key, string_agg(ground_truth_text, ' ' order by image_index) as ground_truth_text, string_agg(prediction_text, ' ' order by image_index) as prediction_text, cast(count(*) as bigint) as completed_words from {words} group by all)"""


@query("page_concat_cer", f"""{X.sql("a")}, {words_sql("a")}, {PAGE_TEXTS.format(words="words_a")},
clean as (select page_key, completed_words, {fold_sql(norm_sql("ground_truth_text"))} as ref, {fold_sql(norm_sql("prediction_text"))} as hyp from page_texts)
select page_key, completed_words, levenshtein(ref, hyp) / nullif(length(ref), 0) as cer from clean""")
def _(spark, sf_dir):
    pages = metrics.page_metrics(measured(spark, sf_dir), manifest(spark, sf_dir), fold=True)
    return pages.select("page_key", F.col("completed_words").cast("bigint").alias("completed_words"), "cer")


BOTH = f"{X.sql('a', 'b')}, {words_sql('a')}, {words_sql('b')}, two_logs as (select * from words_a union all by name select * from words_b)"


@query("config_summary", f"""{BOTH}, {EXPECTED}, {PAGE_TEXTS.format(words="two_logs")},
pages as (select configuration, completed_words = expected_words as complete_page, levenshtein({fold_sql(norm_sql("ground_truth_text"))}, {fold_sql(norm_sql("prediction_text"))}) / nullif(length({fold_sql(norm_sql("ground_truth_text"))}), 0) as cer from page_texts join expected using (page_key)),
p as (select configuration, cast(count(*) filter (complete_page) as bigint) as completed_pages, cast(count(*) filter (not complete_page) as bigint) as partial_pages, avg(round_even(cer, 6)) as mean_page_cer from pages group by 1),
w as (select configuration, cast(count(*) as bigint) as completed_records, cast(count(*) filter (prediction_text = '') as bigint) as empty_outputs, cast(count(*) filter (exact_match) as bigint) as exact_matches, avg(round_even(edits / nullif(ref_chars, 0), 6)) as mean_word_cer, avg(round_even(word_edits / nullif(ref_words, 0), 6)) as mean_word_wer, sum(edits) / sum(ref_chars) as corpus_cer, sum(word_edits) / sum(ref_words) as corpus_wer from two_logs group by 1)
select configuration, completed_records, empty_outputs, exact_matches, round(mean_word_cer, 6) as mean_word_cer, round(mean_word_wer, 6) as mean_word_wer, round(corpus_cer, 9) as corpus_cer, round(corpus_wer, 9) as corpus_wer, completed_pages, partial_pages, round(mean_page_cer, 6) as mean_page_cer, n as manifest_records, completed_records / n as coverage, exact_matches / completed_records as exact_accuracy
from w join p using (configuration), (select cast(count(*) as bigint) as n from word_images)""")
def _(spark, sf_dir):
    words, truth = both_measured(spark, sf_dir), manifest(spark, sf_dir)
    pages = metrics.page_metrics(words, truth, by=("configuration",), fold=True)
    out = metrics.summary(words, pages, truth).drop("mean_page_wer")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_word_cer", "mean_word_wer", "mean_page_cer")} | {c: F.round(c, 9) for c in ("corpus_cer", "corpus_wer")})


@query("config_union", f"{X.sql('a', 'b')} select 'a' as configuration, status, cast(count(*) as bigint) as n from log_a group by all union all select 'b', status, cast(count(*) as bigint) from log_b group by all")
def _(spark, sf_dir):
    both = X.recognition_log(spark, sf_dir, "a").withColumn("configuration", F.lit("a")).unionByName(X.recognition_log(spark, sf_dir, "b").withColumn("configuration", F.lit("b")))
    return both.groupBy("configuration", "status").agg(F.count("*").alias("n"))


@query("paired_improvement", f"""{BOTH},
pairs as (select a.page_key, avg(a.edits / nullif(a.ref_chars, 0)) as baseline_mean, avg(b.edits / nullif(b.ref_chars, 0)) as candidate_mean, cast(count(*) as bigint) as pairs from words_a a join words_b b on a.image_path = b.image_path group by 1)
select page_key, round(baseline_mean, 9) as baseline_mean, round(candidate_mean, 9) as candidate_mean, pairs, round(baseline_mean - candidate_mean, 9) as improvement, case when abs(baseline_mean - candidate_mean) < 1e-9 then 'unchanged' when baseline_mean > candidate_mean then 'better' else 'worse' end as direction from pairs""")
def _(spark, sf_dir):
    out = metrics.paired_improvement(both_measured(spark, sf_dir), "a", "b", KEYS)
    return out.withColumns({c: F.round(c, 9) for c in ("baseline_mean", "candidate_mean", "improvement")})


@query("image_int_order", f"with {X.WORD_IMAGES} select {PAGE} as page_key, image_index, cast(row_number() over (partition by {PAGE} order by image_index) as integer) as rank from word_images")
def _(spark, sf_dir):
    return order_rank(with_page(X.word_images(spark, sf_dir))).select("page_key", "image_index", "rank")


@query("page_key_order", f"with {X.WORD_IMAGES}, pages as (select distinct split, writer_id, page_id, {PAGE} as page_key from word_images) select page_key, cast(row_number() over (order by split, 'src' || lpad(regexp_extract(writer_id, '[0-9]+'), 10, '0'), cast(page_id as bigint)) as integer) as rank from pages")
def _(spark, sf_dir):
    pages = with_page(X.word_images(spark, sf_dir)).select("split", "writer_id", "page_id", "page_key").distinct()
    return global_rank(pages, [T.natural_key("split"), T.natural_key("writer_id")], [T.natural_key("page_id")]).select("page_key", "rank")


@query("log_errors_hide", f"{X.sql('a')}, f as ({X.FILTER_FIRST.format(log='log_a')}), l as ({X.ANY_STATUS.format(log='log_a')}) select f.input_path, f.status as filter_first, l.status as latest_first from f join l using (input_path) where f.status <> l.status")
def _(spark, sf_dir):
    log = X.recognition_log(spark, sf_dir, "a")
    one = logs.latest(log, ["input_path"], mode="completed").select("input_path", F.col("status").alias("filter_first"))
    two = logs.latest(log, ["input_path"]).select("input_path", F.col("status").alias("latest_first"))
    return one.join(two, "input_path").where("filter_first <> latest_first")

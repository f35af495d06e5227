"""Queries that compare two recognisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import agreement
from lectern.plans import fixtures as X
from lectern.plans.logs import KEYS, PAGE, latest_log, with_page
from lectern.plans.metrics import norm_sql
from lectern.plans.registry import query


def aligned(spark, sf_dir):
    a, b = (with_page(latest_log(spark, sf_dir, s, "any")) for s in "ab")
    inventory = with_page(X.word_images(spark, sf_dir))
    return agreement.aligned(a, b, inventory, KEYS)


DONE = "in ('ok', 'empty_output')"
ALIGNED = f"""{X.sql("a", "b")},
latest_a as ({X.ANY_STATUS.format(log="log_a")}), latest_b as ({X.ANY_STATUS.format(log="log_b")}),
common as (select distinct {PAGE} as page_key from log_a intersect select distinct {PAGE} from log_b),
aligned as (
  select {PAGE.replace("split", "w.split").replace("writer_id", "w.writer_id").replace("page_id", "w.page_id")} as page_key, w.image_index, w.image_path,
    a.status as status_a, b.status as status_b, coalesce(a.status, 'missing') as model_a_status, coalesce(b.status, 'missing') as model_b_status,
    case when a.status {DONE} then {norm_sql("a.text")} else '' end as a, case when b.status {DONE} then {norm_sql("b.text")} else '' end as b
  from word_images w left join latest_a a on a.input_path = w.image_path left join latest_b b on b.input_path = w.image_path),
pairs as (select * from aligned where page_key in (select page_key from common))"""


def reasons_sql(score: str | None) -> str:
    low = f", case when {score} < 0.7 then 'agreement_below_threshold' end" if score else ""
    return f"""array_to_string(list_filter([
  case when not coalesce(status_a {DONE}, false) then 'one_missing_or_error' end, case when not coalesce(status_b {DONE}, false) then 'two_missing_or_error' end,
  case when a = '' and b = '' then 'both_empty' when a = '' then 'one_empty' when b = '' then 'two_empty' end{low}], lambda x: x is not null), ';')"""


EQUAL = "case when a = b and a <> '' then 1.0 else 0.0 end"


@query("agreement_words")
def _(spark, sf_dir):
    return agreement.words(aligned(spark, sf_dir), "one", "two").select("page_key", "image_index", "source_image_path", "model_a_status", "model_b_status", "model_a_text", "model_b_text", "agreement_score", "disagreement_score", "human_review", "review_reason")


@query("agreement_reasons", f"{ALIGNED} select page_key, image_index, model_a_status, model_b_status, {reasons_sql(None)} as review_reason from pairs")
def _(spark, sf_dir):
    return agreement.words(aligned(spark, sf_dir), "one", "two", score="none").select("page_key", "image_index", "model_a_status", "model_b_status", "review_reason")


@query("agreement_flags", f"{ALIGNED}, scored as (select *, cast({EQUAL} as double) as s, {reasons_sql(EQUAL)} as review_reason from pairs) select page_key, image_index, image_path as source_image_path, a as model_a_text, b as model_b_text, s as agreement_score, 1 - s as disagreement_score, review_reason <> '' as human_review, review_reason from scored")
def _(spark, sf_dir):
    return agreement.words(aligned(spark, sf_dir), "one", "two", score="equality").select("page_key", "image_index", "source_image_path", "model_a_text", "model_b_text", "agreement_score", "disagreement_score", "human_review", "review_reason")


@query("agreement_pages")
def _(spark, sf_dir):
    return agreement.pages(agreement.words(aligned(spark, sf_dir), "one", "two"))


@query("agreement_page_counts", f"""{ALIGNED}, scored as (select *, {reasons_sql(EQUAL)} as review_reason from pairs),
pages as (select page_key, cast(count(*) filter (model_a_status {DONE}) as bigint) as model_a_completed_words, cast(count(*) filter (model_b_status {DONE}) as bigint) as model_b_completed_words, cast(count(*) filter (a <> '') as bigint) as model_a_usable_words, cast(count(*) filter (b <> '') as bigint) as model_b_usable_words, cast(count(*) as bigint) as expected_words, cast(count(*) filter (review_reason <> '') as bigint) as flagged_word_regions,
  {norm_sql("string_agg(a, ' ' order by image_index)")} as model_a_text, {norm_sql("string_agg(b, ' ' order by image_index)")} as model_b_text from scored group by 1)
select *, cast(case when model_a_text = model_b_text and model_a_text <> '' then 1.0 else 0.0 end as double) as agreement_score,
  array_to_string(list_filter([case when not (model_a_text = model_b_text and model_a_text <> '') then 'agreement_below_threshold' end, case when flagged_word_regions > 0 then 'word_regions_flagged' end, case when model_a_completed_words <> expected_words or model_b_completed_words <> expected_words then 'incomplete_page' end], lambda x: x is not null), ';') as review_reason from pages""")
def _(spark, sf_dir):
    rows = agreement.pages(agreement.words(aligned(spark, sf_dir), "one", "two", score="equality"), score="equality")
    return rows.drop("model_a_missing_word_rate", "model_b_missing_word_rate", "disagreement_score", "human_review")


@query("agreement_summary")
def _(spark, sf_dir):
    words = agreement.words(aligned(spark, sf_dir), "one", "two")
    return agreement.summary(words, agreement.pages(words))


PAGES_DONE = f"{ALIGNED}, done as (select page_key, cast(count(*) filter (model_a_status {DONE}) as bigint) as model_a_completed_words, cast(count(*) filter (model_b_status {DONE}) as bigint) as model_b_completed_words, cast(count(*) as bigint) as expected_words from pairs group by 1)"


@query("pages_complete", f"{PAGES_DONE} select *, least(model_a_completed_words, model_b_completed_words) as completed_words from done where model_a_completed_words = expected_words and model_b_completed_words = expected_words")
def _(spark, sf_dir):
    return agreement.completeness(aligned(spark, sf_dir)).where("complete").drop("complete")


@query("pages_excluded_incomplete", f"{PAGES_DONE} select *, least(model_a_completed_words, model_b_completed_words) as completed_words, 'incomplete_page_excluded_by_complete_pages_only' as review_reason from done where not (model_a_completed_words = expected_words and model_b_completed_words = expected_words)")
def _(spark, sf_dir):
    return agreement.completeness(aligned(spark, sf_dir)).where("not complete").drop("complete").withColumn("review_reason", F.lit("incomplete_page_excluded_by_complete_pages_only"))


def _side_results(spark, sf_dir):
    docs, labels = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels")
    pages = docs.select(F.col("doc_id").cast("string").alias("page_key"), (F.col("n_chars") % 40 + 1).alias("expected_words"), F.lit(0.5).alias("model_a_missing_word_rate"), F.lit(0.5).alias("model_b_missing_word_rate"))
    page = F.col("doc_id").cast("string").alias("page_key")
    fluency = labels.select(page, (1 + F.col("quality") * 2 + (1 - F.col("toxic")) * 2).alias("score"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("reason"))
    errors = labels.join(docs.select("doc_id", "n_chars"), "doc_id").select(page, (F.col("toxic") * 3).alias("detected_error_count"), F.col("toxic").alias("flagged_region_count"), (F.col("n_chars") % 40).alias("expected_words"), (F.col("n_chars") % 7 * F.when(F.col("n_chars") % 40 >= 7, 1).otherwise(0)).alias("missing_or_error_words"))
    even = F.col("page_key").cast("bigint") % 2 == 0
    return pages, {"a": fluency, "b": fluency.where(even)}, {"a": errors.where(even), "b": errors}


@query("combined_report", """
with f as (select cast(doc_id as varchar) as page_key, doc_id, 1 + quality * 2 + (1 - toxic) * 2 as score, 'q' || quality as reason from labels),
e as (select cast(doc_id as varchar) as page_key, doc_id, toxic * 3 as d, toxic as fl, n_chars % 40 as x, case when n_chars % 40 >= 7 then n_chars % 7 else 0 end as m from labels join documents using (doc_id)),
r as (select page_key, doc_id, d as detected_errors, fl as flagged_regions, m as missing_words, cast(case when greatest(x - m, 0) > 0 then fl / greatest(x - m, 0) else 0 end as double) as flagged_region_rate, cast(case when x > 0 then m / x else 0 end as double) as missing_word_rate, cast(case when x > 0 then (fl + m) / x else 0 end as double) as combined_failure_rate from e)
select cast(p.doc_id as varchar) as page_key, p.n_chars % 40 + 1 as expected_words, fa.score as model_a_fluency_score, fa.reason as model_a_fluency_reason, fb.score as model_b_fluency_score, fb.reason as model_b_fluency_reason,
  ra.detected_errors as model_a_detected_errors, ra.flagged_regions as model_a_flagged_regions, ra.missing_words as model_a_missing_words, ra.flagged_region_rate as model_a_flagged_region_rate, ra.missing_word_rate as model_a_missing_word_rate, ra.combined_failure_rate as model_a_combined_failure_rate,
  rb.detected_errors as model_b_detected_errors, rb.flagged_regions as model_b_flagged_regions, rb.missing_words as model_b_missing_words, rb.flagged_region_rate as model_b_flagged_region_rate, rb.missing_word_rate as model_b_missing_word_rate, rb.combined_failure_rate as model_b_combined_failure_rate
from documents p left join f fa on fa.doc_id = p.doc_id left join f fb on fb.doc_id = p.doc_id and fb.doc_id % 2 = 0 left join r ra on ra.doc_id = p.doc_id and ra.doc_id % 2 = 0 left join r rb on rb.doc_id = p.doc_id""")
def _(spark, sf_dir):
    return agreement.combined(*_side_results(spark, sf_dir))

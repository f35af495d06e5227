"""Queries of pages for review and of the answers to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import review
from lectern.operators.ranking import global_rank
from lectern.plans import fixtures as X
from lectern.plans.logs import latest_log
from lectern.plans.metrics import norm_sql
from lectern.plans.registry import query

KEYS = ("split", "writer_id", "page_id", "image_index")


@query("build_pages", f"""{X.sql("b")}, latest as ({X.ANY_STATUS.format(log="log_b")}),
regions as (
  select w.split, w.writer_id, w.page_id, w.image_index, coalesce(l.status in ('ok', 'empty_output'), false) as done,
    case when l.status in ('ok', 'empty_output') and {norm_sql("l.text")} <> '' then {norm_sql("l.text")} else '[OCR_MISSING]' end as region
  from word_images w left join latest l on l.input_path = w.image_path)
select split || '_' || writer_id || '_' || page_id as page_key, split, writer_id, page_id, list(region order by image_index) as ocr_regions, string_agg(region, ' ' order by image_index) as ocr_text,
  cast(count(*) filter (done) as bigint) as completed_words, cast(count(*) as bigint) as expected_words, cast(count(*) filter (region = '[OCR_MISSING]') as bigint) as missing_or_error_words
from regions where (split, writer_id, page_id) in (select (split, writer_id, page_id) from log_b) group by split, writer_id, page_id""")
def _(spark, sf_dir):
    return review.build_pages(latest_log(spark, sf_dir, "b", "any"), X.word_images(spark, sf_dir), KEYS)


@query("numbered_regions", f"with {X.PAGE_REGIONS} select page_key, array_to_string(list_transform(ocr_regions, lambda t, i: i || '. ' || t), chr(10)) as numbered from page_regions")
def _(spark, sf_dir):
    return X.page_regions(spark, sf_dir).select("page_key", T.numbered("ocr_regions").alias("numbered"))


def _doc_pages(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select(F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string")).alias("page_key"), F.col("lang").alias("split"), F.col("source").alias("writer_id"))


DOC_PAGES = "doc_pages as (select lang || '_' || source || '_' || doc_id as page_key, lang as split, source as writer_id, doc_id from documents)"


@query("select_first_n", f"with {DOC_PAGES} select page_key, split, writer_id from doc_pages order by split, lpad(regexp_extract(writer_id, '[0-9]+'), 10, '0'), doc_id limit 50")
def _(spark, sf_dir):
    return review.select_pages(_doc_pages(spark, sf_dir), limit=50)


@query("select_sample", f"with {DOC_PAGES}, turns as (select *, row_number() over (partition by split, writer_id order by md5('42' || page_key), page_key) as turn from doc_pages) select page_key, split, writer_id from turns order by turn, split, writer_id limit 25")
def _(spark, sf_dir):
    return review.select_pages(_doc_pages(spark, sf_dir), sample=25, seed=42)


@query("select_by_keys", f"with {DOC_PAGES}, r as (select lang || '_' || source || '_' || doc_id as page_key, cast(doc_id as integer) as position from documents join labels using (doc_id)) select page_key, position, split, writer_id from r join doc_pages using (page_key)")
def _(spark, sf_dir):
    asked = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id").select(F.concat_ws("_", "lang", "source", F.col("doc_id").cast("string")).alias("page_key"), F.col("doc_id").cast("int").alias("position"))
    return review.pages_by_key(_doc_pages(spark, sf_dir), asked)


@query("select_absent_keys", "select l.doc_id as position, 'p' || l.doc_id as page_key from labels l where not exists (select 1 from pages where page_id = l.doc_id)")
def _(spark, sf_dir):
    asked = X.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("position"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page_key"))
    there = X.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("page_key"))
    return review.absent_pages(there, asked)


@query("natural_sort_rank", "select doc_id, source, lang, cast(row_number() over (order by lang, 'src' || lpad(regexp_extract(source, '[0-9]+'), 10, '0'), doc_id) as integer) as rank from documents")
def _(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return global_rank(docs, [F.col("lang"), T.natural_key("source")], [F.col("doc_id")])


def _answers(spark, sf_dir):
    """Detections made of the regions' own first and last words, some wrong on purpose."""
    pages = X.page_regions(spark, sf_dir)
    first = lambda r: F.split_part(r, F.lit(" "), F.lit(1))
    made = lambda r, i: F.array(
        F.struct((i + 1).cast("int").alias("region_index"), first(r).alias("error"), F.concat(first(r), F.lit("!")).alias("correction"), F.lit("case").alias("reason")),
        F.struct((i + 2).cast("int").alias("region_index"), first(r).alias("error"), F.concat(first(r), F.lit("x")).alias("correction"), F.lit("next").alias("reason")),
        F.struct((i + 1).cast("int").alias("region_index"), F.concat(F.lit("  "), first(r)).alias("error"), F.concat(first(r), F.lit("!")).alias("correction"), F.lit("again").alias("reason")),
        F.struct((i + 1).cast("int").alias("region_index"), first(r).alias("error"), first(r).alias("correction"), F.lit("same").alias("reason")),
    )
    return pages.withColumn("errors", F.flatten(F.transform("ocr_regions", made)))


ANSWERS = f"""{X.PAGE_REGIONS},
flat as (select page_key, ocr_regions, unnest(ocr_regions) as r, unnest(range(1, len(ocr_regions) + 1)) as i from page_regions),
made as (
  select page_key, ocr_regions, 4 * (i - 1) + k as position, case when k = 1 then i + 1 else i end as region_index,
    {norm_sql("split_part(r, ' ', 1)")} as error,
    {norm_sql("case k when 1 then split_part(r, ' ', 1) || 'x' when 3 then split_part(r, ' ', 1) else split_part(r, ' ', 1) || '!' end")} as correction,
    case k when 0 then 'case' when 1 then 'next' when 2 then 'again' else 'same' end as reason
  from flat, (select unnest(range(0, 4)) as k)),
sound as (select *, coalesce(error <> '' and correction <> '' and error <> correction and error <> '[OCR_MISSING]' and contains({norm_sql("ocr_regions[region_index]")}, error), false) as sound from made),
checked as (select page_key, cast(position as integer) as position, cast(region_index as integer) as region_index, error, correction, reason,
  sound and row_number() over (partition by page_key, region_index, error, correction, sound order by position) = 1 as accepted from sound)"""


@query("validate_detections", f"with {ANSWERS} select * from checked")
def _(spark, sf_dir):
    return review.valid_detections(_answers(spark, sf_dir))


@query("flagged_rates", f"""with {ANSWERS}, t as (select page_key, cast(count(*) filter (accepted) as bigint) as detected_error_count, cast(count(*) filter (not accepted) as bigint) as rejected_detection_count, cast(count(distinct case when accepted then region_index end) as bigint) as flagged_region_count from checked group by 1)
select t.*, flagged_region_count / len(ocr_regions) as flagged_region_rate from t join page_regions using (page_key)""")
def _(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    totals = review.detection_totals(review.valid_detections(answers))
    sizes = answers.select("page_key", F.size("ocr_regions").alias("n"))
    return totals.join(sizes, "page_key").withColumn("flagged_region_rate", F.col("flagged_region_count") / F.col("n")).drop("n")


@query("formatted_corrections", f"with {ANSWERS} select page_key, list('region ' || region_index || ': ' || error || ' → ' || correction || ' (' || reason || ')' order by position) as formatted_corrections from checked where accepted group by 1")
def _(spark, sf_dir):
    return review.formatted_corrections(review.valid_detections(_answers(spark, sf_dir)))


@query("validate_examples", f"""with {X.PAGE_REGIONS},
flat as (select page_key, ocr_regions, unnest(ocr_regions) as r, unnest(range(0, len(ocr_regions))) as i from page_regions),
made as (select page_key, ocr_regions, 3 * i + k as position, {norm_sql("case k when 0 then split_part(r, ' ', 1) when 1 then split_part(r, ' ', 2) || '?' else '[OCR_MISSING]' end")} as example from flat, (select unnest(range(0, 3)) as k)),
sound as (select *, example <> '' and example <> '[OCR_MISSING]' and len(list_filter(ocr_regions, lambda x: contains(trim(regexp_replace(x, '[\\s]+', ' ', 'g')), example))) > 0 as sound from made)
select page_key, cast(position as integer) as position, example, sound and row_number() over (partition by page_key, example, sound order by position) = 1 as accepted from sound""")
def _(spark, sf_dir):
    word = lambda r, k: F.split_part(r, F.lit(" "), F.lit(k))
    made = F.flatten(F.transform("ocr_regions", lambda r: F.array(word(r, 1), F.concat(word(r, 2), F.lit("?")), F.lit("[OCR_MISSING]"))))
    return review.valid_examples(X.page_regions(spark, sf_dir).withColumn("examples", made))


@query("score_histogram", "with s as (select 1 + quality * 2 + (1 - toxic) * 2 as score from labels) select cast(g.score as bigint) as score, cast(count(s.score) as bigint) as n from (select unnest(range(1, 6)) as score) g left join s on s.score = g.score group by 1")
def _(spark, sf_dir):
    scores = X.table(spark, sf_dir, "labels").select((1 + F.col("quality") * 2 + (1 - F.col("toxic")) * 2).alias("score"))
    return review.score_histogram(scores)


@query("usage_totals", "select event_type, cast(sum(coalesce(k, 0)) as bigint) as input_tokens, cast(sum(coalesce(k * 2, 0)) as bigint) as output_tokens, cast(sum(coalesce(k * 3, 0)) as bigint) as total_tokens from (select event_type, case when event_type <> 'error' then cast(props->>'k' as bigint) end as k from events) group by 1")
def _(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    usage = F.when(F.col("event_type") != "error", F.struct(k.alias("input_tokens"), (k * 2).alias("output_tokens"), (k * 3).alias("total_tokens")))
    return review.usage_totals(X.table(spark, sf_dir, "events").withColumn("usage", usage), by=("event_type",))


@query("mean_median_scores", "select event_type, round(avg(value), 6) as mean, median(value) as median from events group by 1")
def _(spark, sf_dir):
    return review.mean_median(X.table(spark, sf_dir, "events"), "value", ("event_type",)).withColumn("mean", F.round("mean", 6))


@query("array_distinct_order", "select cast(conv_id as varchar) as page_key, turn, array_to_string(list_distinct_ordered, ' ') as words from (select conv_id, turn, list_filter(ws, lambda x, i: list_position(ws, x) = i) as list_distinct_ordered from (select conv_id, turn, string_split(coalesce(text, ''), ' ') as ws from conversations))")
def _(spark, sf_dir):
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))
    return X.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("page_key"), "turn", F.array_join(words, " ").alias("words"))

"""Queries over append logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import logs
from lectern.plans import fixtures as X
from lectern.plans.registry import query

KEYS = ("split", "writer_id", "page_id", "image_index")
DONE = "status in ('ok', 'empty_output')"


def latest_log(spark, sf_dir, which, mode):
    return logs.latest(X.recognition_log(spark, sf_dir, which), KEYS, mode=mode)


def with_page(rows):
    return rows.withColumn("page_key", T.page_key())


PAGE = "split || '_' || writer_id || '_' || page_id"


def _attempts(where: str) -> str:
    return f"with {X.ATTEMPTS} select key, pos, status, score from attempts where {where} qualify row_number() over (partition by key order by pos desc) = 1"


@query("latest_filter_first", _attempts(DONE))
def _(spark, sf_dir):
    return logs.latest(X.attempts(spark, sf_dir), ["key"], mode="completed").select("key", "pos", "status", "score")


@query("latest_any_status", _attempts("true"))
def _(spark, sf_dir):
    return logs.latest(X.attempts(spark, sf_dir), ["key"]).select("key", "pos", "status", "score")


@query("latest_ok_only", _attempts("status = 'ok'"))
def _(spark, sf_dir):
    return logs.latest(X.attempts(spark, sf_dir), ["key"], mode="ok").select("key", "pos", "status", "score")


@query("attempts_upsert", f"with {X.ATTEMPTS}, last as (select key, status, score, pos from attempts qualify row_number() over (partition by key order by pos desc) = 1), tries as (select key, cast(count(*) as bigint) as attempts from attempts group by key) select key, status, score, pos, attempts from last join tries using (key)")
def _(spark, sf_dir):
    tried = X.attempts(spark, sf_dir)
    counts = tried.groupBy("key").agg(F.count("*").alias("attempts"))
    return logs.latest(tried, ["key"]).select("key", "status", "score", "pos").join(counts, "key")


def _lines(spark, sf_dir):
    record = F.struct("input_path", F.when(F.col("image_index") % 5 > 0, "status").alias("x"), "status", "text")
    good = X.recognition_log(spark, sf_dir, "a").select(F.to_json(record).alias("value"))
    short = X.recognition_log(spark, sf_dir, "b").select(F.to_json(F.struct(F.concat(F.lit("x/"), F.col("page_id"), F.lit(".png")).alias("input_path"), "status")).alias("value"))
    broken = X.recognition_log(spark, sf_dir, "b").where("status = 'error'").select(F.lit('{"status": "ok", "te').alias("value"))
    blank = X.recognition_log(spark, sf_dir, "b").where("status = 'empty_output'").select(F.lit("  ").alias("value"))
    return good.union(short).union(broken).union(blank)


@query("log_quality_counts", f"""{X.sql("a", "b")},
counts as (select (select count(*) from log_a) as a, (select count(*) from log_b) as b, (select count(*) from log_b where status = 'error') as bad,
  (select count(*) from log_a where status not in ('ok', 'empty_output')) + (select count(*) from log_b where status not in ('ok', 'empty_output')) as failed)
select cast(a + b + bad as bigint) as lines, cast(bad as bigint) as malformed, cast(b as bigint) as unmapped, cast(failed as bigint) as not_completed from counts""")
def _(spark, sf_dir):
    return logs.quality_counts(logs.parse_lines(_lines(spark, sf_dir)))


@query("completed_join_manifest", f"{X.sql('a')}, latest as ({X.FILTER_FIRST.format(log='log_a')}) select {PAGE.replace('split', 'w.split').replace('writer_id', 'w.writer_id').replace('page_id', 'w.page_id')} as page_key, w.image_index, l.pos, l.status, w.text as ground_truth_text from latest l join word_images w on w.image_path = l.input_path")
def _(spark, sf_dir):
    words = with_page(X.word_images(spark, sf_dir)).select("page_key", *KEYS, F.col("text").alias("ground_truth_text"))
    return latest_log(spark, sf_dir, "a", "completed").drop("text").join(words, list(KEYS)).select("page_key", "image_index", "pos", "status", "ground_truth_text")


@query("unmapped_anti", f"{X.sql('a')} select pos, input_path, status from log_a where split not in ('en', 'de')")
def _(spark, sf_dir):
    manifest = X.word_images(spark, sf_dir).where(F.col("split").isin("en", "de"))
    return logs.not_in_manifest(X.recognition_log(spark, sf_dir, "a"), manifest, KEYS).select("pos", "input_path", "status")


@query("mapped_semi", f"{X.sql('a')} select pos, input_path, status from log_a where split in ('en', 'de')")
def _(spark, sf_dir):
    manifest = X.word_images(spark, sf_dir).where(F.col("split").isin("en", "de"))
    return logs.in_manifest(X.recognition_log(spark, sf_dir, "a"), manifest, KEYS).select("pos", "input_path", "status")


PAGES = f"pages_a as (select distinct {PAGE} as page_key from log_a), pages_b as (select distinct {PAGE} as page_key from log_b)"


def _pages(spark, sf_dir):
    return (with_page(X.recognition_log(spark, sf_dir, s)) for s in "ab")


@query("pages_common", f"{X.sql('a', 'b')}, {PAGES} select page_key from pages_a intersect select page_key from pages_b")
def _(spark, sf_dir):
    return logs.pages_common(*_pages(spark, sf_dir))


@query("pages_union", f"{X.sql('a', 'b')}, {PAGES} select page_key from pages_a union select page_key from pages_b")
def _(spark, sf_dir):
    return logs.pages_union(*_pages(spark, sf_dir))


@query("pages_unpaired", f"""{X.sql("a", "b")}, {PAGES}
select page_key, true as present_in_model_a, false as present_in_model_b, 'missing_entire_page_from_two' as review_reason from (select page_key from pages_a except select page_key from pages_b)
union all select page_key, false, true, 'missing_entire_page_from_one' from (select page_key from pages_b except select page_key from pages_a)""")
def _(spark, sf_dir):
    return logs.pages_unpaired(*_pages(spark, sf_dir), "one", "two")


RESUME = f"""stored as (select {PAGE} as page_key, input_path, text, 'm1' as model, status from log_a where pos % 3 > 0),
work as (select {PAGE} as page_key, input_path, text, 'm1' as model from log_a where status <> 'error')"""


def _resume(spark, sf_dir):
    log = with_page(X.recognition_log(spark, sf_dir, "a")).withColumn("model", F.lit("m1"))
    return log.where("status <> 'error'").select("page_key", "input_path", "text", "model"), log.where("pos % 3 > 0"), ["page_key", "input_path", "text", "model"]


@query("resume_completed", f"{X.sql('a')}, {RESUME} select * from work w where exists (select 1 from stored s where s.status = 'ok' and s.page_key = w.page_key and s.input_path = w.input_path and s.text = w.text and s.model = w.model)")
def _(spark, sf_dir):
    return logs.resumed(*_resume(spark, sf_dir))


@query("resume_pending", f"{X.sql('a')}, {RESUME} select * from work w where not exists (select 1 from stored s where s.status = 'ok' and s.page_key = w.page_key and s.input_path = w.input_path and s.text = w.text and s.model = w.model)")
def _(spark, sf_dir):
    return logs.pending(*_resume(spark, sf_dir))


@query("input_kind", f"""{X.sql("a", "b")},
paths as (select 'raw' as log, input_path from log_a union all select 'processed', replace(input_path, '/sample_set/', '/Processed_sets/') from log_a union all select 'mixed', case when image_index = 1 then '/elsewhere/1.png' else input_path end from log_b)
select log, case when bool_and(len(list_filter(string_split(input_path, '/'), lambda p: contains(lower(p), 'processed'))) > 0) then 'processed' when bool_and(contains(input_path, 'sample_set')) then 'raw' else 'mixed' end as input_kind from paths group by log""")
def _(spark, sf_dir):
    a, b = (X.recognition_log(spark, sf_dir, s) for s in "ab")
    cases = {"raw": a, "processed": a.withColumn("input_path", F.replace("input_path", F.lit("/sample_set/"), F.lit("/Processed_sets/"))), "mixed": b.withColumn("input_path", F.when(F.col("image_index") == 1, "/elsewhere/1.png").otherwise(F.col("input_path")))}
    out = None
    for name, log in cases.items():
        row = logs.input_kind(log).withColumn("log", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("run_totals", f"""{X.sql("a", "b")}, two_logs as (select 'a' as configuration, * from log_a union all select 'b', * from log_b)
select configuration, cast(count(*) as bigint) as records, cast(count(distinct {PAGE}) as bigint) as pages, cast(count(*) filter (status = 'error') as bigint) as errors, cast(count(*) filter (status = 'ok') as bigint) as successes,
  cast(count(*) filter (status <> 'ok') as bigint) as failed_strict, cast(count(*) filter (status = 'error') as bigint) as failed_lenient from two_logs group by configuration""")
def _(spark, sf_dir):
    both = X.recognition_log(spark, sf_dir, "a").withColumn("configuration", F.lit("a")).unionByName(X.recognition_log(spark, sf_dir, "b").withColumn("configuration", F.lit("b")))
    error, ok = F.col("status") == "error", F.col("status") == "ok"
    return with_page(both).groupBy("configuration").agg(F.count("*").alias("records"), F.count_distinct("page_key").alias("pages"), F.count_if(error).alias("errors"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failed_strict"), F.count_if(error).alias("failed_lenient"))

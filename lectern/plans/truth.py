"""Queries of ground truth: positions, labels, checks, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import truth
from lectern.plans import fixtures as X
from lectern.plans.logs import with_page
from lectern.plans.registry import query


def _labelled(spark, sf_dir):
    """Pages of label lines: each image's vocabulary id follows from its place."""
    words = with_page(X.word_images(spark, sf_dir))
    number = F.pmod(F.col("doc_id") + F.col("image_index"), F.lit(40)) + 1
    return words.select("page_key", "image_index", number.cast("string").alias("vocab_id"))


LABELLED = f"{X.WORD_IMAGES}, lines as (select split || '_' || writer_id || '_' || page_id as page_key, image_index, (doc_id + image_index) % 40 + 1 as vocab_id from word_images)"


@query("mapping_positional", f"with {LABELLED} select page_key, image_index, vocab_id, text as label from lines join benchmark on item_id + 1 = vocab_id")
def _(spark, sf_dir):
    lines = _labelled(spark, sf_dir)
    vocabulary = X.table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1).alias("vocab_id"), F.col("text").alias("label"))
    return truth.by_position(lines.select("page_key", "image_index"), lines, vocabulary)


@query("mapping_bad_ids", f"with {LABELLED} select page_key, image_index, case when vocab_id % 10 = 0 then 'x' || vocab_id else cast(vocab_id as varchar) end as vocab_id from lines where vocab_id % 10 = 0 or vocab_id > 33")
def _(spark, sf_dir):
    lines = _labelled(spark, sf_dir)
    broken = lines.withColumn("vocab_id", F.when(F.col("vocab_id").cast("int") % 10 == 0, F.concat(F.lit("x"), "vocab_id")).otherwise(F.col("vocab_id")))
    return truth.bad_vocab_ids(broken, 33)


@query("mapping_unique_label", "with v as (select md5(text) as label, count(*) as n, min(doc_id) as vocab_id from documents group by 1) select d.doc_id, md5(d.text) as label, case when n = 1 then v.vocab_id end as vocab_id, case when n > 1 then 'ambiguous' else 'ok' end as mapping from documents d join v on v.label = md5(d.text)")
def _(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("label"))
    return truth.by_unique_label(docs, docs.select("label", F.col("doc_id").alias("vocab_id")))


@query("mapping_mismatches", f"""{X.sql("a")}, m as (select input_path as image_path, text as label from log_a qualify row_number() over (partition by input_path order by pos) = 1), c as (select image_path, text from word_images where image_index % 4 > 0)
select image_path, label, c.text as canonical_label, case when c.text is null then 'absent' when label <> c.text then 'mismatch' else 'ok' end as check from m left join c using (image_path)""".replace(" as check ", ' as "check" '))
def _(spark, sf_dir):
    log = X.recognition_log(spark, sf_dir, "a").withColumn("pos", -F.col("pos"))
    from lectern.operators.logs import latest

    mapping = latest(log, ["input_path"]).select(F.col("input_path").alias("image_path"), F.col("text").alias("label"))
    canonical = X.word_images(spark, sf_dir).where("image_index % 4 > 0").select("image_path", F.col("text").alias("label"))
    return truth.mismatches(mapping, canonical)


def _damaged(spark, sf_dir):
    """(image_path, vocab_id, label) with one of each kind of damage now and then."""
    words = X.word_images(spark, sf_dir)
    j = F.col("doc_id") + F.col("image_index")
    path = F.concat(F.lit("/t/"), "split", F.lit("/"), F.regexp_replace("writer_id", "[^0-9]", ""), F.lit("/"), "page_id", F.lit("/"), F.col("image_index").cast("string"), F.when(j % 5 == 0, ".png").otherwise(".jpg"))
    return words.select(path.alias("image_path"), F.when(j % 7 > 0, j.cast("string")).alias("vocab_id"), F.when(j % 6 == 0, "  ").otherwise(F.col("text")).alias("label"), "image_index")


DAMAGED = f"""{X.WORD_IMAGES}, damaged as (
  select '/t/' || split || '/' || regexp_replace(writer_id, '[^0-9]', '', 'g') || '/' || page_id || '/' || image_index || case when (doc_id + image_index) % 5 = 0 then '.png' else '.jpg' end as image_path, (doc_id + image_index) % 5 > 0 as parsed,
    case when (doc_id + image_index) % 7 > 0 then cast(doc_id + image_index as varchar) end as vocab_id, case when (doc_id + image_index) % 6 = 0 then '  ' else text end as label, image_index, split, regexp_replace(writer_id, '[^0-9]', '', 'g') as w, page_id from word_images)"""


ISSUES = f"""with {DAMAGED}, issues as (
select image_path, vocab_id, label, unnest(list_filter([case when not parsed then 'malformed_path' end, case when parsed and image_index % 3 = 0 then 'missing_image' end, case when trim(label) = '' then 'empty_label' end, case when vocab_id is null then 'missing_vocab_id' end], lambda x: x is not null)) as issue from damaged)"""


def _issues(spark, sf_dir):
    rows = _damaged(spark, sf_dir)
    return truth.row_issues(rows.drop("image_index"), rows.where("image_index % 3 <> 0").select("image_path"))


@query("row_issues", f"{ISSUES} select * from issues")
def _(spark, sf_dir):
    return _issues(spark, sf_dir)


@query("issue_counts", f"{ISSUES} select issue, cast(count(*) as bigint) as n from issues group by 1")
def _(spark, sf_dir):
    return _issues(spark, sf_dir).groupBy("issue").agg(F.count("*").alias("n"))


EDGES = r"'^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$'"


@query("ground_truth_parse", f"""with {DAMAGED} select split || '_' || w || '_' || page_id as page_key, split, w as writer_id, page_id, cast(image_index as varchar) as image_index, image_path, vocab_id, nfc_normalize(regexp_replace(label, {EDGES}, '', 'g')) as ground_truth_text,
  'labels/words/' || split || '_' || w || '_' || page_id || '/' || image_index || '.txt' as word_label_path, 'labels/pages/' || split || '_' || w || '_' || page_id || '.txt' as page_label_path from damaged where parsed and trim(label) <> '' and vocab_id is not null""")
def _(spark, sf_dir):
    return truth.manifest(_damaged(spark, sf_dir).drop("image_index"))


@query("page_labels", f"with {X.WORD_IMAGES} select split || '_' || writer_id || '_' || page_id as page_key, string_agg(text, chr(10) order by image_index) as labels from word_images group by 1")
def _(spark, sf_dir):
    return truth.page_labels(with_page(X.word_images(spark, sf_dir)).withColumnRenamed("text", "ground_truth_text"))


@query("manifest_order", f"""with {X.WORD_IMAGES} select image_path, cast(row_number() over (order by case split when 'en' then 0 when 'de' then 1 when 'fr' then 2 else 3 end, split, writer_id, cast(page_id as bigint), image_index) as integer) as rank from word_images""")
def _(spark, sf_dir):
    from lectern.operators.ranking import global_rank

    words = X.word_images(spark, sf_dir)
    split = F.when(F.col("split") == "en", "train").when(F.col("split") == "de", "val").when(F.col("split") == "fr", "test").otherwise(F.col("split"))
    return global_rank(words, [T.split_order(split), F.col("split"), F.col("writer_id")], [F.col("page_id").cast("bigint"), F.col("image_index")]).select("image_path", "rank")


@query("page_number_gaps", f"{X.sql('a')}, p as (select split || '_' || writer_id || '_' || page_id as page_key, max(image_index) as largest, list(distinct image_index) as have from log_a group by 1) select page_key, missing from (select page_key, have, cast(unnest(range(1, largest + 1)) as integer) as missing from p) where not list_contains(have, missing)")
def _(spark, sf_dir):
    return truth.number_gaps(with_page(X.recognition_log(spark, sf_dir, "a")))


@query("page_range", "select r.page_id, d.doc_id is not null as present from (select unnest(range(990, 1021)) as page_id) r left join documents d on d.doc_id = r.page_id")
def _(spark, sf_dir):
    pages = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"))
    chosen, absent = truth.page_range(pages, 990, 1020)
    return chosen.withColumn("present", F.lit(True)).unionByName(absent.withColumn("present", F.lit(False)))


@query("output_collisions", "with p as (select url, regexp_replace(regexp_extract(url, '([^/]*)/?$', 1), '[.?#].*$', '') as output from pages) select output, cast(count(distinct url) as bigint) as n_sources, min(url) as first_source from p group by 1 having count(distinct url) > 1")
def _(spark, sf_dir):
    stem = F.regexp_replace(F.regexp_extract("url", "([^/]*)/?$", 1), "[.?#].*$", "")
    return truth.collisions(X.table(spark, sf_dir, "pages").withColumn("output", stem), "url", "output")


PATHS = f"""{X.WORD_IMAGES}, paths as (
  select case image_index % 4 when 0 then replace(image_path, 'sample_set', 'processed_sample_set') when 1 then split || '/' || writer_id || '/' || page_id || '/' || image_index || '.after.png' when 2 then '/x/y' || image_path when 3 then 'a/' || image_index || '.jpg' end as path, image_index from word_images
  union all select '/deep/' || image_index || '/b/c/d/e.png', image_index from word_images),
parts as (select path, string_split(regexp_replace(path, '\\.[^./]+$', ''), '/') as p from paths),
marked as (select path, p, list_position(p, 'processed_sample_set') as m1, list_position(p, 'sample_set') as m2 from parts)"""
AFTER = "case when m1 > 0 and len(p) - m1 = 4 then p[m1 + 1:] when m2 > 0 and len(p) - m2 = 4 then p[m2 + 1:] {rest} end"


def _paths(spark, sf_dir):
    words = X.word_images(spark, sf_dir)
    i = F.col("image_index")
    path = F.when(i % 4 == 0, F.replace("image_path", F.lit("sample_set"), F.lit("processed_sample_set"))).when(i % 4 == 1, F.concat("split", F.lit("/"), "writer_id", F.lit("/"), "page_id", F.lit("/"), i.cast("string"), F.lit(".after.png"))).when(i % 4 == 2, F.concat(F.lit("/x/y"), "image_path")).otherwise(F.concat(F.lit("a/"), i.cast("string"), F.lit(".jpg")))
    return words.select(path.alias("path")).union(words.select(F.concat(F.lit("/deep/"), i.cast("string"), F.lit("/b/c/d/e.png"))))


def _keyed(paths, key):
    return paths.select("path", key.alias("k")).select("path", "k.split", "k.writer_id", "k.page_id", "k.image")


@query("image_key_lenient", f"with {PATHS}, k as (select path, {AFTER.format(rest='when len(p) >= 4 then p[len(p) - 3:]')} as k from marked) select path, k[1] as split, k[2] as writer_id, k[3] as page_id, k[4] as image from k")
def _(spark, sf_dir):
    return _keyed(_paths(spark, sf_dir), T.image_key_lenient("path"))


@query("image_key_strict", f"with {PATHS}, k as (select path, case when len(p) = 4 then p else {AFTER.format(rest='')} end as k from marked) select path, k[1] as split, k[2] as writer_id, k[3] as page_id, k[4] as image from k")
def _(spark, sf_dir):
    return _keyed(_paths(spark, sf_dir), T.image_key_strict("path"))


@query("manifest_duplicates", "select md5(text) as label, cast(count(*) as bigint) as n from documents group by 1 having count(*) > 1")
def _(spark, sf_dir):
    return truth.duplicates(X.table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("label")), "label")



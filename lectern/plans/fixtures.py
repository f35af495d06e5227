"""Stand-ins for recognition data over the star-schema tables, in Spark and as SQL text.

Each fixture has a DataFrame builder and a common table expression of the same rows, so a
query and its SQL start from the same inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-blank line of every document: the image inventory with its true texts."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.trim("line") != "")
    index = (F.col("i") + 1).cast("int")
    page = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/data/sample_set/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), page, F.lit("/"), index.cast("string"), F.lit(".jpg"))
    return lines.select(F.col("lang").alias("split"), F.col("source").alias("writer_id"), page.alias("page_id"), index.alias("image_index"), F.col("line").alias("text"), path.alias("image_path"), "doc_id")


WORD_IMAGES = f"""
word_images as (
  select lang as split, source as writer_id, cast(doc_id as varchar) as page_id, cast(i as integer) as image_index, line as text,
    '/data/sample_set/' || lang || '/' || source || '/' || doc_id || '/' || i || '.jpg' as image_path, doc_id
  from (select doc_id, lang, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i, unnest(string_split(text, chr(10))) as line from documents)
  where trim(line) <> '')"""


@dataclass(frozen=True)
class Engine:
    """How a recogniser's log departs from the truth."""

    name: str
    absent: int
    error: int
    empty: int
    swapped: int
    letters: str
    become: str
    without_pages: int | None = None


ENGINES = {"a": Engine("a", 11, 13, 7, 3, "aeo", "eoa"), "b": Engine("b", 10, 17, 9, 2, "nrs", "rsn", 5)}


def recognition_log(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """pos, input_path, status, text and the key's parts; some images have a second, failed attempt."""
    e = ENGINES[which]
    words = word_images(spark, sf_dir).withColumn("k", F.col("doc_id") * 7 + F.col("image_index")).withColumn("j", F.col("doc_id") + F.col("image_index"))
    words = words.where(F.col("j") % e.absent != 0)
    if e.without_pages:
        words = words.where(F.col("doc_id") % e.without_pages != 0)
    status = F.when(F.col("k") % e.error == 0, "error").when(F.col("j") % e.empty == 0, "empty_output").otherwise("ok")
    text = F.when(status != "ok", "").when(F.col("image_index") % e.swapped == 0, F.translate("text", e.letters, e.become)).otherwise(F.col("text"))
    first = F.struct(F.lit(0).alias("n"), status.alias("status"), text.alias("text"))
    again = F.when(F.col("j") % 17 == 0, F.struct(F.lit(1).alias("n"), F.lit("error").alias("status"), F.lit("").alias("text")))
    tries = words.withColumn("t", F.explode(F.array_compact(F.array(first, again))))
    pos = F.col("doc_id") * 1000 + F.col("image_index") * 2 + F.col("t.n")
    return tries.select(pos.alias("pos"), F.col("image_path").alias("input_path"), "t.status", "t.text", "split", "writer_id", "page_id", "image_index", "doc_id")


def log_sql(which: str) -> str:
    e = ENGINES[which]
    return f"""
log_{which}_base as (
  select *, doc_id * 1000 + image_index * 2 as first_pos, doc_id + image_index as j,
    case when (doc_id * 7 + image_index) % {e.error} = 0 then 'error' when (doc_id + image_index) % {e.empty} = 0 then 'empty_output' else 'ok' end as first_status
  from word_images where (doc_id + image_index) % {e.absent} <> 0 {f"and doc_id % {e.without_pages} <> 0" if e.without_pages else ""}),
log_{which} as (
  select first_pos as pos, image_path as input_path, first_status as status,
    case when first_status <> 'ok' then '' when image_index % {e.swapped} = 0 then translate(text, '{e.letters}', '{e.become}') else text end as text,
    split, writer_id, page_id, image_index, doc_id from log_{which}_base
  union all
  select first_pos + 1, image_path, 'error', '', split, writer_id, page_id, image_index, doc_id from log_{which}_base where j % 17 = 0)"""


def sql(*needs: str) -> str:
    """A with clause of the fixtures named: words, a, b."""
    parts = [WORD_IMAGES] + [log_sql(n) for n in needs if n in ENGINES]
    return "with " + ",".join(parts)


#: Latest attempts in SQL, by mode.
FILTER_FIRST = "select * from {log} where status in ('ok', 'empty_output') qualify row_number() over (partition by input_path order by pos desc) = 1"
ANY_STATUS = "select * from {log} qualify row_number() over (partition by input_path order by pos desc) = 1"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append log: key, pos, status, score, usage."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "empty_output").otherwise("ok")
    usage = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), status.alias("status"), F.col("value").alias("score"), usage.alias("usage"))


ATTEMPTS = "attempts as (select user_id as key, event_id as pos, case event_type when 'error' then 'error' when 'view' then 'empty_output' else 'ok' end as status, value as score, cast(props->>'k' as bigint) as usage from events)"


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages of ordered regions."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select(F.col("conv_id").cast("string").alias("page_key"), F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("ocr_regions"))


PAGE_REGIONS = "page_regions as (select cast(conv_id as varchar) as page_key, list(coalesce(text, '') order by turn, text) as ocr_regions from conversations group by conv_id)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 grey images: vec_id, x, y, px."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    px = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("v").cast("double") + 0.6) * 200))).cast("int")
    return cells.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), px.alias("px"))


RASTER = "raster as (select vec_id, cast(i % 8 as integer) as x, cast(i // 8 as integer) as y, cast(least(255, greatest(0, floor((cast(v as double) + 0.6) * 200))) as integer) as px from (select vec_id, unnest(range(0, len(embedding))) as i, unnest(embedding) as v from embeddings))"

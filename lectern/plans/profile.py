"""Queries of the corpus profile and of names and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import profile
from lectern.plans import fixtures as X
from lectern.plans.registry import query


@query("descriptive_stats", "select lang, cast(count(n_chars) as bigint) as n, round(avg(n_chars), 6) as mean, round(coalesce(stddev_samp(n_chars), 0.0), 6) as std, min(n_chars) as least, max(n_chars) as greatest from documents group by 1")
def _(spark, sf_dir):
    out = profile.describe(X.table(spark, sf_dir, "documents"), "n_chars", ("lang",))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("top_resolutions", "select p_size, p_brand, cast(count(*) as bigint) as n, min(p_partkey) as first_seen from part group by 1, 2 order by n desc, first_seen limit 10")
def _(spark, sf_dir):
    return profile.most_common(X.table(spark, sf_dir, "part"), ("p_size", "p_brand"), "p_partkey", 10)


@query("histogram_merge", "select value, cast(sum(n) as bigint) as n from (select source as value, count(*) as n from documents group by 1 union all select event_type, count(*) from events group by 1) group by 1")
def _(spark, sf_dir):
    return profile.merge_histograms(profile.histogram(X.table(spark, sf_dir, "documents"), "source"), profile.histogram(X.table(spark, sf_dir, "events"), "event_type"))


@query("file_type_counts", "select coalesce(nullif(lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)), ''), 'none') as file_type, cast(count(*) as bigint) as n from pages group by 1")
def _(spark, sf_dir):
    return profile.file_types(X.table(spark, sf_dir, "pages"), "url")


@query("scale_factor", """with s as (select p_partkey, p_size, p_retailprice - 950 as dpi from part),
f as (select *, coalesce(dpi > 0, false) as dpi_valid, greatest(case when dpi > 0 and dpi < 300 then 300.0::double / dpi else 1.0 end, case when p_size < 100 then 100.0::double / p_size else 1.0 end, 1.0::double) as scale from s)
select p_partkey, p_size, dpi_valid, round(scale, 9) as scale, cast(round_even(p_size * scale, 0) as integer) as new_width from f""")
def _(spark, sf_dir):
    parts = X.table(spark, sf_dir, "part").withColumn("dpi", F.col("p_retailprice") - 950)
    return profile.scale_factor(parts, "p_size", "dpi").select("p_partkey", "p_size", "dpi_valid", F.round("scale", 9).alias("scale"), "new_width")


@query("format_number", "select p_partkey, case when p_size % 9 = 0 then 'N/A' else printf('%.2f', p_size + 0.25) end as shown from part")
def _(spark, sf_dir):
    value = F.when(F.col("p_size") % 9 != 0, F.col("p_size") + 0.25)
    return X.table(spark, sf_dir, "part").select("p_partkey", T.format_number(value).alias("shown"))


@query("safe_names", "select page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'model') as name from pages")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", T.safe_name("url").alias("name"))


@query("config_fields", """with p as (select doc_id, source || case doc_id % 4 when 0 then '/results.jsonl' when 1 then '/raw/results.jsonl' when 2 then '/processed/run_2/results.jsonl' else '/a/b/c/results.jsonl' end as path from documents),
f as (select doc_id, list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) as f from p)
select doc_id, array_to_string(f, '/') as configuration, coalesce(f[1], 'unknown') as model, coalesce(f[2], 'unknown') as input_kind, coalesce(f[3], f[2], 'unknown') as run from f""")
def _(spark, sf_dir):
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, "/results.jsonl").when(k == 1, "/raw/results.jsonl").when(k == 2, "/processed/run_2/results.jsonl").otherwise("/a/b/c/results.jsonl")
    rows = X.table(spark, sf_dir, "documents").select("doc_id", T.config_fields(F.concat("source", tail)).alias("f"))
    return rows.select("doc_id", "f.configuration", "f.model", "f.input_kind", "f.run")

"""Queries of text cleaning, HTML and text reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import html
from lectern.functions import text as T
from lectern.plans import fixtures as X
from lectern.plans.metrics import norm_sql
from lectern.plans.registry import query
from lectern.sources.reports import parse_report

LATIN = r"\x{c0}-\x{ff}"


@query("normalize_text", f"select doc_id, {norm_sql('text')} as text from documents")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("text"))


# a hyphen stays between two letters only: those are marked first, twice as they can share a letter
CLEAN = rf"""marked as (select doc_id, {norm_sql("text")} as t from documents),
once as (select doc_id, regexp_replace(t, '([{LATIN}])-([{LATIN}])', '\1' || chr(1) || '\2', 'g') as t from marked),
twice as (select doc_id, regexp_replace(t, '([{LATIN}])-([{LATIN}])', '\1' || chr(1) || '\2', 'g') as t from once),
kept as (select doc_id, replace(regexp_replace(t, '[^{LATIN}\x{{200c}}\x{{200d}} \x01]', ' ', 'g'), chr(1), '-') as t from twice),
clean as (select doc_id, trim(regexp_replace(t, ' +', ' ', 'g')) as t from kept)"""


@query("clean_script", f"with {CLEAN} select doc_id, t as text from clean")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.clean_script(T.normalize("text"), LATIN).alias("text"))


@query("script_flags", rf"""with {CLEAN}, counted as (select doc_id, t, len(regexp_extract_all(t, '[{LATIN}]')) as n from clean)
select doc_id, t as text, n < 40 as suspicious_output, case when n = 0 then 'no_latin_text' when n < 40 then 'fewer_than_40_latin_characters' else '' end as suspicious_reason, cast(n as integer) as character_count, case when t = '' then 'empty_output' else 'ok' end as status from counted""")
def _(spark, sf_dir):
    rows = X.table(spark, sf_dir, "documents").select("doc_id", T.script_flags(T.normalize("text"), LATIN, 40, "latin").alias("f"))
    return rows.select("doc_id", "f.text", "f.suspicious_output", "f.suspicious_reason", "f.character_count", T.output_status("f.text").alias("status"))


def fast_sql(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:br|div|p|li|tr)(?:\\s[^>]*)?/?>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
    for entity, character in html.ENTITIES:
        out = f"replace({out}, '{entity}', '{character}')"
    return f"trim(regexp_replace({out}, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


@query("html_text_fast", f"select page_id, {fast_sql('html')} as text from pages")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", html.html_to_text_fast("html").alias("text"))


@query("html_text_exact")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "pages").select("page_id", html.html_to_text("html").alias("text"))


# what the blocks of a turn are written in, and the text that is to come of it
WRAPPED = {0: ("<p>", "</p>", "", ""), 1: ("<b>a&eacute;b&#39;c</b><script>var x</script> ", "", "aéb'cvar x ", ""), 2: ('<div title="a > b">', "</div><!-- not this -->", "", ""), 3: ("<style>p {}</style><br/>", "&hellip;", "p {} ", "…")}


def _wrapped_sql(at: int) -> str:
    return "case turn % 4 " + " ".join(f"when {k} then '{parts[at]}'" for k, parts in ((k, [x.replace("'", "''") for x in w]) for k, w in WRAPPED.items())) + " end"


@query("blocks_reading_order", f"""with b as (select conv_id, turn, {_wrapped_sql(2)} || coalesce(text, '') || {_wrapped_sql(3)} as t, (turn * 7) % 5 as o from conversations where turn % 5 <> 3)
select cast(conv_id as varchar) as page_key, {norm_sql("string_agg(t, ' ' order by o, turn)")} as text from b group by 1""")
def _(spark, sf_dir):
    """Texts are escaped and wrapped in markup of several kinds; the SQL knows them from before."""
    turn = F.col("turn")
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    part = lambda at: F.element_at(F.create_map(*[F.lit(x) for k, w in WRAPPED.items() for x in (k, w[at])]), (turn % 4).cast("int"))
    block = F.struct("turn", ((turn * 7) % 5).cast("int").alias("reading_order"), F.concat(part(0), escaped, part(1)).alias("html"), (turn % 5 == 3).alias("skipped"), F.lit(False).alias("error"))
    pages = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    out = pages.select(F.col("conv_id").cast("string").alias("page_key"), html.response_text("blocks").alias("text"), F.size(F.filter("blocks", lambda b: ~b["skipped"])).alias("n"))
    return out.where("n > 0").drop("n")


@query("report_parse", """select lang as configuration, cast(n as bigint) as n, round(m, 3) as mean from (select lang, count(*) as n, cast(avg(n_chars) as decimal(12, 3)) as m from documents group by 1)""")
def _(spark, sf_dir):
    """A text report is written per language, and read back."""
    stats = X.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").cast("decimal(12,3)").alias("m"))
    ranked = stats.withColumn("k", F.ascii("lang") * 1000 + F.ascii(F.substring("lang", 2, 1)))
    lines = F.array(F.concat(F.lit("CONFIGURATION "), F.col("k").cast("string"), F.lit(":")), F.concat(F.lit("  configuration: "), "lang"), F.concat(F.lit("  n: "), F.col("n").cast("string")), F.lit("  "), F.concat(F.lit("  mean: "), F.col("m").cast("string")))
    report = ranked.select(F.posexplode(lines).alias("i", "value"), "k").select((F.col("k") * 10 + F.col("i")).alias("pos"), "value")
    table = parse_report(report, ("configuration", "n", "mean"))
    return table.select("configuration", F.col("n").cast("bigint").alias("n"), F.round(F.col("mean").cast("decimal(12,3)"), 3).alias("mean"))

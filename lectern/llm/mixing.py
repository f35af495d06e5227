"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 and 1,
normalised.  The exponent is bisected: the largest that reaches the target entropy (a
share of the greatest possible), raised where a source would otherwise be repeated more
often than ``repetition_limit`` times as much as another.  Weights are realised without
dropping anything: the token budget is the smallest for which every source is passed
at least once, a source's whole passes and one partial pass follow in freshly permuted
orders, and the resulting streams are dealt into blocks of ``block_tokens`` tokens of
which each holds the target weights; within a block copies are permuted again.

Scale: all relational.  Token counts come from one scan.  The bisection evaluates 31
midpoints at once in a few small aggregates over the per-source totals.  Positions in
a source's stream are two-level prefix sums: windows over hash buckets of about
``bucket_rows`` rows, then over the buckets' sums, so that a source with a third of all
rows isn't one task.  Blocks are bounded by their budget.  The per-source parameters are
broadcast only below ``BROADCAST_SOURCES`` sources.

Cases: tokens are words ``[^\\x20\\x09-\\x0D]+``; a null text has none; a null source
counts as the empty one; a source without tokens has no weight and passes once, spread over
all blocks; equal rows (doc_id, source, text) share a position and keep their number; an empty table gives
an empty result; other columns are carried by :func:`mix` alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 100_000
ROUNDS, MIDPOINTS = 6, 31  # 31 midpoints are five bisection steps


@dataclass(frozen=True)
class Mixture:
    entropy_share: float = 0.97
    repetition_limit: float = 2.0
    block_tokens: int = 1_000_000
    bucket_rows: int = 2_000


PRODUCTION = Mixture()


def _units(docs: DataFrame) -> DataFrame:
    """Equal rows as one: doc_id, source, text_md5, tokens, n_same."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.md5(text.cast("binary")).alias("text_md5"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("tokens"))
    return rows.groupBy("doc_id", "source", "text_md5", "tokens").agg(F.count("*").alias("n_same"))


def _judge(totals: DataFrame, alphas: list[float], mixture: Mixture) -> list[bool]:
    """For each exponent, whether a smaller one would still be wanted (too little entropy and repetition within the limit).

    As entropy and repetition both fall with the exponent, the answers are monotone.
    """
    grid = totals.select("tokens", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    power = F.pow(F.col("tokens").cast("double"), F.col("alpha"))
    sums = grid.groupBy("alpha").agg(
        F.sum(power).alias("z"), F.sum(power * F.log(power)).alias("plogp"), F.count("*").alias("n"), F.max("tokens").alias("most"), F.min("tokens").alias("least")
    )
    entropy = F.log("z") - F.col("plogp") / F.col("z")
    repeats = F.pow(F.col("most").cast("double") / F.col("least"), 1 - F.col("alpha"))
    down = (entropy < F.lit(mixture.entropy_share) * F.log(F.col("n").cast("double"))) & (repeats < F.lit(mixture.repetition_limit))
    found = {r["alpha"]: r["down"] for r in sums.select("alpha", down.alias("down")).collect()}  # MIDPOINTS rows
    return [found[a] for a in alphas]


def bisect_exponent(totals: DataFrame, mixture: Mixture) -> float:
    """The exponent for sources with ``tokens`` (> 0 each)."""
    if not _judge(totals, [1.0], mixture)[0]:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        step = (hi - lo) / (MIDPOINTS + 1)
        alphas = [lo + step * k for k in range(1, MIDPOINTS + 1)]
        down = [False, *_judge(totals, alphas, mixture), True]
        k = down.index(True)
        lo, hi = ([lo, *alphas, hi])[k - 1], ([lo, *alphas, hi])[k]
    return hi


def plan(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """One row per unit and pass: doc_id, source, text_md5, tokens, n_same, epoch, block_id, position."""
    units = cut(_units(docs))
    per_source = units.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_same")).alias("tokens"), F.count("*").alias("n_units"))
    totals = cut(per_source)
    weighty = totals.where("tokens > 0")
    facts = totals.agg(F.count("*").alias("sources"), F.count_if(F.col("tokens") > 0).alias("weighty"), F.max("n_units").alias("units")).first()
    alpha = bisect_exponent(weighty, mixture) if facts["weighty"] else 1.0
    # a source's budget is power * scale, where the scale lets the source that is repeated least pass once
    power = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    least = weighty.agg(F.max(F.col("tokens") / power).alias("scale"), F.max("tokens").alias("t")).first()
    budget = F.greatest(F.col("tokens"), F.round(power * F.lit(least["scale"] or 1.0)).cast("bigint"))
    sources = totals.select("source", F.col("tokens").alias("source_tokens"), F.when(F.col("tokens") > 0, budget).otherwise(0).alias("budget"))
    total = sources.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, -(-total // mixture.block_tokens))
    passes = F.when(F.col("source_tokens") > 0, F.ceil(F.col("budget") / F.col("source_tokens"))).otherwise(1).cast("int")
    sources = sources.withColumn("passes", passes)
    if facts["sources"] <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)

    copies = units.join(sources, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    copies = copies.withColumn("order_key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5", F.col("epoch").cast("string")).cast("binary")))
    n_buckets = max(1, (facts["units"] or 0) // mixture.bucket_rows)
    share = lambda n: F.conv(F.substring("order_key", 1, 7), 16, 10).cast("bigint") * F.lit(n) / F.lit(1 << 28)  # noqa: E731  0 to n, by the key
    copies = copies.withColumn("bucket", F.floor(share(n_buckets)).cast("bigint"))
    weight = F.col("tokens") * F.col("n_same")
    inside = Window.partitionBy("source", "epoch", "bucket").orderBy("order_key").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bucket_sums = copies.groupBy("source", "epoch", "bucket").agg(F.sum(weight).alias("bucket_tokens"))
    bucket_starts = bucket_sums.select("source", "epoch", "bucket", F.coalesce(F.sum("bucket_tokens").over(across), F.lit(0)).alias("bucket_start"))
    placed = copies.withColumn("inside", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(bucket_starts, ["source", "epoch", "bucket"])
    at = F.col("epoch") * F.col("source_tokens") + F.col("bucket_start") + F.col("inside")
    placed = placed.withColumn("at", at).where("epoch = 0 or at < budget")
    block = F.least(F.lit(blocks - 1), F.when(F.col("budget") > 0, F.floor(F.col("at").cast("decimal(38,0)") * F.lit(blocks).cast("decimal(20,0)") / F.col("budget").cast("decimal(38,0)"))).otherwise(F.floor(share(blocks)))).cast("bigint")
    placed = placed.withColumn("block_id", block)
    in_block = Window.partitionBy("block_id").orderBy(F.reverse("order_key"), "source").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("position", F.coalesce(F.sum("n_same").over(in_block), F.lit(0))).select("doc_id", "source", "text_md5", "tokens", "n_same", "epoch", "block_id", "position")


def schedule(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """One row per copy: doc_id, source, epoch, block_id, position, tokens."""
    copies = plan(docs, mixture).withColumn("same", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_same") - 1)))
    return copies.select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "block_id", (F.col("position") + F.col("same")).alias("position"), "tokens")


def mix(docs: DataFrame, mixture: Mixture = PRODUCTION) -> DataFrame:
    """The columns of ``docs``, each row as often as planned, in the order of the blocks.

    Rows are joined to their plan by doc_id, source and text digest, of which the plan
    has one row per pass, so equal rows keep their number.
    """
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"_doc_{k}") for k, c in enumerate(names)], F.coalesce("source", F.lit("")).alias("_source"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_md5"), F.col("doc_id").alias("_id"))
    planned = plan(docs, mixture).select(F.col("doc_id").alias("_pid"), F.col("source").alias("_source"), F.col("text_md5").alias("_md5"), "block_id", "position")
    joined = keyed.join(planned, (F.col("_id").eqNullSafe(F.col("_pid"))) & (keyed["_source"] == planned["_source"]) & (keyed["_md5"] == planned["_md5"]))
    ordered = joined.repartitionByRange("block_id").sortWithinPartitions("block_id", "position")
    return ordered.select(*[F.col(f"_doc_{k}").alias(c) for k, c in enumerate(names)])


def schedule_sql(mixture: Mixture = PRODUCTION) -> str:
    """The same rows in DuckDB's SQL; the exponent by plain bisection in a recursive query."""
    m = mixture
    return f"""
with recursive rows_ as (
  select doc_id, coalesce(source, '') as source, md5(coalesce(text, '')) as text_md5, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as tokens from documents),
units as (select doc_id, source, text_md5, tokens, cast(count(*) as bigint) as n_same from rows_ group by all),
totals as (select source, cast(sum(tokens * n_same) as bigint) as tokens from units group by source),
bounds as (select count(*) as n, max(tokens) as most, min(tokens) as least from totals where tokens > 0),
bisect(k, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select k + 1, case when down then lo else (lo + hi) / 2 end, case when down then (lo + hi) / 2 else hi end
  from (
    select b.k, b.lo, b.hi,
      ln(sum(pow(t.tokens::double, (b.lo + b.hi) / 2))) - sum(pow(t.tokens::double, (b.lo + b.hi) / 2) * ln(pow(t.tokens::double, (b.lo + b.hi) / 2))) / sum(pow(t.tokens::double, (b.lo + b.hi) / 2))
        < {m.entropy_share} * ln(count(*)::double)
      and pow(max(t.tokens)::double / min(t.tokens), 1 - (b.lo + b.hi) / 2) < {m.repetition_limit} as down
    from bisect b, totals t where t.tokens > 0 and b.k < 30 group by b.k, b.lo, b.hi)),
unheated as (select ln(sum(tokens::double)) - sum(tokens::double * ln(tokens::double)) / sum(tokens::double) < {m.entropy_share} * ln(count(*)::double) as down from totals where tokens > 0),
chosen as (select case when (select down from unheated) then (select hi from bisect where k = 30) else 1.0 end as alpha),
scales as (select max(tokens / pow(tokens::double, alpha)) as scale from totals, chosen where tokens > 0),
sources as (
  select source, tokens as source_tokens, case when tokens > 0 then greatest(tokens, cast(round(pow(tokens::double, alpha) * scale) as bigint)) else 0 end as budget
  from totals, chosen, scales),
blocks as (select greatest(1, cast(ceil(coalesce(sum(budget), 0) / {m.block_tokens}) as bigint)) as n from sources),
copies as (
  select u.*, s.source_tokens, s.budget, unnest(range(0, case when source_tokens > 0 then cast(ceil(budget / source_tokens) as bigint) else 1 end)) as epoch
  from units u join sources s using (source)),
keyed as (select *, md5(coalesce(cast(doc_id as varchar), '') || ':' || text_md5 || ':' || cast(epoch as varchar)) as order_key from copies),
placed as (
  select *, epoch * source_tokens + cast(coalesce(sum(tokens * n_same) over (partition by source, epoch order by order_key rows between unbounded preceding and 1 preceding), 0) as bigint) as stream_at
  from keyed),
kept as (select p.*, least(b.n - 1, case when budget > 0 then cast(stream_at * b.n // budget as bigint) else cast(('0x' || substr(order_key, 1, 7)) as bigint) * b.n // 268435456 end) as block_id from placed p, blocks b where epoch = 0 or stream_at < budget),
positions as (
  select *, cast(coalesce(sum(n_same) over (partition by block_id order by reverse(order_key), source rows between unbounded preceding and 1 preceding), 0) as bigint) as position
  from kept)
select doc_id, source, cast(epoch as integer) as epoch, block_id, position + unnest(range(0, n_same)) as position, tokens from positions"""

"""Queries over images."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import kernels, raster
from lectern.plans import fixtures as X
from lectern.plans.registry import query

R = X.RASTER


@query("raster_stats", f"with {R} select vec_id, avg(px) as mean, round(stddev_pop(px), 6) as contrast from raster group by 1")
def _(spark, sf_dir):
    return raster.stats(X.raster(spark, sf_dir)).withColumn("contrast", F.round("contrast", 6))


@query("raster_histogram", f"with {R} select vec_id, px as bin, cast(count(*) as bigint) as n from raster group by 1, 2")
def _(spark, sf_dir):
    return raster.histogram(X.raster(spark, sf_dir))


OTSU = """h as (select vec_id, px as bin, count(*) as n from raster group by 1, 2),
w as (select vec_id, bin, sum(n) over u as n0, sum(n * bin) over u as s0, sum(n) over t as n, sum(n * bin) over t as s from h window u as (partition by vec_id order by bin rows unbounded preceding), t as (partition by vec_id)),
b as (select vec_id, bin, case when n0 < n then pow(cast(s0 * n - s * n0 as double), 2) / (n0 * (n - n0)) else 0 end as v from w)"""


@query("raster_otsu", f"with {R}, {OTSU} select vec_id, bin as threshold from b qualify row_number() over (partition by vec_id order by v desc, bin) = 1")
def _(spark, sf_dir):
    return raster.otsu(X.raster(spark, sf_dir))


@query("raster_contrast", f"with {R}, m as (select vec_id, floor(avg(px) + 0.5) as m from raster group by 1) select vec_id, x, y, cast(least(255, greatest(0, floor(m + 2.0 * (px - m) + 0.5))) as integer) as px from raster join m using (vec_id)")
def _(spark, sf_dir):
    return raster.contrast(X.raster(spark, sf_dir))


MASK = f"{R}, lit as (select vec_id, cast(floor(quantile_cont(px, 0.95)) as integer) as p95 from raster group by 1), mask as (select r.vec_id, x, y, p95 from raster r join lit using (vec_id) where px < greatest(0, least(250, p95 - 45)))"


@query("raster_p95_mask", f"with {MASK} select vec_id, p95, cast(greatest(0, least(250, p95 - 45)) as integer) as level, cast((select count(*) from mask m where m.vec_id = lit.vec_id) as bigint) as n_dark from lit")
def _(spark, sf_dir):
    pixels = X.raster(spark, sf_dir)
    counts = raster.foreground(pixels).groupBy("vec_id").agg(F.count("*").alias("n_dark"))
    return raster.dark_threshold(pixels).join(counts, "vec_id", "left").na.fill(0, ["n_dark"])


@query("raster_dilate", f"with {MASK} select distinct m.vec_id, r.x, r.y from mask m join raster r on r.vec_id = m.vec_id and abs(r.x - m.x) <= 1 and abs(r.y - m.y) <= 1")
def _(spark, sf_dir):
    return raster.foreground(X.raster(spark, sf_dir), dilate=1)


BOX = """box as (select vec_id, greatest(0, min(x) - 1) as "left", greatest(0, min(y) - 1) as top, least(8, max(x) + 2) as "right", least(8, max(y) + 2) as bottom from mask group by 1),
kept as (select * from box where ("right" - "left") * (bottom - top) / 64 >= 0.2)"""


def _boxes(pixels):
    return raster.crop_box(raster.foreground(pixels), raster.sizes(pixels), padding=1, least_share=0.2)


@query("raster_bbox", f"with {MASK}, {BOX} select * from kept")
def _(spark, sf_dir):
    return _boxes(X.raster(spark, sf_dir))


@query("raster_clip", f"""with {MASK}, {BOX} select r.vec_id, r.x - "left" as x, r.y - top as y, px from raster r join kept k using (vec_id) where r.x >= "left" and r.x < "right" and r.y >= top and r.y < bottom""")
def _(spark, sf_dir):
    pixels = X.raster(spark, sf_dir)
    return raster.apply_crop(pixels, _boxes(pixels))


@query("raster_gray", f"with {R} select a.vec_id, a.x, a.y, cast(floor(0.299::double * a.px + 0.587::double * b.px + 0.114::double * c.px + 0.5::double) as integer) as px from raster a join raster b on b.vec_id = a.vec_id + 1 and b.x = a.x and b.y = a.y join raster c on c.vec_id = a.vec_id + 2 and c.x = a.x and c.y = a.y")
def _(spark, sf_dir):
    pixels = X.raster(spark, sf_dir)
    channel = lambda k, name: pixels.select((F.col("vec_id") - k).alias("vec_id"), "x", "y", F.col("px").alias(name))
    joined = channel(0, "r").join(channel(1, "g"), ["vec_id", "x", "y"]).join(channel(2, "b"), ["vec_id", "x", "y"])
    return joined.select("vec_id", "x", "y", raster.gray(F.col("r"), F.col("g"), F.col("b")).alias("px"))


@query("raster_laplacian_var", f"""with {R}, n as (select r.vec_id, r.px,
  (select px from raster q where q.vec_id = r.vec_id and q.y = r.y and q.x = case when r.x = 0 then 1 else r.x - 1 end) as l, (select px from raster q where q.vec_id = r.vec_id and q.y = r.y and q.x = case when r.x = 7 then 6 else r.x + 1 end) as rr,
  (select px from raster q where q.vec_id = r.vec_id and q.x = r.x and q.y = case when r.y = 0 then 1 else r.y - 1 end) as u, (select px from raster q where q.vec_id = r.vec_id and q.x = r.x and q.y = case when r.y = 7 then 6 else r.y + 1 end) as d from raster r)
select vec_id, round(var_pop(l + rr + u + d - 4 * px), 6) as blur from n group by 1""")
def _(spark, sf_dir):
    return raster.laplacian_variance(X.raster(spark, sf_dir)).withColumn("blur", F.round("blur", 6))


def _images(spark, sf_dir):
    """Whole images from pixels; 64 per image."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "px"))), lambda c: F.lpad(F.hex(c["px"].cast("bigint")), 2, "0"))
    rows = X.raster(spark, sf_dir).groupBy(F.col("vec_id").alias("id")).agg(F.unhex(F.array_join(cells, "")).alias("pixels"))
    return rows.select("id", F.lit(8).alias("width"), F.lit(8).alias("height"), "pixels")


@query("raster_components", f"""with recursive {R}, dark as (select vec_id, x, y, y * 8 + x as cell from raster where px < 110),
touch as (select a.vec_id, a.cell, b.cell as near from dark a join dark b on a.vec_id = b.vec_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
reach as (select vec_id, cell, cell as root from dark union select t.vec_id, t.near, r.root from reach r join touch t on t.vec_id = r.vec_id and t.cell = r.cell),
named as (select vec_id, cell, min(root) as root from reach group by 1, 2)
select vec_id as id, cast(min(d.x) as integer) as x, cast(min(d.y) as integer) as y, cast(max(d.x) - min(d.x) + 1 as integer) as w, cast(max(d.y) - min(d.y) + 1 as integer) as h, cast(count(*) as integer) as area from named join dark d using (vec_id, cell) group by vec_id, root""")
def _(spark, sf_dir):
    return kernels.components(_images(spark, sf_dir), 110).drop("label")


@query("component_filter", """with c as (select vec_id as label, cast(vec_id % 5 * 40 as integer) as x, cast(vec_id % 7 * 25 as integer) as y, cast(vec_id * 37 % 190 + 3 as integer) as w, cast(vec_id * 13 % 29 + 2 as integer) as h, cast((vec_id * 37 % 190 + 3) * (vec_id * 13 % 29 + 2) // 2 as integer) as area, 300 as width, 200 as height from embeddings)
select * from c where area >= 250 and not ((x = 0 or y = 0 or x + w >= width or y + h >= height) and ((h <= greatest(12, height * 0.05) and (w >= width * 0.25 or w >= h * 12)) or (w <= greatest(12, width * 0.05) and (h >= height * 0.25 or h >= w * 12))))""")
def _(spark, sf_dir):
    k = F.col("vec_id")
    table = X.table(spark, sf_dir, "embeddings").select(k.alias("label"), (k % 5 * 40).cast("int").alias("x"), (k % 7 * 25).cast("int").alias("y"), (k * 37 % 190 + 3).cast("int").alias("w"), (k * 13 % 29 + 2).cast("int").alias("h"), F.floor((k * 37 % 190 + 3) * (k * 13 % 29 + 2) / 2).cast("int").alias("area"), F.lit(300).alias("width"), F.lit(200).alias("height"))
    return raster.keep_components(table)


@query("raster_denoise_pipeline")
def _(spark, sf_dir):
    small = kernels.Settings(padding=0, dilate=1, crop_area=2, border=1, speck_area=2, sigma=3.0)
    spread = _images(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return kernels.prepare_images(spread, small)

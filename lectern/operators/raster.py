"""Raster operators over pixel tables (image, x, y, px), all relational.

A pixel table has one row per pixel, so histograms, thresholds and boxes are aggregates
and stencils are sums over shifted pixels; images of any number and size spread over the
cluster.  What has no relational form is in :mod:`lectern.operators.kernels`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.edges import long_thin_at_edge

IMAGE = "vec_id"


def gray(red: Column, green: Column, blue: Column) -> Column:
    return F.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5).cast("int")


def clip(value: Column) -> Column:
    """Rounded and bounded to a byte."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(value + 0.5))).cast("int")


def stats(pixels: DataFrame, image: str = IMAGE) -> DataFrame:
    """Mean and population deviation."""
    return pixels.groupBy(image).agg(F.avg("px").alias("mean"), F.stddev_pop("px").alias("contrast"))


def contrast(pixels: DataFrame, factor: float = 2.0, image: str = IMAGE) -> DataFrame:
    """Distances from the rounded mean times ``factor``."""
    middle = pixels.groupBy(image).agg(F.floor(F.avg("px") + 0.5).alias("m"))
    return pixels.join(middle, image).withColumn("px", clip(F.col("m") + factor * (F.col("px") - F.col("m")))).drop("m")


def histogram(pixels: DataFrame, image: str = IMAGE) -> DataFrame:
    return pixels.groupBy(image, F.col("px").alias("bin")).agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame, image: str = IMAGE) -> DataFrame:
    """The grey level that parts dark from light with the greatest variance between them.

    The smallest of equal ones; a constant image's own level.  Dark is up to the level.
    """
    counts = histogram(pixels, image)
    upto = Window.partitionBy(image).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(image)
    weighed = counts.select(image, "bin", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("s"))
    # n0 n1 (m0 - m1)^2 = (s0 n - s n0)^2 / (n0 n1), compared exactly as far as doubles go
    gap = (F.col("s0") * F.col("n") - F.col("s") * F.col("n0")).cast("double")
    between = F.when(F.col("n0") < F.col("n"), gap * gap / (F.col("n0") * (F.col("n") - F.col("n0")))).otherwise(0.0)
    best = F.row_number().over(Window.partitionBy(image).orderBy(F.desc("between"), "bin"))
    return weighed.withColumn("between", between).withColumn("rank", best).where("rank = 1").select(image, F.col("bin").alias("threshold"))


def dark_threshold(pixels: DataFrame, dark_delta: int = 45, image: str = IMAGE) -> DataFrame:
    """Foreground is what is darker than the image's light level by ``dark_delta``."""
    light = F.floor(F.percentile("px", F.lit(0.95)))
    level = F.greatest(F.lit(0), F.least(F.lit(250), F.col("p95") - dark_delta)).cast("int")
    return pixels.groupBy(image).agg(light.cast("int").alias("p95")).withColumn("level", level)


def foreground(pixels: DataFrame, dark_delta: int = 45, dilate: int = 0, image: str = IMAGE) -> DataFrame:
    """Pixels of the mask (image, x, y), widened by ``dilate`` on each side within the image."""
    mask = pixels.join(dark_threshold(pixels, dark_delta, image), image).where("px < level").select(image, "x", "y")
    if not dilate:
        return mask
    span = F.sequence(F.lit(-dilate), F.lit(dilate))
    wide = mask.withColumn("dx", F.explode(span)).withColumn("dy", F.explode(span)).select(image, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).distinct()
    return wide.join(pixels.select(image, "x", "y"), [image, "x", "y"], "left_semi")


def crop_box(mask: DataFrame, sizes: DataFrame, padding: int = 20, least_share: float = 0.01, image: str = IMAGE) -> DataFrame:
    """Padded box of each mask within (image, width, height); none for an empty or a tiny one."""
    box = mask.groupBy(image).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).join(sizes, image)
    box = box.select(
        image,
        "width",
        "height",
        F.greatest(F.lit(0), F.col("x0") - padding).alias("left"),
        F.greatest(F.lit(0), F.col("y0") - padding).alias("top"),
        F.least(F.col("width"), F.col("x1") + padding + 1).alias("right"),
        F.least(F.col("height"), F.col("y1") + padding + 1).alias("bottom"),
    )
    share = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")) / (F.col("width") * F.col("height"))
    return box.where(share >= least_share).drop("width", "height")


def sizes(pixels: DataFrame, image: str = IMAGE) -> DataFrame:
    return pixels.groupBy(image).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def apply_crop(pixels: DataFrame, boxes: DataFrame, border: int = 0, image: str = IMAGE) -> DataFrame:
    """Pixels inside the box, less ``border`` on every side, renumbered; a box of no more than two borders is an error."""
    if border:
        thin = F.least(F.col("right") - F.col("left"), F.col("bottom") - F.col("top")) <= 2 * border
        boxes = boxes.withColumn("left", F.when(thin, F.raise_error(F.lit("a crop is too small for its border"))).otherwise(F.col("left")))
    inside = (F.col("x") >= F.col("left") + border) & (F.col("x") < F.col("right") - border) & (F.col("y") >= F.col("top") + border) & (F.col("y") < F.col("bottom") - border)
    return pixels.join(boxes, image).where(inside).select(image, (F.col("x") - F.col("left") - border).alias("x"), (F.col("y") - F.col("top") - border).alias("y"), "px")


def laplacian_variance(pixels: DataFrame, image: str = IMAGE) -> DataFrame:
    """Variance of the four-neighbour Laplacian; the border is mirrored without its edge.

    Neighbours come from windows along rows and columns, in which a missing one is the
    opposite one.
    """
    row, col = Window.partitionBy(image, "y").orderBy("x"), Window.partitionBy(image, "x").orderBy("y")
    left, right, up, down = F.lag("px").over(row), F.lead("px").over(row), F.lag("px").over(col), F.lead("px").over(col)
    near = pixels.select(image, "px", left.alias("l"), right.alias("r"), up.alias("u"), down.alias("d"))
    both = lambda a, b: F.coalesce(a, b, "px") + F.coalesce(b, a, "px")
    value = both("l", "r") + both("u", "d") - 4 * F.col("px")
    return near.select(image, value.alias("v")).groupBy(image).agg(F.var_pop("v").alias("blur"))


def likely_edges(components: DataFrame) -> Column:
    """Whether a component (x, y, w, h in an image of width, height) is a long thin one at the edge."""
    return long_thin_at_edge(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))


def keep_components(components: DataFrame, least_area: int = 250) -> DataFrame:
    return components.where((F.col("area") >= least_area) & ~likely_edges(components))

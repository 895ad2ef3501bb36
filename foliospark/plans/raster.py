"""Queries of the raster operators over the character grids of all documents."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import raster as R
from foliospark.plans.registry import register
from foliospark.sources.bridge import bridged, doc_lines, grid_pixels, page_rasters

EDITED = "edited as (select doc_id, page, x, y, (case when (doc_id + x + y) % 17 = 0 then 255 - grey else grey end)::int as other from grid_pixels)"
MASK = EDITED + ", mask as (select g.doc_id, g.page, g.x, g.y, grey, other, abs(grey - other) > 8 as changed from grid_pixels g join edited using (doc_id, page, x, y))"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The rasters, and the same with one pixel in seventeen inverted."""
    edited = lambda grey, doc, x, y: np.where((doc + x + y) % 17 == 0, 255 - grey, grey)
    return page_rasters(spark, sf_dir, packed=True), page_rasters(spark, sf_dir, edited, packed=True)


def mask(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return R.visual_diff(*sides(spark, sf_dir), fields=fields)


def total(line, value):
    """Sum of value(pixel) over a scanline."""
    return F.aggregate(line, F.lit(0).cast("long"), lambda acc, p: acc + value(p))


@register("a4_ink_stats", bridged("select doc_id, page, round(avg((255 - grey > 4)::int), 6) as ink_ratio, round(stddev_pop(grey), 6) as stddev from grid_pixels group by all"))
def ink_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ink_stats(grid_pixels(spark, sf_dir)).select("doc_id", "page", F.round("ink_ratio", 6).alias("ink_ratio"), F.round("stddev", 6).alias("stddev"))


@register("p14_classify_blank", bridged("""
select doc_id, page, case when count(*) < 10 and avg((255 - grey > 4)::int) = 0 then 'unknown' when avg((255 - grey > 4)::int) <= 0.005 and stddev_pop(grey) <= 5 then 'blank'
  when avg((255 - grey > 4)::int) <= 0.015 and stddev_pop(grey) <= 15 then 'near' else 'content' end as verdict from grid_pixels group by all"""))
def classify_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ink_stats(grid_pixels(spark, sf_dir)).select("doc_id", "page", R.classify_blank(F.col("ink_ratio"), F.col("stddev"), F.col("n") < 10).alias("verdict"))


@register("a5_content_bbox", bridged("select doc_id, page, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from grid_pixels where 255 - grey > 28 group by all"))
def content_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.content_bbox(grid_pixels(spark, sf_dir))


@register("j20_visual_diff_mask", bridged(f"with {MASK} select doc_id, page, y, count(*) as n, sum(changed::int)::bigint as n_changed from mask group by all"))
def visual_diff_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_changes(*sides(spark, sf_dir))


@register("a7_changed_ratio", bridged(f"with {MASK} select doc_id, page, round(avg(changed::int), 6) as ratio from mask group by all"))
def changed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.line_changes(*sides(spark, sf_dir))
    return lines.groupBy("doc_id", "page").agg(F.round(F.sum("n_changed") / F.sum("n"), 6).alias("ratio"))


@register("r1_blank_pages", bridged("""
with chars as (select doc_id, page, sum(length(trim(line))) as n from doc_lines group by all), ink as (select doc_id, page, avg((255 - grey > 4)::int) as i, stddev_pop(grey) as s from grid_pixels group by all)
select c.doc_id, c.page, case when n > 0 then 'content' when i is null then 'unknown' when i <= 0.005 and s <= 5 then 'blank' when i <= 0.015 and s <= 15 then 'near' else 'content' end as verdict
from chars c left join ink using (doc_id, page)"""))
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = doc_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("line"))).alias("n"))
    bare = chars.filter("n = 0")  # only their pixels are read
    ink = R.ink_stats(grid_pixels(spark, sf_dir).join(bare.select("doc_id", "page"), ["doc_id", "page"], "left_semi")).drop("n")
    verdict = F.when(F.col("ink_ratio").isNull(), "unknown").otherwise(R.classify_blank(F.col("ink_ratio"), F.col("stddev"), F.lit(False)))
    read = bare.join(ink, ["doc_id", "page"], "left").select("doc_id", "page", verdict.alias("verdict"))
    return chars.filter("n > 0").select("doc_id", "page", F.lit("content").alias("verdict")).unionByName(read)


@register("r3_heatmap", bridged(f"""with {MASK} select doc_id, page, sum(case when changed then floor(other * 0.45 + 255 * 0.55 + 0.5) else other end)::bigint as r,
  sum(case when changed then floor(other * 0.45 + 0.5) else other end)::bigint as g from mask group by all"""))
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = lambda p: F.when(p["changed"], F.floor(p["other"] * 0.45 + 255 * 0.55 + 0.5)).otherwise(p["other"])
    rest = lambda p: F.when(p["changed"], F.floor(p["other"] * 0.45 + 0.5)).otherwise(p["other"])
    return mask(spark, sf_dir, "other", "changed").withColumn("p", F.flatten("rows")).select("doc_id", "page", total("p", red).alias("r"), total("p", rest).alias("g"))


@register("r4_tone_adjust", bridged("select doc_id, page, y, sum(greatest(0, least(255, round_even((grey - 128) * 1.25 + 128 + 10, 0))))::bigint as total from grid_pixels group by all"))
def tone_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_pixels(spark, sf_dir).groupBy("doc_id", "page", "y").agg(F.sum(R.tone_adjust(F.col("grey"), 10, 1.25)).alias("total"))


@register("r5_threshold", bridged("select doc_id, page, sum((grey >= 180)::int)::bigint as white from grid_pixels group by all"))
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_pixels(spark, sf_dir).groupBy("doc_id", "page").agg(F.count_if(F.when(F.col("grey") < 180, 0).otherwise(255) == 255).alias("white"))


LOCAL = """sums as (select *, sum(grey) over (partition by doc_id, page, y order by x range between 7 preceding and 7 following) as s, count(*) over (partition by doc_id, page, y order by x range between 7 preceding and 7 following) as n from grid_pixels),
local as (select *, sum(s) over w / sum(n) over w as mean from sums window w as (partition by doc_id, page, x order by y range between 7 preceding and 7 following))"""


@register("r6_local_mean", bridged(f"with {LOCAL} select doc_id, page, y, round(sum(mean), 3) as total from local group by all"))
def local_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.scanlines(R.local_mean(page_rasters(spark, sf_dir), 7), "means")
    return lines.select("doc_id", "page", "y", F.round(F.aggregate("line", F.lit(0.0), lambda acc, m: acc + m), 3).alias("total"))


@register("r7_flatten_adaptive", bridged(f"""with {LOCAL} select doc_id, page, sum(greatest(0, least(255, floor(grey - mean + 220 + 0.5))))::bigint as flat, sum((grey < mean - 12)::int)::bigint as dark from local group by all"""))
def flatten_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixel = lambda v, m: F.struct(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v - m + 220 + 0.5))).alias("flat"), (v < m - 12).cast("int").alias("dark"))
    pixels = R.local_mean(page_rasters(spark, sf_dir), 7).withColumn("p", F.zip_with(F.flatten("rows"), F.flatten("means"), pixel))
    return pixels.select("doc_id", "page", total("p", lambda p: p["flat"]).alias("flat"), total("p", lambda p: p["dark"]).alias("dark"))


@register("r8_deskew_search")
def deskew_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.deskew_search(page_rasters(spark, sf_dir))


_S, _C = math.sin(math.radians(2.0)), math.cos(math.radians(2.0))


@register("r9_rotate_raster", bridged(f"""
with box as (select doc_id, page, (max(x) + min(x)) / 2 as cx, (max(y) + min(y)) / 2 as cy from grid_pixels group by all),
moved as (select doc_id, page, x, y, floor((x - cx) * {_C}::double + (y - cy) * {_S}::double + cx + 0.5)::int as sx, floor((y - cy) * {_C}::double - (x - cx) * {_S}::double + cy + 0.5)::int as sy from grid_pixels join box using (doc_id, page))
select m.doc_id, m.page, m.y, sum(coalesce(g.grey, 255))::bigint as total from moved m left join grid_pixels g on g.doc_id = m.doc_id and g.page = m.page and g.x = sx and g.y = sy group by all"""))
def rotate_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.scanlines(R.rotate_raster(page_rasters(spark, sf_dir), 2.0))
    return lines.select("doc_id", "page", "y", total("line", lambda v: v).alias("total"))


@register("r2_change_regions")
def change_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.change_regions(mask(spark, sf_dir, "changed"))


@register("l5_cap_regions")
def cap_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 regions of each page, and whether there are more: the cap is the feature."""
    return R.first_regions(R.change_regions(mask(spark, sf_dir, "changed")), 200)


@register("a6_region_spread", bridged("""
with m as (select doc_id, page, page % 3 as x0, 0 as y0, 20 as w, 5 as h from doc_pages)
select m.doc_id, m.page, (max(grey) - min(grey))::int as spread, max(grey) - min(grey) > 40 as uneven from m join grid_pixels g on g.doc_id = m.doc_id and g.page = m.page
  and g.x >= x0 and g.x < x0 + w and (g.x - x0) % 4 = 1 and g.y >= y0 and g.y < y0 + h group by all"""))
def region_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.sources.bridge import doc_pages

    marks = doc_pages(spark, sf_dir).select("doc_id", "page", (F.col("page") % 3).alias("x0"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + 20) & ((F.col("x") - F.col("x0")) % 4 == 1) & (F.col("y") < 5)
    got = grid_pixels(spark, sf_dir).join(marks, ["doc_id", "page"]).filter(inside).groupBy("doc_id", "page").agg((F.max("grey") - F.min("grey")).alias("spread"))
    return got.withColumn("uneven", F.col("spread") > 40)

"""Page manifests, geometry, ranges, outlines and trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.storage import checkpointed


def page_catalog(pages: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, num_pages, bytes, fingerprint): the fingerprint is that of the first 64 KiB."""
    content = F.col("content")
    infos = files.select("doc_id", F.length(content).cast("long").alias("bytes"), F.sha2(F.substring(content, 1, 65_536), 256).alias("fingerprint"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("num_pages")).join(infos, "doc_id")


def visible_geometry(pages: DataFrame) -> DataFrame:
    """pages with geom: the crop box or the whole page, the rotation in quarter turns, and the size as shown."""
    box = F.coalesce("crop", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h")))
    turn = F.pmod(F.floor(F.col("rotation") / 90 + 0.5) * 90, F.lit(360)).cast("int")
    across = turn.isin(90, 270)
    shown = F.struct(box["x"].alias("x"), box["y"].alias("y"), box["w"].alias("w"), box["h"].alias("h"), turn.alias("rotate"),
                     F.when(across, box["h"]).otherwise(box["w"]).alias("visual_w"), F.when(across, box["w"]).otherwise(box["h"]).alias("visual_h"))
    return pages.withColumn("geom", shown)


def visual_to_page(vx: Column, vy: Column, geom: Column) -> Column:
    """struct<x,y>: a point of the page as shown, in the page's own space."""
    pick = lambda a, b, c, d: F.when(geom["rotate"] == 90, b).when(geom["rotate"] == 180, c).when(geom["rotate"] == 270, d).otherwise(a)
    return F.struct(
        (geom["x"] + pick(vx, geom["w"] - vy, geom["w"] - vx, vy)).alias("x"),
        (geom["y"] + pick(vy, vx, geom["h"] - vy, geom["h"] - vx)).alias("y"),
    )


def anchor_point(position: Column, geom: Column, w: Column, h: Column, margin: float) -> Column:
    """struct<vx,vy> of a box at one of nine places, e.g. `top-left`, `middle-center`."""
    row, col = F.split(position, "-")[0], F.split(position, "-")[1]
    vx = F.when(col == "left", F.lit(margin)).when(col == "center", (geom["visual_w"] - w) / 2).otherwise(geom["visual_w"] - w - margin)
    vy = F.when(row == "bottom", F.lit(margin)).when(row == "middle", (geom["visual_h"] - h) / 2).otherwise(geom["visual_h"] - h - margin)
    return F.struct(vx.alias("vx"), vy.alias("vy"))


def clamp_crop(nx: Column, ny: Column, nw: Column, nh: Column, geom: Column) -> Column:
    """struct<x,y,w,h,refusal>: a fraction rect as a box inside the page's; refused at one point or less."""
    left = F.greatest(geom["x"], geom["x"] + nx * geom["w"])
    right = F.least(geom["x"] + geom["w"], geom["x"] + (nx + nw) * geom["w"])
    top = F.least(geom["y"] + geom["h"], geom["y"] + (1 - ny) * geom["h"])
    bottom = F.greatest(geom["y"], geom["y"] + (1 - ny - nh) * geom["h"])
    return F.struct(left.alias("x"), bottom.alias("y"), (right - left).alias("w"), (top - bottom).alias("h"), F.when((right - left <= 1) | (top - bottom <= 1), "too-small").alias("refusal"))


def raster_scale(w: Column, h: Column, dpi: float, edge: float, pixels: float) -> Column:
    """struct<scale,clamped>."""
    wanted = F.lit(dpi / 72)
    scale = F.least(wanted, edge / F.greatest(w, h), F.sqrt(pixels / (w * h)))
    return F.struct(scale.alias("scale"), (scale < wanted).alias("clamped"))


def parse_ranges(specs: DataFrame, key: str, spec: str, most: str) -> DataFrame:
    """(key, error, range_no, page): pages of `1-3, 7`; where a part is bad, one row with the first error instead."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    flat = specs.select(key, most, F.posexplode_outer(parts).alias("range_no", "part"))
    a, b = F.regexp_extract("part", r"^(\d+)(?:\s*-\s*(\d+))?$", 1), F.regexp_extract("part", r"^(\d+)(?:\s*-\s*(\d+))?$", 2)
    a, b = a.try_cast("int"), F.coalesce(F.nullif(b, F.lit("")), a).try_cast("int")
    flat = flat.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    wrong = F.when(F.col("part").isNull(), "empty").when(~F.col("part").rlike(r"^(\d+)(?:\s*-\s*(\d+))?$"), F.concat(F.lit("bad:"), "part")).when((F.col("lo") < 1) | (F.col("hi") > F.col(most)), F.concat(F.lit("range:"), "part"))
    flat = flat.withColumn("error", wrong)
    pages = flat.filter("error is null").select(key, "range_no", F.explode(F.sequence("lo", "hi")).alias("page"))
    turn = F.row_number().over(Window.partitionBy(key, "page").orderBy("range_no"))
    twice = pages.withColumn("n", turn).filter("n > 1").select(key, "range_no", "page", F.concat(F.lit("overlap:"), F.col("page").cast("string")).alias("error"))
    errors = flat.filter("error is not null").select(key, F.coalesce("range_no", F.lit(0)).alias("range_no"), F.lit(0).alias("page"), "error").unionByName(twice)
    first = errors.groupBy(key).agg(F.min_by("error", F.struct("range_no", "page")).alias("error"))
    fine = pages.join(first, key, "left_anti").select(key, F.lit(None).cast("string").alias("error"), "range_no", "page")
    none = F.lit(None).cast("int")
    return fine.unionByName(first.select(key, "error", none.alias("range_no"), none.alias("page")))


def compact_ranges(pages: DataFrame, key: str) -> DataFrame:
    """(key, spec): `1-3,7` for the distinct positive pages of each key."""
    distinct = pages.filter("page > 0").select(key, "page").distinct()
    island = distinct.withColumn("g", F.col("page") - F.row_number().over(Window.partitionBy(key).orderBy("page")))
    runs = island.groupBy(key, "g").agg(F.min("page").alias("a"), F.max("page").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    runs = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("r"))
    return runs.select(key, F.array_join(F.transform("r", lambda r: r["t"]), ",").alias("spec"))


def page_offsets(sources: DataFrame, group: str, order: str, pages: str) -> DataFrame:
    """sources with first: how many pages stand before each in its merged document; an empty one counts one."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sources.withColumn("first", F.coalesce(F.sum(F.greatest(F.col(pages), F.lit(1))).over(before), F.lit(0)).cast("long"))


def merge_docs(pages: DataFrame, group: Column, order: list[str]) -> DataFrame:
    """pages with merged and ordinal: their documents one after another."""
    named = pages.withColumn("merged", group)
    return named.withColumn("ordinal", F.row_number().over(Window.partitionBy("merged").orderBy(*order)))


def number_pages(pages: DataFrame, group: str, style: str = "n") -> DataFrame:
    """pages with label: the ordinal, alone or with the number of pages of the group (`n/total`)."""
    n = F.col("ordinal").cast("string")
    if style == "n":
        return pages.withColumn("label", n)
    total = F.count("*").over(Window.partitionBy(group))
    return pages.withColumn("label", F.concat(n, F.lit("/"), total.cast("string")))


def route_pages(pages: DataFrame, page_fn: Callable[[DataFrame], DataFrame], least: int = 32) -> DataFrame:
    """(doc_id, page, text): pages with fewer than `least` chars go through page_fn, the others have null text.

    page_fn: the caller's reader of scan pages, from (doc_id, page, chars) to (doc_id, page, text): DataFrame steps, a
    pandas UDF or mapInPandas around a model. Where it gives a page no row, or several, the query fails with the page's name.
    """
    key = ["doc_id", "page"]
    given = page_fn(pages.filter(F.col("chars") < least)).groupBy(*key).agg(F.count("*").alias("_n"), F.first("text").alias("text"))
    n, name = F.coalesce("_n", F.lit(0)), F.concat_ws("/", *key)
    due = F.when(F.col("chars") < least, 1).otherwise(0)
    wrong = F.raise_error(F.concat(F.lit("the page function gave "), n.cast("string"), F.lit(" results for page "), name))
    both = pages.join(given, key, "full_outer")
    return both.select(*key, F.when(n == F.coalesce(due, F.lit(0)), F.col("text")).otherwise(wrong.cast("string")).alias("text"))


def walk_tree(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth, path, cut) of all that is below the roots of (node, parent, ...), by doubling pointers.

    Each round a node that hasn't reached a root takes over the pointer of the one it points to, and the path between:
    after k rounds it has 2^k ancestors, so a tree of depth 1,000 takes ten joins. A path that meets a node twice is
    dropped: cycles are cut. Nodes whose ancestors end at a missing node aren't below a root, and aren't given. A node
    with several parents has a row for each of its paths.
    cut: max_depth is given, the node is at the last depth that it allows and has children, which aren't given.
    """
    state = nodes.select("node", F.col("parent").alias("up"), F.array("node").alias("path"))
    done, open_, reach = state.filter("up is null"), state.filter("up is not null"), 1
    while max_depth is None or reach < max_depth:
        at = done.unionByName(open_).select(F.col("node").alias("_at"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        joined = open_.join(at, F.col("up") == F.col("_at")).filter(~F.arrays_overlap("_path", "path"))
        stepped = checkpointed(joined.select("node", F.col("_up").alias("up"), F.concat("_path", "path").alias("path")))
        found, open_, reach = stepped.filter("up is null"), stepped.filter("up is not null"), reach * 2
        if found.isEmpty():  # a longer path would have one of this round's length before it
            break
        done = done.unionByName(found)
        if open_.isEmpty():
            break
    out = done.select("node", (F.size("path") - 1).alias("depth"), "path")
    if max_depth is None:
        return out.withColumn("cut", F.lit(False))
    parents = nodes.filter("parent is not null").select(F.col("parent").alias("_up")).distinct()
    last = out.filter(F.col("depth") < max_depth).join(parents, F.col("node") == F.col("_up"), "left")
    return last.select("node", "depth", "path", ((F.col("depth") == max_depth - 1) & F.col("_up").isNotNull()).alias("cut"))


def manifest_diff(a: DataFrame, b: DataFrame, key: str, revision: str) -> DataFrame:
    """(key, status): missing, extra or changed."""
    both = a.select(key, F.col(revision).alias("ra")).join(b.select(F.col(key).alias("kb"), F.col(revision).alias("rb")), F.col(key) == F.col("kb"), "full_outer")
    status = F.when(F.col("kb").isNull(), "missing").when(F.col(key).isNull(), "extra").when(F.col("ra") != F.col("rb"), "changed")
    return both.select(F.coalesce(key, "kb").alias(key), status.alias("status")).filter("status is not null")

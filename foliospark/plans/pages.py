"""Queries of the page, manifest and tree operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import pages as P
from foliospark.plans.registry import chain, register
from foliospark.sources.bridge import LINES_PER_PAGE, bridged, doc_pages
from foliospark.tables import table

GEOM = """geom as (select doc_id, page, coalesce(crop.x, 0.0) as gx, coalesce(crop.y, 0.0) as gy, coalesce(crop.w, width) as gw, coalesce(crop.h, height) as gh, rotation as rot,
  case when rotation in (90, 270) then coalesce(crop.h, height) else coalesce(crop.w, width) end as vw, case when rotation in (90, 270) then coalesce(crop.w, width) else coalesce(crop.h, height) end as vh from doc_pages)"""
N = "n as (select doc_id, max(page) as n from doc_pages group by doc_id)"

#: Documents that are merged: a hundred neighbours, however many documents there are.
VOLUME = "doc_id div 100"


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("n"))


@register("s3_scan_page_catalog", bridged("""select doc_id, count(*) as num_pages, any_value(octet_length(encode(text)))::bigint as bytes, any_value(sha256(encode(text)[1:65536])) as fingerprint
  from doc_pages join documents using (doc_id) group by doc_id"""))
def scan_page_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_catalog(doc_pages(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))


@register("p2_parse_page_ranges", bridged(f"""
with {N}, spec as (select doc_id, n, (doc_id % 3 + 1) as a, (doc_id % 5 + 1) as b, (doc_id % 7 + 1) as c from n),
o as (select *, case when greatest(a, b) > n then 'range:' || a || '-' || b when c > n then 'range:' || c when c between least(a, b) and greatest(a, b) then 'overlap:' || c end as error from spec)
select doc_id, error, case when error is null then r end::int as range_no, case when error is null then p end::int as page from (
  select doc_id, error, 0 as r, unnest(case when error is null then range(least(a, b), greatest(a, b) + 1) else [0] end) as p from o
  union all select doc_id, error, 1, c from o where error is null)"""))
def parse_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda m: (F.col("doc_id") % m + 1).cast("string")
    specs = counts(spark, sf_dir).withColumn("spec", F.concat(part(3), F.lit("-"), part(5), F.lit(", "), part(7)))
    return P.parse_ranges(specs, "doc_id", "spec", "n")


@register("p3_clamp_page_scope", bridged(f"with {N} select doc_id, list_sort(list_distinct(list_filter([doc_id % 5, 3, 1, 3, doc_id % 9], lambda p: p between 1 and n))) as scope from n"))
def clamp_page_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(F.col("doc_id") % 5, F.lit(3), F.lit(1), F.lit(3), F.col("doc_id") % 9)
    return counts(spark, sf_dir).select("doc_id", F.array_sort(F.array_distinct(F.filter(given, lambda p: (p >= 1) & (p <= F.col("n"))))).alias("scope"))


@register("p4_extract_pages", bridged("select doc_id, 3 - page as ordinal, page from doc_pages where page in (1, 2)"))
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = F.posexplode(F.array(F.lit(2), F.lit(1))).alias("i", "page")
    wanted = table(spark, sf_dir, "documents").select("doc_id", picks)
    return doc_pages(spark, sf_dir).select("doc_id", "page").join(wanted, ["doc_id", "page"]).select("doc_id", (F.col("i") + 1).alias("ordinal"), "page")


@register("p4_remove_pages", bridged("select doc_id, page, (row_number() over (partition by doc_id order by page))::int as ordinal from doc_pages where page != 2"))
def remove_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    drops = table(spark, sf_dir, "documents").select("doc_id", F.lit(2).alias("page"))
    left = doc_pages(spark, sf_dir).join(drops, ["doc_id", "page"], "left_anti")
    return left.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).alias("ordinal"))


@register("p5_rotate_pages", bridged("select doc_id, page, (case when page in (1, 3) then (rotation + 270) % 360 else rotation end)::int as rotation from doc_pages"))
def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("page").isin(1, 3), F.pmod(F.col("rotation") + 270, F.lit(360))).otherwise(F.col("rotation"))
    return doc_pages(spark, sf_dir).select("doc_id", "page", turned.cast("int").alias("rotation"))


@register("p6_visible_geometry", bridged(f"with {GEOM} select doc_id, page, gx::double as x, gy::double as y, gw::double as w, gh::double as h, rot as rotate, vw::double as visual_w, vh::double as visual_h from geom"))
def visible_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.visible_geometry(doc_pages(spark, sf_dir)).select("doc_id", "page", "geom.*")


@register("p7_visual_to_page_space", bridged(f"""with {GEOM} select doc_id, page, (gx + case rot when 90 then gw - 20 when 180 then gw - 10 when 270 then 20 else 10 end)::double as x,
  (gy + case rot when 90 then 10 when 180 then gh - 20 when 270 then gh - 10 else 20 end)::double as y from geom"""))
def visual_to_page_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.visible_geometry(doc_pages(spark, sf_dir)).select("doc_id", "page", P.visual_to_page(F.lit(10.0), F.lit(20.0), F.col("geom")).alias("p")).select("doc_id", "page", "p.*")


@register("p8_anchor_point", bridged(f"""with {GEOM} select doc_id, page, (case page % 3 when 0 then 36.0 when 1 then (vw - 100) / 2 else vw - 100 - 36 end)::double as vx,
  (case doc_id % 3 when 0 then 36.0 when 1 then (vh - 20) / 2 else vh - 20 - 36 end)::double as vy, ((rot - 45 + 360) % 360)::int as angle from geom"""))
def anchor_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.col(c) % 3 + 1).cast("int"))
    place = F.concat_ws("-", pick("doc_id", "bottom", "middle", "top"), pick("page", "left", "center", "right"))
    at = P.visible_geometry(doc_pages(spark, sf_dir)).withColumn("p", P.anchor_point(place, F.col("geom"), F.lit(100.0), F.lit(20.0), 36.0))
    return at.select("doc_id", "page", "p.vx", "p.vy", F.pmod(F.col("geom.rotate") - 45, F.lit(360)).cast("int").alias("angle"))


@register("p9_clamp_crop_box", bridged(f"""with {GEOM}, f as (select *, (doc_id % 10) / 10.0::double as nx, (page % 10) / 10.0::double as ny, (doc_id % 4) / 4.0::double as nw, 0.5::double as nh from geom),
b as (select *, greatest(gx, gx + nx * gw) as l, least(gx + gw, gx + (nx + nw) * gw) as r, least(gy + gh, gy + (1 - ny) * gh) as t, greatest(gy, gy + (1 - ny - nh) * gh) as bt from f)
select doc_id, page, round(l, 6) as x, round(bt, 6) as y, round(r - l, 6) as w, round(t - bt, 6) as h, case when r - l <= 1 or t - bt <= 1 then 'too-small' end as refusal from b"""))
def clamp_crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.visible_geometry(doc_pages(spark, sf_dir))
    b = P.clamp_crop((F.col("doc_id") % 10) / 10, (F.col("page") % 10) / 10, (F.col("doc_id") % 4) / 4, F.lit(0.5), F.col("geom"))
    return g.select("doc_id", "page", b.alias("b")).select("doc_id", "page", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"], "b.refusal")


@register("p15_raster_scale", bridged("""with s as (select doc_id, page, least(150.0 / 72, 1500.0 / 842, sqrt(2000000.0 / (width * height))) as scale from doc_pages)
select doc_id, page, round(scale, 6) as scale, scale < 150.0::double / 72 as clamped from s"""))
def raster_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.raster_scale(F.col("width"), F.col("height"), 150.0, 1500.0, 2_000_000.0)
    return doc_pages(spark, sf_dir).select("doc_id", "page", s.alias("s")).select("doc_id", "page", F.round("s.scale", 6).alias("scale"), "s.clamped")


@register("p16_allocation_gate", bridged(f"""with {N} select doc_id, case when n > 100 then 'pages' when ceil(842 * 300.0 / 72) > 4500 then 'edge' when ceil(595 * 300.0 / 72) * ceil(842 * 300.0 / 72) > 16000000 then 'page-pixels'
  when n * ceil(595 * 300.0 / 72) * ceil(842 * 300.0 / 72) > 20000000 then 'document-pixels' end as refusal from n"""))
def allocation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.ceil(F.lit(595 * 300 / 72)), F.ceil(F.lit(842 * 300 / 72))
    reason = F.when(F.col("n") > 100, "pages").when(h > 4500, "edge").when(w * h > 16_000_000, "page-pixels").when(F.col("n") * w * h > 20_000_000, "document-pixels")
    return counts(spark, sf_dir).select("doc_id", reason.alias("refusal"))


@register("p17_preset_scope", bridged("select doc_id, page from doc_pages where page >= case when doc_id % 2 = 0 then 2 else 1 end"))
def preset_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).filter(F.col("page") >= F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).select("doc_id", "page")


@register("p10_mark_to_rect", bridged("select doc_id, page, round((page % 7) / 10.0::double * width, 6) as x, round((1 - (doc_id % 5) / 10.0::double - 0.2) * height, 6) as y, round(0.3::double * width, 6) as w, round(0.2::double * height, 6) as h from doc_pages"))
def mark_to_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.operators.redact import mark_to_rect as rect

    marks = doc_pages(spark, sf_dir).select("*", ((F.col("page") % 7) / 10).alias("nx"), ((F.col("doc_id") % 5) / 10).alias("ny_top"), F.lit(0.3).alias("nw"), F.lit(0.2).alias("nh"))
    return rect(marks).select("doc_id", "page", *[F.round(c, 6).alias(c) for c in "xywh"])


@register("p13_pad_box", bridged("""with b as (select doc_id, page, (page % 7) / 10.0::double as x0, (doc_id % 5) / 10.0::double as y0 from doc_pages)
select doc_id, page, round(greatest(0, x0 - 0.02), 6) as x0, round(greatest(0, y0 - 0.02), 6) as y0, round(least(1, x0 + 0.3 + 0.02), 6) as x1, round(least(1, y0 + 0.9 + 0.02), 6) as y1 from b"""))
def pad_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("page") % 7) / 10, (F.col("doc_id") % 5) / 10
    low, high = lambda c: F.round(F.greatest(F.lit(0.0), c - 0.02), 6), lambda c: F.round(F.least(F.lit(1.0), c + 0.02), 6)
    return doc_pages(spark, sf_dir).select("doc_id", "page", low(x0).alias("x0"), low(y0).alias("y0"), high(x0 + 0.3).alias("x1"), high(y0 + 0.9).alias("y1"))


@register("w21_compact_ranges", bridged("""with p as (select distinct doc_id, page from doc_pages where page % 4 != 3), g as (select doc_id, page, page - row_number() over (partition by doc_id order by page) as g from p),
r as (select doc_id, min(page) as a, max(page) as b from g group by doc_id, g) select doc_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as spec from r group by doc_id"""))
def compact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compact_ranges(doc_pages(spark, sf_dir).filter("page % 4 != 3"), "doc_id")


SOURCES = "src as (select doc_id // 100 as merged, doc_id, n from n)"


@register("w15_page_offsets", bridged(f"with {N}, {SOURCES} select merged, doc_id, coalesce(sum(greatest(n, 1)) over (partition by merged order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as first from src"))
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = counts(spark, sf_dir).withColumn("merged", F.expr(VOLUME))
    return P.page_offsets(sources, "merged", "doc_id", "n").select("merged", "doc_id", "first")


@register("u1_merge_docs", bridged("select doc_id // 100 as merged, (row_number() over (partition by doc_id // 100 order by doc_id, page))::int as ordinal, doc_id, page from doc_pages"))
def merge_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_docs(doc_pages(spark, sf_dir), F.expr(VOLUME), ["doc_id", "page"]).select("merged", "ordinal", "doc_id", "page")


@register("u2_merge_selected", bridged("select doc_id // 100 as merged, (row_number() over (partition by doc_id // 100 order by doc_id, page))::int as ordinal, doc_id, page from doc_pages where page % 2 = doc_id % 2"))
def merge_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = counts(spark, sf_dir).select("doc_id", F.explode(F.filter(F.sequence(F.lit(1), "n"), lambda p: p % 2 == F.col("doc_id") % 2)).alias("page"))
    return P.merge_docs(doc_pages(spark, sf_dir).join(picks, ["doc_id", "page"]), F.expr(VOLUME), ["doc_id", "page"]).select("merged", "ordinal", "doc_id", "page")


@register("u3_split_ranges", bridged("select doc_id, part, page, (row_number() over (partition by doc_id, part order by page))::int as ordinal from (select doc_id, case when page <= 2 then 0 else 1 end as part, page from doc_pages)"))
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(0, 1, 2), (1, 3, 2**30)], "part int, lo int, hi int")  # a stated list
    parts = doc_pages(spark, sf_dir).join(F.broadcast(ranges), F.col("page").between(F.col("lo"), F.col("hi")))
    return parts.select("doc_id", "part", "page", F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("page")).alias("ordinal"))


@register("u4_duplicate_pages", bridged("""with m as (select doc_id, page, page * 2 as k, 'page' as kind from doc_pages union all select doc_id, page, page * 2 + 1, 'copy' from doc_pages where page = 1 union all select distinct doc_id, 0, 0, 'blank' from doc_pages)
select doc_id, (row_number() over (partition by doc_id order by k))::int as ordinal, page::int as page, kind from m"""))
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir).select("doc_id", "page")
    all_ = pages.select("doc_id", "page", (F.col("page") * 2).alias("k"), F.lit("page").alias("kind"))
    all_ = all_.unionByName(pages.filter("page = 1").select("doc_id", "page", (F.col("page") * 2 + 1).alias("k"), F.lit("copy").alias("kind")))
    all_ = all_.unionByName(pages.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("k"), F.lit("blank").alias("kind")))
    return all_.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("k")).alias("ordinal"), "page", "kind")


@register("j15_reorder_pages", bridged(f"with {N} select doc_id, (n - page + 1)::int as ordinal, page from doc_pages join n using (doc_id)"))
def reorder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = counts(spark, sf_dir).select("doc_id", F.posexplode(F.reverse(F.sequence(F.lit(1), "n"))).alias("i", "page"))
    return doc_pages(spark, sf_dir).select("doc_id", "page").join(order, ["doc_id", "page"]).select("doc_id", (F.col("i") + 1).alias("ordinal"), "page")


@register("j13_remap_outline", bridged(f"""with {N}, {SOURCES}, o as (select merged, doc_id, coalesce(sum(n) over (partition by merged order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as first from src)
select merged, doc_id, page + first as dest_page from doc_pages join o using (doc_id) where page % 3 = 1"""))
def remap_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = P.page_offsets(counts(spark, sf_dir).withColumn("merged", F.expr(VOLUME)), "merged", "doc_id", "n")
    nodes = doc_pages(spark, sf_dir).filter("page % 3 = 1").select("doc_id", "page")
    return nodes.join(sources, "doc_id").select("merged", "doc_id", (F.col("page") + F.col("first")).alias("dest_page"))


@register("j14_resolve_destinations", bridged("""with m as (select doc_id, page, row_number() over (partition by doc_id order by page desc) as ordinal from doc_pages where page != 2), l as (select doc_id, page as from_page, page + 1 as page from doc_pages)
select l.doc_id, from_page, min(ordinal)::int as out_page, min(ordinal) is null as unresolved from l left join m using (doc_id, page) group by all"""))
def resolve_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = doc_pages(spark, sf_dir).filter("page != 2").withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("page"))))
    first = out.groupBy("doc_id", "page").agg(F.min("ordinal").alias("out_page"))
    links = doc_pages(spark, sf_dir).select("doc_id", F.col("page").alias("from_page"), (F.col("page") + 1).alias("page"))
    return links.join(first, ["doc_id", "page"], "left").select("doc_id", "from_page", "out_page", F.col("out_page").isNull().alias("unresolved"))


@register("j16_manifest_diff", """with a as (select o_orderkey as k, o_orderstatus as r from orders where o_orderkey % 10 != 0), b as (select o_orderkey as k, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as r from orders where o_orderkey % 9 != 0)
select coalesce(a.k, b.k) as o_orderkey, case when b.k is null then 'missing' when a.k is null then 'extra' else 'changed' end as status from a full outer join b using (k) where a.k is null or b.k is null or a.r != b.r""".replace("using (k)", "on a.k = b.k"))
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    b = orders.filter("o_orderkey % 9 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return P.manifest_diff(orders.filter("o_orderkey % 10 != 0"), b, "o_orderkey", "o_orderstatus")


TREE = """nodes as (select 'r' || r_regionkey as node, null as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, their nations and their suppliers: node, parent."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nations = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("node"), name("r", "n_regionkey").alias("parent"))
    return regions.unionByName(nations).unionByName(table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("node"), name("n", "s_nationkey").alias("parent")))


@register("j24_walk_tree", f"""with recursive {TREE}, walk as (select node, 0 as depth, node as path from nodes where parent is null
  union all select n.node, depth + 1, path || '/' || n.node from nodes n join walk w on n.parent = w.node) select node, depth, path from walk""")
def walk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.walk_tree(tree(spark, sf_dir)).select("node", "depth", F.array_join("path", "/").alias("path"))


@register("s10_read_outline", bridged("""with o as (select doc_id, page as node, case when doc_id % 4 = 0 then page + 1 else page end as dest from doc_pages)
select o.doc_id, node, p.page as dest_page from o left join doc_pages p on p.doc_id = o.doc_id and p.page = dest"""))
def read_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = doc_pages(spark, sf_dir).select("doc_id", "page")
    outline = pages.select("doc_id", F.col("page").alias("node"), F.when(F.col("doc_id") % 4 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"))
    return outline.join(pages.withColumn("dest_page", F.col("page")), ["doc_id", "page"], "left").select("doc_id", "node", "dest_page")


@register("a16_source_refcount", "select l_partkey, count(distinct l_orderkey || '-' || l_linenumber) as refs from lineitem group by l_partkey")
def source_refcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey", "l_linenumber").alias("refs"))


@register("j25_parity_check", bridged(f"""with {N}, a as (select doc_id, n, array_to_string(string_split(text, chr(10))[1:{LINES_PER_PAGE}], chr(10)) as t from n join documents using (doc_id)), b as (select doc_id, case when doc_id % 5 = 0 then n + 1 else n end as m, case when doc_id % 7 = 0 then 'x' else t end as u, doc_id % 11 = 0 as signed from a)
select doc_id, case when signed then 'signed' when m = 0 then 'empty' when m != n then 'page-count' when u != t then 'first-page-text' end as reason from a join b using (doc_id)"""))
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = counts(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 1, LINES_PER_PAGE), "\n").alias("t")), "doc_id")
    after = before.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("m"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("t")).alias("u"), (F.col("doc_id") % 11 == 0).alias("signed"))
    reason = F.when(F.col("signed"), "signed").when(F.col("m") == 0, "empty").when(F.col("m") != F.col("n"), "page-count").when(F.col("u") != F.col("t"), "first-page-text")
    return before.join(after, "doc_id").select("doc_id", reason.alias("reason"))


@register("p20_classify_health", """select event_id, event_type != 'error' as readable, event_type = 'error' and value > 50 as encrypted, len(string_split(props, ',')) > 1 as warned from events""")
def classify_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("event_type") == "error", F.when(F.col("value") > 50, "No Password given").otherwise("bad xref"))
    locked = F.coalesce(message.rlike("(?i)password"), F.lit(False))
    return table(spark, sf_dir, "events").select("event_id", message.isNull().alias("readable"), locked.alias("encrypted"), (F.size(F.split("props", ",")) > 1).alias("warned"))


@register("v4_chain", bridged("""with m as (select doc_id // 100 as merged, row_number() over (partition by doc_id // 100 order by doc_id, page) as ordinal, doc_id, page from doc_pages)
select merged, ordinal::int as ordinal, doc_id, page, ordinal || '/' || count(*) over (partition by merged) as label from m"""))
def merge_and_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [(P.merge_docs, {"group": F.expr(VOLUME), "order": ["doc_id", "page"]}), (P.number_pages, {"group": "merged", "style": "n/total"})]
    return chain(doc_pages(spark, sf_dir), steps).select("merged", "ordinal", "doc_id", "page", "label")

"""Queries of the layout operators over the items of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators import layout as L
from foliospark.operators.redact import keyword_hits
from foliospark.plans.registry import register
from foliospark.sources import bridge
from foliospark.sources.bridge import bridged
from foliospark.tables import table

BANDS = """banded as (select *, (sum(case when abs(pb - baseline) > greatest(2.0, size * 0.35) then 1 else 0 end) over (partition by doc_id, page order by baseline, x0))::int as band
  from (select *, lag(baseline) over (partition by doc_id, page order by baseline, x0) as pb from text_items)),
runs as (select *, (sum(case when x0 - px > 2.5 * greatest(ps, size) then 1 else 0 end) over (partition by doc_id, page, band order by x0))::int as run
  from (select *, lag(x1) over (partition by doc_id, page, band order by x0) as px, lag(size) over (partition by doc_id, page, band order by x0) as ps from banded))"""
RUN_TEXT = BANDS + r""", placed as (select *, case when x0 - qx > 0.2 * greatest(qs, size) and not regexp_matches(pstr, '\s$') and not regexp_matches(str, '^\s') then ' ' || str else str end as put
  from (select *, lag(x1) over w as qx, lag(size) over w as qs, lag(str) over w as pstr from runs window w as (partition by doc_id, page, band, run order by x0))),
run_text as (select doc_id, page, band, run, string_agg(put, '' order by x0) as text, count(*) as n_items, min(x0) as x0, max(x1) as x1, max(size) as size, avg(baseline) as baseline from placed group by all)"""
LINE = "lines as (select doc_id, page, baseline, max(size) as size, min(x0) as x0, string_agg(str, ' ' order by x0) as text from text_items group by all)"


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, baseline, size, x0, text: the items of a line joined."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "str"))), lambda p: p["str"]), " ")
    return bridge.text_items(spark, sf_dir).groupBy("doc_id", "page", "baseline").agg(F.max("size").alias("size"), F.min("x0").alias("x0"), text.alias("text"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan_text_items(bridge.raw_items(spark, sf_dir))


def sane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sanitise_items(scanned(spark, sf_dir))


@register("s1_scan_text_items", bridged("select doc_id, page, line_no, off, str, x0, x1, baseline, size, rotated from scanned"))
def scan_text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).drop("font_name")


@register("s2_scan_item_rects", bridged("select doc_id, page, line_no, x0 as x, 842.0::double - baseline as y, x1 - x0 as w, size as h from text_items"))
def scan_item_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.text_items(spark, sf_dir).select("doc_id", "page", "line_no", F.col("x0").alias("x"), (F.lit(bridge.HEIGHT) - F.col("baseline")).alias("y"), (F.col("x1") - F.col("x0")).alias("w"), F.col("size").alias("h"))


@register("p1_sanitise_items", bridged("select doc_id, page, line_no, count(*) as n from sane group by all"))
def sanitise_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sane(spark, sf_dir).groupBy("doc_id", "page", "line_no").agg(F.count("*").alias("n"))


@register("w1_band_rows_chain", bridged(f"with {BANDS} select doc_id, page, line_no, off, band from banded"))
def band_rows_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.banded(bridge.text_items(spark, sf_dir)).select("doc_id", "page", "line_no", "off", "band")


#: First fit spelled out: the rows' means and counts go from item to item of a page.
FIRST_FIT = """lists as (select doc_id, page, list({'b': baseline, 's': size, 'l': line_no, 'o': off, 'm': []::double[], 'n': []::bigint[], 'r': []::bigint[], 'at': 0::bigint} order by line_no, off) as items from sane group by all),
folded as (select doc_id, page, items, list_reduce(items, lambda acc, x: {'b': x.b, 's': x.s, 'l': x.l, 'o': x.o,
    'm': case when list_position(list_transform(acc.m, lambda m: abs(m - x.b) <= greatest(2.0, 0.35 * x.s)), true) is null then list_append(acc.m, x.b)
      else list_transform(acc.m, lambda m, i: case when i = list_position(list_transform(acc.m, lambda k: abs(k - x.b) <= greatest(2.0, 0.35 * x.s)), true) then m + (x.b - m) / (acc.n[i] + 1) else m end) end,
    'n': case when list_position(list_transform(acc.m, lambda m: abs(m - x.b) <= greatest(2.0, 0.35 * x.s)), true) is null then list_append(acc.n, 1)
      else list_transform(acc.n, lambda n, i: n + (i = list_position(list_transform(acc.m, lambda k: abs(k - x.b) <= greatest(2.0, 0.35 * x.s)), true))::bigint) end,
    'r': list_append(acc.r, coalesce(list_position(list_transform(acc.m, lambda m: abs(m - x.b) <= greatest(2.0, 0.35 * x.s)), true), len(acc.m) + 1)::bigint), 'at': 0::bigint},
  {'b': 0.0::double, 's': 0.0::double, 'l': 0, 'o': 0, 'm': []::double[], 'n': []::bigint[], 'r': []::bigint[], 'at': 0::bigint}) as f from lists),
placed as (select doc_id, page, unnest(items) as item, unnest(f.r) as r, f.m as m from folded)
select doc_id, page, item.l as line_no, item.o as off, len(list_filter(m, lambda y, i: y < m[r] or (y = m[r] and i < r)))::int as row_no from placed"""


@register("w2_band_rows_firstfit", bridged(f"with {FIRST_FIT}"))
def band_rows_firstfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_fit(sane(spark, sf_dir))


@register("w3_split_runs", bridged(f"with {BANDS} select doc_id, page, line_no, off, band, run from runs"))
def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_runs(L.banded(bridge.text_items(spark, sf_dir))).select("doc_id", "page", "line_no", "off", "band", "run")


@register("w4_words_from_items", bridged(r"""
with parts as (select doc_id, page, baseline, x0, str, regexp_split_to_array(str, '\s+') as p from text_items)
select doc_id, page, baseline, x0, str as text from parts where not regexp_matches(str, '\s')
union all select doc_id, page, baseline, x0 + 5 * (case when i = 1 then 0 else length(array_to_string(list_slice(list_filter(p, lambda x: x != ''), 1, i - 1), ' ')) + 1 end), t from (
  select *, unnest(list_filter(p, lambda x: x != '')) as t, generate_subscripts(list_filter(p, lambda x: x != ''), 1) as i from parts where regexp_matches(str, '\s'))"""))
def words_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.words_from_items(bridge.text_items(spark, sf_dir)).select("doc_id", "page", "baseline", "x0", "text")


@register("w5_run_text", bridged(f"with {RUN_TEXT} select doc_id, page, band, run, text, n_items, x0, x1 from run_text"))
def run_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.run_texts(bridge.text_items(spark, sf_dir)).select("doc_id", "page", "band", "run", "text", "n_items", "x0", "x1")


@register("p12_run_mark", bridged(f"""with {RUN_TEXT} select doc_id, page, band, run, round(greatest(0.0, (x0 - 0.2 * size) / 595), 6) as nx, round(greatest(0.0, (baseline - 0.9 * size) / 842), 6) as ny,
  round(least(1.0, (x1 + 0.2 * size - x0) / 595), 6) as nw, round(least(1.0, 1.15 * size / 842), 6) as nh from run_text"""))
def run_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = L.run_texts(bridge.text_items(spark, sf_dir))
    return runs.select("doc_id", "page", "band", "run", L.box(F.col("x0"), F.col("x1"), F.col("baseline"), F.col("size"), bridge.WIDTH, bridge.HEIGHT).alias("b")).select("doc_id", "page", "band", "run", "b.*")


@register("p11_word_box", bridged("""select doc_id, page, line_no, off, round(greatest(0.0, (x0 - 0.2 * size) / 595), 6) as nx, round(greatest(0.0, (baseline - 0.9 * size) / 842), 6) as ny,
  round(least(1.0, (x1 + 0.2 * size - x0) / 595), 6) as nw, round(least(1.0, 1.15 * size / 842), 6) as nh from text_items"""))
def word_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.box(F.col("x0"), F.col("x1"), F.col("baseline"), F.col("size"), bridge.WIDTH, bridge.HEIGHT)
    return bridge.text_items(spark, sf_dir).select("doc_id", "page", "line_no", "off", b.alias("b")).select("doc_id", "page", "line_no", "off", "b.*")


@register("a1_char_census", bridged("""
with chars as (select doc_id, page, sum(length(line))::bigint as chars from doc_lines group by all), n as (select doc_id, max(page) as n from chars group by all),
s as (select *, chars >= 32 as digital from chars join n using (doc_id)), g as (select doc_id, bool_and(digital) as every, bool_or(digital) as any_ from s where page in (1, n, ceil(n / 2)) group by doc_id)
select doc_id, n as n_pages, (select sum(chars) from chars c where c.doc_id = n.doc_id)::bigint as n_chars, case when every then 'digital' when not any_ then 'scan' else 'mixed' end as mode from n join g using (doc_id)"""))
def char_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bridge.doc_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length("line")).alias("chars"))
    return L.census(pages)


@register("a2_body_size", bridged("select doc_id, page, body_size from body"))
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.body_size(sane(spark, sf_dir))


@register("a20_page_text", bridged(r"select doc_id, page, trim(regexp_replace(string_agg(str, ' ' order by line_no, off), '\s+', ' ', 'g')) as text from text_items group by all"))
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_text(bridge.text_items(spark, sf_dir))


@register("w11_paragraph_join", bridged(f"""
with {LINE}, p as (select *, (sum(case when pb is not null and baseline - pb - greatest(size, ps) <= 0.55 * size then 0 else 1 end) over (partition by doc_id, page order by baseline))::int as para
  from (select *, lag(baseline) over w as pb, lag(size) over w as ps from lines window w as (partition by doc_id, page order by baseline)))
select doc_id, page, para, string_agg(text, ' ' order by baseline) as text from p group by doc_id, page, para"""))
def paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paragraphs(page_lines(spark, sf_dir))


@register("w19_list_levels", bridged(f"""
with {LINE} select doc_id, page, baseline, greatest(0, least(3, floor((x0 - first_value(x0) over (partition by doc_id, page order by baseline)) / 12 + 0.5)))::int as level from lines"""))
def list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.list_levels(page_lines(spark, sf_dir)).select("doc_id", "page", "baseline", "level")


@register("f12_classify_layout_line", bridged(r"""
with s_lines as (select doc_id, page, line_no, max(size) as size, bool_or(font_name like '%Bold%') as bold, string_agg(str, ' ' order by x0, off) as text from sane group by all)
select doc_id, page, line_no, case when size / body_size >= 1.35 then '#' when size / body_size >= 1.15 then '##' when regexp_matches(text, '^[•▪◦‣·*]\s+') then 'bullet'
  when regexp_matches(text, '^\d{1,2}[.)]\s+') then 'numbered' when bold and length(text) < 80 then '###' else 'text' end as kind from s_lines join body using (doc_id, page)"""))
def classify_layout_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = L.classify_line(F.col("text"), F.col("size"), F.col("body_size"), F.col("bold"))
    return L.scanned_lines(sane(spark, sf_dir)).select("doc_id", "page", "line_no", kind.alias("kind"))


@register("l1_reading_order")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reading_order(scanned(spark, sf_dir))


@register("l2_census_sample", bridged("select doc_id, page from (select *, max(page) over (partition by doc_id) as n from doc_pages) where page in (1, ceil(n / 2), n)"))
def census_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.max("page").over(Window.partitionBy("doc_id"))
    return bridge.doc_pages(spark, sf_dir).withColumn("n", n).filter("page in (1, n) or page = ceil(n / 2)").select("doc_id", "page")


@register("j10_keyword_join", bridged(f"""
with {RUN_TEXT}, keys as (select distinct lower(r_name) as keyword from region union select lower(n_name) from nation union select 'the' union select 'und')
select doc_id, page, band, run, keyword, ((length(text) - length(replace(lower(text), keyword, ''))) / length(keyword))::int as n_hits from run_text join keys on contains(lower(text), keyword)"""))
def keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "region").select(F.lower("r_name").alias("keyword")).union(table(spark, sf_dir, "nation").select(F.lower("n_name")))
    keys = keys.union(spark.createDataFrame([("the",), ("und",)], ["keyword"]))
    hits = keyword_hits(L.run_texts(bridge.text_items(spark, sf_dir)), keys)
    return hits.select("doc_id", "page", "band", "run", "keyword", "n_hits")

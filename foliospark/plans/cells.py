"""Queries of the table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import cells as C
from foliospark.operators import layout as L
from foliospark.plans.registry import register
from foliospark.sources.bridge import bridged, doc_lines, raw_items, text_items
from foliospark.tables import table

CUSTOMERS = "cells as (select c_custkey // 100 as tid, row_number() over (partition by c_custkey // 100 order by c_custkey) - 1 as row_no, 0 as col_no, c_name as text from customer union all select c_custkey // 100, row_number() over (partition by c_custkey // 100 order by c_custkey) - 1, 1, c_acctbal::varchar from customer union all select c_custkey // 100, row_number() over (partition by c_custkey // 100 order by c_custkey) - 1, 2, c_mktsegment || '|' || c_custkey from customer)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundred customers as a table of cells: tid, row_no, col_no, text. Tables don't grow with the data; their number does."""
    tid = F.expr("c_custkey div 100")
    row = F.row_number().over(Window.partitionBy(tid).orderBy("c_custkey")) - 1
    texts = F.array("c_name", F.col("c_acctbal").cast("string"), F.concat_ws("|", "c_mktsegment", F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").select(tid.alias("tid"), row.alias("row_no"), texts.alias("t")).select("tid", "row_no", F.posexplode("t").alias("col_no", "text"))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundred suppliers as a page with an HTML table, some rows short of a cell."""
    td = lambda c: F.concat(F.lit("<td class='x'> "), c, F.lit("\n</td>"))
    row = F.concat(F.lit("<tr>"), td(T.escape_html(F.concat(F.col("s_name"), F.lit(" & <co>")))), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(td(F.col("s_acctbal").cast("string"))), F.lit("</tr>"))
    rows = table(spark, sf_dir, "supplier").groupBy(F.expr("s_suppkey div 100").alias("sheet")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("r")))).alias("r"))
    return rows.select("sheet", F.concat(F.lit("<p>a</p><TABLE border=1>"), F.array_join(F.transform("r", lambda x: x["r"]), "\n"), F.lit("</TABLE >")).alias("html"))


@register("s7_scan_html_tables", """with s as (select *, s_suppkey // 100 as sheet, row_number() over (partition by s_suppkey // 100 order by s_suppkey) - 1 as row_no from supplier), w as (select s_suppkey // 100 as sheet, max(case when s_suppkey % 3 = 0 then 1 else 2 end) as width from supplier group by 1)
select sheet, 0 as table_no, row_no::int as row_no, 0 as col_no, s_name || ' & <co>' as text from s union all select sheet, 0, row_no::int, 1, case when s_suppkey % 3 = 0 then '' else s_acctbal::varchar end from s join w using (sheet) where width = 2""")
def scan_html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scan_html_tables(html(spark, sf_dir), "sheet", "html")


PIPES = """cells_md as (select doc_id, (row_number() over (partition by doc_id order by line_no) - 1)::int as row_no, list_transform(string_split(line, '|'), lambda c: trim(c)) as cells from doc_lines where contains(line, ' | ') qualify count(*) over (partition by doc_id) >= 2)"""


@register("s8_scan_markdown_tables", bridged(f"with {PIPES} select doc_id, row_no, (i - 1)::int as col_no, text from (select doc_id, row_no, unnest(cells) as text, generate_subscripts(cells, 1) as i from cells_md)"))
def scan_markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).filter(F.col("line").contains(" | ")).withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |")))
    return C.scan_markdown_tables(lines, "doc_id")


@register("s9_scan_review_cells", bridged(f"with {PIPES} select doc_id, row_no, len(cells)::int as n, 'review' as warning from cells_md"))
def scan_review_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).filter(F.col("line").contains(" | ")).withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |")))
    return C.review_cells(C.scan_markdown_tables(lines, "doc_id")).groupBy("doc_id", "row_no", "warning").agg(F.count("*").cast("int").alias("n"))


@register("k1_write_safe_csv", """select '"' || c_name || '",' || case when c_acctbal < 0 then '''' else '' end || c_acctbal::varchar || ',' || c_mktsegment as line from customer""".replace("'\"' || c_name || '\",'", "c_name || ','"))
def write_safe_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.safe_csv(table(spark, sf_dir, "customer"), ["c_name", "c_acctbal", "c_mktsegment"])


@register("k2_write_typed_table", f"with {CUSTOMERS} select tid, row_no::int as row_no, col_no, case when row_no > 0 and col_no = 1 then 'number' else 'text' end as kind, case when row_no > 0 and col_no = 1 then text::double end as num, case when row_no = 0 or col_no != 1 then text end as shown from cells")
def write_typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("col_no") == 1, "number").when(F.col("col_no") == 2, "date").otherwise("text")
    return customers(spark, sf_dir).withColumn("t", C.typed(F.col("text"), kind, F.col("row_no"))).select("tid", "row_no", "col_no", "t.kind", "t.num", F.col("t.text").alias("shown"))


@register("k3_write_markdown_table", f"""with {CUSTOMERS}, l as (select tid, row_no, '| ' || string_agg(replace(trim(text), '|', '\\|'), ' | ' order by col_no) || ' |' || case when row_no = 0 then chr(10) || '| --- | --- | --- |' else '' end as line from cells group by tid, row_no)
select tid, string_agg(line, chr(10) order by row_no) as markdown from l group by tid""")
def write_markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.markdown(customers(spark, sf_dir), "tid")


@register("j19_apply_cell_edits", f"""with {CUSTOMERS}, e as (select c_custkey // 100 as tid, row_number() over (partition by c_custkey // 100 order by c_custkey) - 1 as row_no, case when c_custkey % 4 = 0 then c_name else 'edited ' || c_custkey end as edited from customer where c_custkey % 2 = 0)
select tid, row_no::int as row_no, col_no, nullif(edited, text) as edited, coalesce(nullif(edited, text), text) as display from cells left join (select *, 0 as col_no from e) using (tid, row_no, col_no)""".replace("from customer where c_custkey % 2 = 0)", "from customer qualify c_custkey % 2 = 0)"))
def apply_cell_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = customers(spark, sf_dir).filter("col_no = 0").withColumn("k", F.regexp_extract("text", r"(\d+)$", 1).cast("int")).filter("k % 2 = 0")
    late = names.select("tid", "row_no", "col_no", F.lit(2).alias("seq"), F.when(F.col("k") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("edited "), F.col("k").cast("string"))).alias("new_text"))
    edits = late.unionByName(late.withColumn("seq", F.lit(1)).withColumn("new_text", F.lit("first try")))
    return C.apply_edits(customers(spark, sf_dir), edits, ["tid", "row_no", "col_no"]).select("tid", "row_no", "col_no", "edited", "display")


@register("u5_join_tables", f"with {CUSTOMERS}, s as (select *, tid // 5 as g, min(tid) over (partition by tid // 5) as f from cells) select g, tid, row_no::int as row_no, col_no, (dense_rank() over (partition by g order by tid, row_no) - 1)::int as out_row from s where tid = f or row_no > 0")
def join_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.join_tables(customers(spark, sf_dir).withColumn("g", F.expr("tid div 5")), "g", "tid").select("g", "tid", "row_no", "col_no", "out_row")


@register("u6_table_row_col_edit", f"with {CUSTOMERS} select tid, (dense_rank() over (partition by tid order by row_no) - 1)::int as row_no, (case when col_no = 2 then 3 else col_no end)::int as col_no, text from cells where row_no % 5 != 3 union all select distinct tid, (dense_rank() over (partition by tid order by row_no) - 1)::int, 2, '' from cells where row_no % 5 != 3")
def table_row_col_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose number ends in 3 or 8 deleted, and an empty column put before the third."""
    kept = customers(spark, sf_dir).filter("row_no % 5 != 3").withColumn("row_no", F.dense_rank().over(Window.partitionBy("tid").orderBy("row_no")) - 1)
    moved = kept.withColumn("col_no", F.when(F.col("col_no") >= 2, F.col("col_no") + 1).otherwise(F.col("col_no")))
    blank = kept.select("tid", "row_no").distinct().select("tid", "row_no", F.lit(2).alias("col_no"), F.lit("").alias("text"))
    return moved.unionByName(blank)


@register("a18_sheet_shape", f"with {CUSTOMERS} select tid, (max(row_no) + 1)::int as n_rows, (max(col_no) + 1)::int as n_cols from cells group by tid")
def sheet_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).groupBy("tid").agg((F.max("row_no") + 1).alias("n_rows"), (F.max("col_no") + 1).alias("n_cols"))


@register("a10_table_bbox", bridged("select doc_id, page, min(x0) as x0, min(baseline - size) as y0, max(x1) as x1, max(baseline + 0.25 * size) as y1 from text_items group by all"))
def table_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_items(spark, sf_dir).groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min(F.col("baseline") - F.col("size")).alias("y0"), F.max("x1").alias("x1"), F.max(F.col("baseline") + 0.25 * F.col("size")).alias("y1"))


ROWS = "brow as (select distinct doc_id, page, baseline from text_items), pitches as (select doc_id, page, baseline, baseline - lag(baseline) over (partition by doc_id, page order by baseline) as pitch from brow), med as (select doc_id, page, list_sort(list(pitch) filter (pitch is not null))[count(pitch) // 2 + 1] as med from pitches group by all)"


def pitches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_items(spark, sf_dir).select("doc_id", "page", "baseline").distinct()
    return rows.withColumn("pitch", F.col("baseline") - F.lag("baseline").over(Window.partitionBy("doc_id", "page").orderBy("baseline")))


def medians(rows: DataFrame) -> DataFrame:
    """The upper median pitch of each page."""
    sorted_ = F.array_sort(F.collect_list("pitch"))
    return rows.groupBy("doc_id", "page").agg(sorted_.alias("p")).select("doc_id", "page", F.get("p", (F.size("p") / 2).cast("int")).alias("med"))


@register("a11_median_pitch", bridged(f"with {ROWS} select doc_id, page, med as pitch from med"))
def median_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medians(pitches(spark, sf_dir)).withColumnRenamed("med", "pitch")


@register("w6_split_bands_by_pitch", bridged(f"with {ROWS} select doc_id, page, baseline, coalesce(sum((pitch > 1.8 * med)::int) over (partition by doc_id, page order by baseline), 0)::int as band from pitches join med using (doc_id, page)"))
def split_bands_by_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pitches(spark, sf_dir)
    over = F.coalesce((F.col("pitch") > 1.8 * F.col("med")).cast("int"), F.lit(0))
    return rows.join(medians(rows), ["doc_id", "page"]).withColumn("band", F.sum(over).over(Window.partitionBy("doc_id", "page").orderBy("baseline")).cast("int")).select("doc_id", "page", "baseline", "band")


@register("w7_gutter_columns", bridged("""with g as (select doc_id, page, x0, x1, max(x1) over (partition by doc_id, page order by x0, x1 rows between unbounded preceding and 1 preceding) as reach from sane where not rotated),
c as (select doc_id, page, (reach + x0) / 2 as x from g where x0 - reach > 6) select doc_id, page, x from c qualify count(*) over (partition by doc_id, page) >= 2"""))
def gutter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles of the gaps of over six points that no item of a page crosses, where a page has two or more."""
    w = Window.partitionBy("doc_id", "page").orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    items = L.sanitise_items(L.scan_text_items(raw_items(spark, sf_dir))).filter(~F.col("rotated"))
    gaps = items.withColumn("reach", F.max("x1").over(w)).filter(F.col("x0") - F.col("reach") > 6).select("doc_id", "page", ((F.col("reach") + F.col("x0")) / 2).alias("x"))
    return gaps.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page"))).filter("n >= 2").drop("n")


EDGES = "ledge as (select doc_id, page, x0 as x, count(*) as hits from text_items group by all), nrow as (select doc_id, page, count(distinct baseline) as n from text_items group by all), ecol as (select doc_id, page, x, hits from ledge join nrow using (doc_id, page) where hits >= ceil(n / 2))"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left edges that at least half of a page's rows share; the synthetic layout is five points wide, so clusters are single places."""
    items = text_items(spark, sf_dir)
    rows = items.groupBy("doc_id", "page").agg(F.count_distinct("baseline").alias("n"))
    hits = items.groupBy("doc_id", "page", F.col("x0").alias("x")).agg(F.count("*").alias("hits"))
    return hits.join(rows, ["doc_id", "page"]).filter(F.col("hits") >= F.ceil(F.col("n") / 2)).select("doc_id", "page", "x", "hits")


@register("w8_column_edges", bridged(f"with {EDGES} select doc_id, page, x, hits from ecol"))
def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@register("w9_assemble_grid", bridged(f"""with {EDGES}, c as (select doc_id, page, x, lead(x) over (partition by doc_id, page order by x) as nx, (row_number() over (partition by doc_id, page order by x) - 1)::int as col_no from ecol),
g as (select i.doc_id, i.page, line_no, col_no, string_agg(str, ' ' order by x0) as text from text_items i join c on c.doc_id = i.doc_id and c.page = i.page and x0 >= x - 3 and (nx is null or x0 < nx - 3) group by all)
select doc_id, page, line_no, col_no, text from g qualify count(*) over (partition by doc_id, page, line_no) >= 2"""))
def assemble_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page").orderBy("x")
    columns = edges(spark, sf_dir).select("doc_id", "page", "x", F.lead("x").over(w).alias("nx"), (F.row_number().over(w) - 1).alias("col_no"))
    inside = (F.col("x0") >= F.col("x") - 3) & (F.col("nx").isNull() | (F.col("x0") < F.col("nx") - 3))
    met = text_items(spark, sf_dir).join(columns, ["doc_id", "page"]).filter(inside)
    cells = met.groupBy("doc_id", "page", "line_no", "col_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "str"))), lambda s: s["str"]), " ").alias("text"))
    return cells.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page", "line_no"))).filter("n >= 2").drop("n")


@register("l3_page_words", bridged("select doc_id, page, count(*) as n from text_items group by all"))
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.words_from_items(text_items(spark, sf_dir).withColumn("str", F.regexp_replace("str", r"\s+", "_"))).groupBy("doc_id", "page").agg(F.count("*").alias("n"))

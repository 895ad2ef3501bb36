"""Queries of the page kernels and of configuration documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import layout as L
from foliospark.operators import regions as G
from foliospark.plans.layout import RUN_TEXT, sane, scanned
from foliospark.plans.registry import register
from foliospark.sources.bridge import HEIGHT, bridged, doc_lines, doc_pages, text_items
from foliospark.tables import table

#: Rows of edit scripts from which they are given to Spark.
SCRIPT_ROWS = 100_000


@register("w10_detect_tables")
def detect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.detect_tables(scanned(spark, sf_dir))


@register("f13_page_markdown")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_markdown(scanned(spark, sf_dir))


@register("w20_group_runs_relative")
def group_runs_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_runs_relative(sane(spark, sf_dir), HEIGHT)


@register("a12_coverage_guard", bridged("""
with c as (select doc_id, page, baseline, x0, x1, (least(floor((x0 - 48) / 150), 3))::int as col from text_items), e as (select doc_id, page, baseline, col, max(x1) - (48 + 150 * col) as ext from c group by doc_id, page, baseline, col),
m as (select doc_id, page, col, list_sort(list(ext))[count(*) // 2 + 1] as med from e where col < 3 group by doc_id, page, col) select doc_id, page, bool_and(med <= 0.65 * 150) as ok from m group by all"""))
def coverage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text leaves a third of four columns of 150 points free in most rows."""
    col = F.least(F.floor((F.col("x0") - 48) / 150), F.lit(3)).cast("int")
    cells = text_items(spark, sf_dir).withColumn("col", col).groupBy("doc_id", "page", "baseline", "col").agg((F.max("x1") - (48 + 150 * F.col("col"))).alias("ext"))
    medians = cells.filter("col < 3").groupBy("doc_id", "page", "col").agg(F.array_sort(F.collect_list("ext")).alias("e"))
    return medians.select("doc_id", "page", (F.get("e", (F.size("e") / 2).cast("int")) <= 0.65 * 150).alias("ok")).groupBy("doc_id", "page").agg(F.bool_and("ok").alias("ok"))


@register("a9_reverse_tagged_block", bridged("select doc_id, trim(line) as block, count(distinct page) as n_pages from doc_lines where page % 2 = 1 and length(trim(line)) between 1 and 40 and doc_id % 3 = 0 group by all"))
def reverse_tagged_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the size and on the pages that a document's tag states."""
    tags = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id", F.lit(40).alias("most"))
    blocks = doc_lines(spark, sf_dir).filter("page % 2 = 1").withColumn("block", F.trim("line")).join(tags, "doc_id").filter(F.length("block").between(1, F.col("most")))
    return blocks.groupBy("doc_id", "block").agg(F.count_distinct("page").alias("n_pages"))


@register("j22_replace_and_verify", bridged(f"""with {RUN_TEXT} select doc_id, page, band, run, replace(text, 'the', 'THAT') as text, case when contains(replace(text, 'the', 'THAT'), 'the') then 'original-left' when not contains(replace(text, 'the', 'THAT'), 'THAT') then 'missing' else 'ok' end as status
  from run_text where contains(text, 'the')"""))
def replace_and_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = L.run_texts(text_items(spark, sf_dir)).filter(F.col("text").contains("the"))
    edited = runs.withColumn("text", F.replace("text", F.lit("the"), F.lit("THAT")))
    status = F.when(F.col("text").contains("the"), "original-left").when(~F.col("text").contains("THAT"), "missing").otherwise("ok")
    return edited.select("doc_id", "page", "band", "run", "text", status.alias("status"))


@register("f24_json_config_migrate", """select event_id, case when event_id % 3 = 0 then null else '{"version":2,"steps":[{"id":"step-0","k":' || json_extract(props, '$.k') || '}]}' end as config, case when event_id % 3 = 0 then 'version' end as refusal from events""")
def json_config_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option bags as versioned documents: version 1 becomes 2, whose steps have ids; other versions are refused."""
    version = F.when(F.col("event_id") % 3 == 0, 7).otherwise(1)
    old = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(version.alias("version"), F.array(F.from_json("props", "k long")).alias("steps"))).alias("json"))
    got = old.withColumn("o", F.from_json("json", "version int, steps array<struct<k:long>>"))
    steps = F.transform("o.steps", lambda s, i: F.struct(F.concat(F.lit("step-"), i.cast("string")).alias("id"), s["k"].alias("k")))
    known = F.col("o.version").isin(1, 2)
    return got.select("event_id", F.when(known, F.to_json(F.struct(F.lit(2).alias("version"), steps.alias("steps")))).alias("config"), F.when(~known, "version").alias("refusal"))


@register("k4_outline_json", bridged("""select doc_id, '[' || string_agg('{"node":' || page || ',"title":"Page ' || page || '"}', ',' order by page) || ']' as json from doc_pages group by doc_id"""))
def outline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = F.array_sort(F.collect_list(F.struct(F.col("page").alias("node"), F.concat(F.lit("Page "), F.col("page").cast("string")).alias("title"))))
    return doc_pages(spark, sf_dir).groupBy("doc_id").agg(F.to_json(nodes).alias("json"))


@register("k4_outline_from_json", bridged("select doc_id, page as node, left('Page ' || page, 500) as title from doc_pages"))
def outline_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported outlines read again; nodes without a title or with a page out of range are dropped."""
    parsed = outline_json(spark, sf_dir).select("doc_id", F.explode(F.from_json("json", "array<struct<node:int,title:string>>")).alias("n"))
    return parsed.filter("n.title is not null and n.node between 1 and 1000000").select("doc_id", "n.node", F.substring("n.title", 1, 500).alias("title"))


@register("s5_intake_images", r"""select doc_id, case when doc_id % 2 = 0 then 'png' else 'jpeg' end as format, (n_chars % 5000 + 1)::bigint as width, (doc_id % 30000 + 1)::bigint as height,
  case when (n_chars % 5000 + 1) * (doc_id % 30000 + 1) > 2000000 then 'too-large' else 'ok' end as verdict from documents""")
def intake_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of images with sizes taken from the documents, read back."""
    from foliospark.sources.files import jpeg_size, png_size

    w, h = F.col("n_chars") % 5000 + 1, F.col("doc_id") % 30_000 + 1
    four, two = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0")), lambda c: F.unhex(F.lpad(F.hex(c), 4, "0"))
    raw = lambda x: F.unhex(F.lit(x))
    png = F.concat(raw("89504E470D0A1A0A0000000D49484452"), four(w), four(h))
    jpeg = F.concat(raw("FFD8FFE000046162FFC0000B08"), two(h), two(w), raw("03"))
    made = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("is_png"), F.when(F.col("doc_id") % 2 == 0, png).otherwise(jpeg).alias("content"))
    size = F.when(F.col("is_png"), png_size(F.col("content"))).otherwise(jpeg_size(F.col("content")))
    got = made.withColumn("s", size)
    return got.select("doc_id", F.when(F.col("is_png"), "png").otherwise("jpeg").alias("format"), "s.width", "s.height", F.when(F.col("s.width") * F.col("s.height") > 2_000_000, "too-large").otherwise("ok").alias("verdict"))


@register("d1_lcs_diff")
def lcs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest edit scripts between each page and the next of its document, however long: one row for each operation."""
    import pandas as pd

    from foliospark.operators.compare import edit_script
    from foliospark.plans.compare import next_pages

    def run(batches):
        names = ["doc_id", "page", "kind", "a_start", "a_end", "b_start", "b_end"]
        for rows in batches:
            out = []
            for doc, page, a, b in rows[["doc_id", "page", "words", "next"]].itertuples(index=False):
                out += [(doc, page, *op) for op in edit_script(list(a), list(b), None)]
                if len(out) > SCRIPT_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return next_pages(spark, sf_dir).mapInPandas(run, "doc_id long, page int, kind string, a_start int, a_end int, b_start int, b_end int")


@register("d2_suppress_reflow")
def suppress_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the changes between a page and itself wrapped anew: nothing but what differs in its letters."""
    import pandas as pd

    from foliospark.operators.compare import compare_pages
    from foliospark.plans.compare import page_words

    def run(batches):
        for rows in batches:
            out = []
            for doc, page, words in rows[["doc_id", "page", "words"]].itertuples(index=False):
                a = list(words)
                b = [x for w in a for x in ([w[:3], w[3:]] if len(w) > 6 else [w])]
                gone, new, whole = compare_pages(a, b)
                out.append((doc, page, len(gone), len(new), whole))
            yield pd.DataFrame(out, columns=["doc_id", "page", "n_removed", "n_inserted", "wholesale"])

    return page_words(spark, sf_dir).mapInPandas(run, "doc_id long, page int, n_removed int, n_inserted int, wholesale boolean")

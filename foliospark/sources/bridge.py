"""The given tables as documents of pages, items, pixels, manifests and outlines.

Everything is derived by DataFrame expressions from the whole tables (greys by
numpy), so the size of each derived table follows the table that it comes from. SQL states the
same for checks: `bridged(sql)` puts the views that a statement names before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.raster import ends, few, packed_greys, places
from foliospark.tables import scan, table

LINES_PER_PAGE = 8
#: Bytes of the documents' files of which a task gets the items, and characters of their texts.
DEAL_BYTES, DEAL_CHARS = 1024 * 1024, 4 * 1024 * 1024
#: The synthetic layout: left margin, advance of a character, top margin, pitch, type size; and the page.
LEFT, ADVANCE, TOP, PITCH, SIZE = 48.0, 5.0, 100.0, 16.0, 10.0
WIDTH, HEIGHT = 595.0, 842.0
#: Of the raw items: columns and their pitch, where right-aligned cells end, and characters that normalisation takes apart or makes narrow.
COLUMNS, COLUMN, RIGHT, LIGATURE, WIDE_ONE = 4, 130.0, 110.0, "\ufb01", "\uff11"


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0), page (from 1), line_in_page, line."""
    docs = scan(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return docs.select("doc_id", "line_no", (F.floor(F.col("line_no") / LINES_PER_PAGE) + 1).cast("int").alias("page"), (F.col("line_no") % LINES_PER_PAGE).alias("line_in_page"), "line")


def deal_parts(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the documents are dealt to, by the size of their files, or of their texts where the files hold those many times smaller."""
    docs = scan(spark, sf_dir, "documents")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    chars = docs.agg(F.sum("n_chars")).first()[0] or 0 if "n_chars" in docs.columns else 0
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // DEAL_BYTES), -(-int(chars) // DEAL_CHARS))


def page_deal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_lines dealt by page once: all windows over a page or a part of it find their rows in place.

    The lines are dealt by their files' size, not by what Spark makes of the few bytes that are shuffled: a line becomes
    many items, and a task's items should fit its memory, however large the table is.
    """
    return doc_lines(spark, sf_dir).repartition(deal_parts(spark, sf_dir), "doc_id", "page")


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One positioned item for each space-separated token: doc_id, page, line_no, off, str, x0, x1, baseline, size, rotated."""
    baseline = (F.lit(TOP) + PITCH * F.col("line_in_page")).alias("baseline")
    tokens = page_deal(spark, sf_dir).select("doc_id", "page", "line_no", baseline, F.posexplode(F.split("line", " ")).alias("j", "str"))
    before = Window.partitionBy("doc_id", "page", "line_no").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    items = tokens.withColumn("off", F.coalesce(F.sum(F.length("str") + 1).over(before), F.lit(0)).cast("int")).filter("str != ''")
    x0 = F.lit(LEFT) + ADVANCE * F.col("off")
    return items.select("doc_id", "page", "line_no", "off", "str", x0.alias("x0"), (x0 + ADVANCE * F.length("str")).alias("x1"), "baseline", F.lit(SIZE).alias("size"), F.lit(False).alias("rotated"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens as a page parser would give them: doc_id, page, line_no, off, str, a, b, c, d, e, f, width, font_name.

    Type sizes, slants, rotated lines, uneven baselines, ligatures and wide digits, blank items, items without size and
    garbage coordinates all follow the ids and places: no two operators see the same from them. A fourth of the documents
    is tabular: the tokens of a line fill as many rows of four cells as it takes, their left or right ends in line, cells
    that are too wide run into the next, and every third page has lines of prose between the rows. Every token is placed.
    """
    line, doc, off = F.col("line_no"), F.col("doc_id"), F.col("off")
    tabular = (doc % 4 == 1) & ~(((doc + F.col("page")) % 3 == 0) & (line % 5 == 4))
    # what all tokens of a line share is found once a line
    lines = page_deal(spark, sf_dir).withColumn("cells", tabular)
    above = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.when(F.col("cells"), F.ceil(F.size(F.split("line", " ")) / COLUMNS)).otherwise(1)
    lines = lines.withColumn("row", F.coalesce(F.sum(rows).over(above), F.lit(0)))
    kind = (7 * doc + 3 * line) % 23
    marked = F.replace(F.col("line"), F.lit("fi"), F.lit(LIGATURE))
    marked = F.when(doc % 3 == 0, F.replace(marked, F.lit("1"), F.lit(WIDE_ONE))).otherwise(marked)
    lines = lines.select(
        "doc_id", "page", "line_no", "cells", "row", F.when(kind == 0, 14.0).when(kind == 1, 12.0).otherwise(SIZE).alias("type"), ((doc + line) % 29 == 5).alias("turned"),
        F.when((doc + line) % 7 == 0, 0.05).otherwise(0.0).alias("slant"), (doc % 4 != 1).alias("uneven"), (doc % 8 == 5).alias("right"),
        F.when((doc + line) % 19 == 4, "Serif-Bold").otherwise("Serif").alias("font_name"), F.arrays_zip(F.split("line", " ").alias("t"), F.split(marked, " ").alias("str")).alias("parts"),
    )
    # outer: of a plain one Spark infers a filter on parts, for which each line is cut a second time
    tokens = lines.select("*", F.posexplode_outer("parts").alias("j", "p")).withColumn("n", F.length("p.t")).withColumn("str", F.col("p.str")).drop("parts", "p")
    before = Window.partitionBy("doc_id", "page", "line_no").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    t = tokens.withColumn("off", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("int"))
    cells, width, turned = F.col("cells"), ADVANCE * F.col("n"), F.col("turned")
    size = F.when((doc + off) % 97 == 3, 0.0).otherwise(F.col("type"))
    cell = LEFT + COLUMN * (F.col("j") % COLUMNS) + F.when(F.col("right"), RIGHT - width).otherwise(0.0)
    x = F.when((doc + off) % 101 == 7, 1e9).when(cells, cell).otherwise(LEFT + ADVANCE * off)
    jitter = F.when(F.col("uneven"), ((7 * off + doc) % 5 - 2) * 0.9).otherwise(0.0)
    row = F.col("row") + F.when(cells, F.floor(F.col("j") / COLUMNS)).otherwise(0)
    placed = F.struct(
        F.when(turned, 0.0).otherwise(size).alias("a"), F.when(turned, size).otherwise(size * F.col("slant")).alias("b"),
        F.when(turned, -size).otherwise(0.0).alias("c"), F.when(turned, 0.0).otherwise(size).alias("d"), x.cast("double").alias("e"),
        (F.lit(TOP) + PITCH * row + jitter).alias("f"), width.alias("width"),
    )
    # one struct a token, exploded: filters on its fields stay above it, where Spark would else write out each field for each time that a filter names it
    return t.select("doc_id", "page", "line_no", "off", "str", "font_name", F.inline(F.array(placed))).select("doc_id", "page", "line_no", "off", "str", *"abcdef", "width", "font_name")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, width, height, rotation, crop: one row for each page; rotation and crop follow the ids."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.size(F.split("text", "\n")) / LINES_PER_PAGE).cast("int").alias("n"))
    pages = pages.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    turn = ((F.col("doc_id") + F.col("page")) % 4 * 90).cast("int")
    crop = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit(20.0).alias("x"), F.lit(30.0).alias("y"), F.lit(500.0).alias("w"), F.lit(700.0).alias("h")))
    return pages.select("doc_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), turn.alias("rotation"), crop.alias("crop"))


def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, x, y, grey: one pixel for each character cell, white for a space."""
    cells = doc_lines(spark, sf_dir).filter("line != ''").select("doc_id", "page", F.col("line_in_page").alias("y"), F.posexplode(F.split("line", "")).alias("x", "ch"))
    grey = F.when(F.col("ch") == " ", 255).otherwise(F.lit(255) - (F.ascii("ch") % 200 + 5))
    return cells.filter("ch != ''").select("doc_id", "page", "x", "y", grey.cast("int").alias("grey"))


def page_rasters(spark: SparkSession, sf_dir: str, change: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, packed: bool = False) -> DataFrame:
    """doc_id, page, rows: the pixels of grid_pixels as scanlines, array<array<int>>; pages without pixels have no row.

    change(grey, doc_id, x, y) gives other greys for all pixels of some pages; packed rows are as visual_diff shuffles them.
    The lines of a page are cut out of the document's: nothing is grouped or shuffled.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    first = lambda page: (page - 1) * LINES_PER_PAGE + 1
    numbers = F.sequence(F.lit(1), F.ceil(F.size("lines") / LINES_PER_PAGE).cast("int"))
    cut = F.transform(numbers, lambda page: F.struct(page.alias("page"), F.slice("lines", first(page), F.lit(LINES_PER_PAGE)).alias("lines")))
    pages = docs.filter("lines is not null").select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.*").filter(F.exists("lines", lambda x: x != ""))

    def greys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            lines = batch.column("lines").flatten()
            codes = np.frombuffer("".join(lines.to_pylist()).encode("utf-32-le"), "<u4")
            grey = np.where(codes == ord(" "), 255, 250 - (codes % 200).astype(np.int32)).astype(np.int32)
            high, wide = batch.column("lines").value_lengths(), pc.utf8_length(lines)
            if change:
                of_line = np.repeat(batch.column("doc_id").to_numpy(), high.to_numpy()), places(high.to_numpy())
                doc, y = (np.repeat(v, wide.to_numpy()) for v in of_line)
                grey = change(grey, doc, places(wide.to_numpy()), y)
            scan = pa.ListArray.from_arrays(ends(wide), packed_greys(pa.array(grey)) if packed else pa.array(grey, pa.int32()))
            rows = pa.ListArray.from_arrays(ends(high), scan)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("page"), rows], names=["doc_id", "page", "rows"])

    return pages.select("doc_id", "page", "lines").mapInArrow(greys, f"doc_id long, page int, rows array<array<{'tinyint' if packed else 'int'}>>")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, seq, state: each user's events in order, as moves of a queue item."""
    kinds = table(spark, sf_dir, "events").withColumn("item_id", F.col("user_id"))
    seq = F.row_number().over(Window.partitionBy("item_id").orderBy("ts", "event_id"))
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES) + 1).cast("int"))
    return kinds.select("item_id", seq.alias("seq"), state.alias("state"), "ts", "event_id", "value")


#: States of a queue item.
STATES = ["queued", "running", "awaiting-input", "paused", "succeeded", "failed", "cancelled"]

VIEWS = {
    "doc_lines": f"""select doc_id, line_no, (line_no // {LINES_PER_PAGE} + 1)::int as page, line_no % {LINES_PER_PAGE} as line_in_page, line from (
        select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as line_no from documents)""",
    "tokens": """select doc_id, page, line_no, line_in_page, str, j, coalesce(sum(length(str) + 1) over (partition by doc_id, line_no order by j rows between unbounded preceding and 1 preceding), 0)::int as off
        from (select doc_id, page, line_no, line_in_page, unnest(string_split(line, ' ')) as str, generate_subscripts(string_split(line, ' '), 1) as j from doc_lines)""",
    "text_items": f"""select doc_id, page, line_no, off, str, {LEFT}::double + {ADVANCE}::double * off as x0, {LEFT}::double + {ADVANCE}::double * off + {ADVANCE}::double * length(str) as x1,
        {TOP}::double + {PITCH}::double * line_in_page as baseline, {SIZE}::double as size, false as rotated from tokens where str != ''""",
    "line_rows": f"""select doc_id, page, line_no, cells, coalesce(sum(case when cells then (len(string_split(line, ' ')) + {COLUMNS - 1}) // {COLUMNS} else 1 end)
          over (partition by doc_id, page order by line_no rows between unbounded preceding and 1 preceding), 0)::bigint as above
        from (select *, doc_id % 4 = 1 and not ((doc_id + page) % 3 = 0 and line_no % 5 = 4) as cells from doc_lines)""",
    "placed_tokens": f"""select doc_id, page, line_no, off, str, cells, j - 1 as j, (above + case when cells then (j - 1) // {COLUMNS} else 0 end)::double as at_row, {ADVANCE}::double * length(str) as width,
          (doc_id + line_no) % 29 = 5 as turned,
          (case when (doc_id + off) % 97 = 3 then 0.0 when (7 * doc_id + 3 * line_no) % 23 = 0 then 14.0 when (7 * doc_id + 3 * line_no) % 23 = 1 then 12.0 else 10.0 end)::double as s
        from tokens join line_rows using (doc_id, page, line_no)""",
    "raw_items": f"""select doc_id, page, line_no, off, case when doc_id % 3 = 0 then replace(replace(str, 'fi', '{LIGATURE}'), '1', '{WIDE_ONE}') else replace(str, 'fi', '{LIGATURE}') end as str,
        case when turned then 0.0 else s end as a, case when turned then s when (doc_id + line_no) % 7 = 0 then s * 0.05::double else 0.0 end as b,
        case when turned then -s else 0.0 end as c, case when turned then 0.0 else s end as d,
        case when (doc_id + off) % 101 = 7 then 1e9::double when cells then {LEFT}::double + {COLUMN}::double * (j % {COLUMNS}) + case when doc_id % 8 = 5 then {RIGHT}::double - width else 0.0::double end
          else {LEFT}::double + {ADVANCE}::double * off end as e,
        {TOP}::double + {PITCH}::double * at_row + case when doc_id % 4 = 1 then 0.0::double else ((7 * off + doc_id) % 5 - 2) * 0.9::double end as f, width,
        case when (doc_id + line_no) % 19 = 4 then 'Serif-Bold' else 'Serif' end as font_name
        from placed_tokens""",
    "scanned": f"""select doc_id, page, line_no, off, replace(replace(str, '{LIGATURE}', 'fi'), '{WIDE_ONE}', '1') as str, e as x0, e + width as x1, f as baseline, sqrt(c * c + d * d) as size, abs(b) > 0.1 * sqrt(a * a + b * b) as rotated, font_name
        from raw_items where regexp_matches(str, '[^\\s]') and width != 0 and (c != 0 or d != 0)""",
    "sane": "select * from scanned where abs(x0) <= 1e6 and abs(x1) <= 1e6 and abs(baseline) <= 1e6 and size > 0",
    "body": """select doc_id, page, body_size from (select doc_id, page, half as body_size, row_number() over (partition by doc_id, page order by count(*) desc, min(struct_pack(l := line_no, o := off))) as k
        from (select *, floor(size * 2 + 0.5) / 2 as half from sane) group by doc_id, page, half) where k = 1""",
    "doc_pages": f"""select doc_id, page::int as page, {WIDTH}::double as width, {HEIGHT}::double as height, ((doc_id + page) % 4 * 90)::int as rotation,
        case when doc_id % 2 = 0 then {{'x': 20.0::double, 'y': 30.0::double, 'w': 500.0::double, 'h': 700.0::double}} end as crop
        from (select doc_id, unnest(range(1, (len(string_split(text, chr(10))) + {LINES_PER_PAGE} - 1) // {LINES_PER_PAGE} + 1)) as page from documents)""",
    "grid_pixels": """select doc_id, page, (i - 1)::int as x, line_in_page as y, (case when ch = ' ' then 255 else 255 - (unicode(ch) % 200 + 5) end)::int as grey
        from (select doc_id, page, line_in_page, unnest(string_split(line, '')) as ch, generate_subscripts(string_split(line, ''), 1) as i from doc_lines where line != '') where ch != ''""",
    "job_events": f"""select user_id as item_id, row_number() over (partition by user_id order by ts, event_id)::int as seq,
        list_extract({STATES}, (event_id % {len(STATES)} + 1)::int) as state, ts, event_id, value from events""",
}


def bridged(sql: str) -> str:
    """sql with the views that it names, and those that they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, view in VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(view)
                needed.append(name)

    need(sql)
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if not views:
        return body
    return f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views} {body}"

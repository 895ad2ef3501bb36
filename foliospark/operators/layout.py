"""Bands, runs, words, lines and paragraphs of positioned items.

All but the first-fit kernels are windows over one page. A page is the group
key everywhere, so groups stay small however large the corpus is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.unicode import nfkc

#: Beyond the first a coordinate is garbage; pages of more items have no tables and no markdown.
COORDINATE_LIMIT, MAX_ITEMS = 1e6, 20_000
#: Rows are split only where more than this is left over, far above what rounding makes of a running mean.
SLACK = 1e-6
PAGE = ["doc_id", "page"]
#: Names of fonts that are bold.
BOLD = r"(?i)bold|black|heavy"


def scan_text_items(raw: DataFrame) -> DataFrame:
    """Items of (str, a, b, c, d, e, f, width) as a page parser gives them: doc_id, page, line_no, off, str, x0, x1, baseline, size, rotated, font_name.

    Blank items and those without width or size go; compatibility characters are normalised; the size is the length of
    the matrix's second row, and an item is rotated if its first row leans by more than a tenth.
    """
    kept = raw.filter(F.col("str").rlike(r"\S") & (F.col("width") != 0) & (F.hypot("c", "d") != 0))
    rotated = F.abs("b") > 0.1 * F.hypot("a", "b")
    return kept.select(
        *PAGE, "line_no", "off", nfkc(F.col("str")).alias("str"), F.col("e").alias("x0"), (F.col("e") + F.col("width")).alias("x1"), F.col("f").alias("baseline"),
        F.hypot("c", "d").alias("size"), rotated.alias("rotated"), "font_name",
    )


def sanitise_items(items: DataFrame) -> DataFrame:
    """Items with finite coordinates in bounds and a positive size."""
    sane = F.col("size") > 0
    for c in ("x0", "x1", "baseline", "size"):
        sane = sane & (F.abs(c) <= COORDINATE_LIMIT)  # NaN is above every number
    return items.filter(sane)


def banded(items: DataFrame) -> DataFrame:
    """items with band: a new one where the baseline differs by more than max(2, 0.35 size) from the item before."""
    w = Window.partitionBy(*PAGE).orderBy("baseline", "x0")
    starts = F.abs(F.lag("baseline").over(w) - F.col("baseline")) > F.greatest(F.lit(2.0), F.col("size") * 0.35)
    return items.withColumn("_new", F.coalesce(starts, F.lit(False)).cast("int")).withColumn("band", F.sum("_new").over(w).cast("int")).drop("_new")


def split_runs(items: DataFrame) -> DataFrame:
    """Banded items with run: a new one where the gap is more than 2.5 sizes."""
    return in_runs(items).drop("_px1", "_psize", "_new")


def in_runs(items: DataFrame) -> DataFrame:
    """split_runs with _new, whether the item opens its run, and _px1, _psize: the end and size of the item before it in its band."""
    w = Window.partitionBy(*PAGE, "band").orderBy("x0")
    before = items.withColumns({"_px1": F.lag("x1").over(w), "_psize": F.lag("size").over(w)})
    gap = F.col("x0") - F.col("_px1") > 2.5 * F.greatest("_psize", "size")
    return before.withColumn("_new", F.coalesce(gap, F.lit(False))).withColumn("run", F.sum(F.col("_new").cast("int")).over(w).cast("int"))


def since_run(total: Column, before: Column) -> Column:
    """A running total of a band, as of its run: less what it was before the run's first item. Totals don't fall, so the last start is the greatest."""
    w = Window.partitionBy(*PAGE, "band").orderBy("x0").rowsBetween(Window.unboundedPreceding, 0)
    return total - F.coalesce(F.max(F.when(F.col("_new"), before)).over(w), F.lit(0))


def words_from_items(items: DataFrame) -> DataFrame:
    """doc_id, page, band, run, word_no, text, x0, x1, baseline, size of the words of unrotated items.

    A gap of more than 0.2 sizes starts a word, a smaller one glues; white space
    inside an item splits it, with x in proportion. All numbers are found in one order of a band's items.
    """
    w = Window.partitionBy(*PAGE, "band").orderBy("x0")
    per = F.when(F.length("str") > 0, F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) / F.length("str")).otherwise(0.0)
    runs = in_runs(banded(sanitise_items(items).filter(~F.col("rotated")))).withColumn("parts", F.filter(F.split("str", r"\s+"), lambda p: p != ""))
    opens = F.col("_new") | F.coalesce(F.col("x0") - F.col("_px1") > 0.2 * F.greatest("_psize", "size"), F.lit(True))
    runs = runs.withColumn("_more", F.when(F.size("parts") > 0, opens.cast("int") + F.size("parts") - 1).otherwise(0)).withColumn("_upto", F.sum("_more").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = since_run(F.col("_upto"), F.col("_upto") - F.col("_more")) - F.size("parts") + 1  # the word of the item's first part
    placed = F.transform(F.col("parts"), lambda p, i: F.struct(i.alias("i"), p.alias("text"), (F.col("x0") + F.col("per") * (F.length(F.array_join(F.slice(F.col("parts"), 1, i), " ")) + F.when(i > 0, 1).otherwise(0))).alias("a")))
    flat = runs.withColumn("per", per).withColumn("first", first)
    flat = flat.select(*PAGE, "band", "run", "first", F.col("x0").alias("item_x"), "baseline", "size", "per", F.explode(placed).alias("p"))
    flat = flat.select("*", (F.col("first") + F.col("p.i")).alias("word"), F.col("p.a").alias("x0"), (F.col("p.a") + F.col("per") * F.length("p.text")).alias("x1"))
    return flat.groupBy(*PAGE, "band", "run", "word").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_x", F.col("p.i").alias("i"), F.col("p.text").alias("t")))), lambda s: s["t"]), "").alias("text"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min_by("baseline", "item_x").alias("baseline"), F.min_by("size", "item_x").alias("size"),
    )


def run_texts(items: DataFrame) -> DataFrame:
    """doc_id, page, band, run, text, n_items, x0, x1, size, baseline, offsets: items of a run, with a space at gaps."""
    w = Window.partitionBy(*PAGE, "band").orderBy("x0")
    runs = in_runs(banded(items.filter(~F.col("rotated")))).withColumn("_pstr", F.lag("str").over(w))
    gap = ~F.col("_new") & (F.col("x0") - F.col("_px1") > 0.2 * F.greatest("_psize", "size"))
    space = F.coalesce(gap & ~F.col("_pstr").rlike(r"\s$") & ~F.col("str").rlike(r"^\s"), F.lit(False))
    put = runs.withColumn("lead", space.cast("int")).withColumn("put", F.concat(F.when(F.col("lead") == 1, " ").otherwise(""), "str"))
    put = put.withColumn("_before", F.coalesce(F.sum(F.length("put")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    put = put.withColumn("offset", since_run(F.col("_before"), F.col("_before")) + F.col("lead"))
    parts = F.array_sort(F.collect_list(F.struct("x0", "put", "offset")))
    return put.groupBy(*PAGE, "band", "run").agg(
        F.array_join(F.transform(parts, lambda p: p["put"]), "").alias("text"), F.count("*").alias("n_items"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.max("size").alias("size"), F.avg("baseline").alias("baseline"), F.transform(parts, lambda p: p["offset"].cast("int")).alias("offsets"),
    )


def box(x0: Column, x1: Column, baseline: Column, size: Column, width: float, height: float) -> Column:
    """struct<nx,ny,nw,nh>: fractions of the page around a word or run."""
    pad = 0.2 * size
    r = lambda c: F.round(c, 6)
    return F.struct(
        r(F.greatest(F.lit(0.0), (x0 - pad) / width)).alias("nx"), r(F.greatest(F.lit(0.0), (baseline - 0.9 * size) / height)).alias("ny"),
        r(F.least(F.lit(1.0), (x1 + pad - x0) / width)).alias("nw"), r(F.least(F.lit(1.0), 1.15 * size / height)).alias("nh"),
    )


def half_size(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def body_size(items: DataFrame) -> DataFrame:
    """The most frequent size of a page, in halves; the first seen on ties."""
    counts = items.groupBy(*PAGE, half_size(F.col("size")).alias("half")).agg(F.count("*").alias("n"), F.min(F.struct("line_no", "off")).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "half"))
    return counts.groupBy(*PAGE).agg(best.alias("b")).select(*PAGE, F.col("b.half").alias("body_size"))


def page_text(items: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("line_no", "off", "str")))
    text = F.array_join(F.transform(parts, lambda p: p["str"]), " ")
    return items.groupBy(*PAGE).agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, baseline, size, text) joined where the leading is tight: para, text."""
    w = Window.partitionBy(*PAGE).orderBy("baseline")
    joins = F.col("baseline") - F.lag("baseline").over(w) - F.greatest("size", F.lag("size").over(w)) <= 0.55 * F.col("size")
    numbered = lines.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("para", F.sum("_new").over(w).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("baseline", "text"))), lambda p: p["text"]), " ")
    return numbered.groupBy(*PAGE, "para").agg(text.alias("text"))


def scanned_lines(items: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text, size, body_size, bold of the lines of scanned items: grouped once, the body is found among a page's groups."""
    parts = items.groupBy(*PAGE, "line_no", half_size(F.col("size")).alias("half")).agg(
        F.collect_list(F.struct("x0", "off", "str")).alias("items"), F.max("size").alias("size"), F.bool_or(F.col("font_name").rlike(BOLD)).alias("bold"),
        F.count("*").alias("n"), F.min("off").alias("off"),
    )
    same = Window.partitionBy(*PAGE, "half")
    ranked = parts.withColumn("rank", F.struct((-F.sum("n").over(same)).alias("n"), F.min(F.struct("line_no", "off")).over(same).alias("first"), "half"))
    ranked = ranked.withColumn("body_size", F.min("rank").over(Window.partitionBy(*PAGE))["half"])
    text = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("items"))), lambda p: p["str"]), " ")
    return ranked.groupBy(*PAGE, "line_no").agg(text.alias("text"), F.max("size").alias("size"), F.max("body_size").alias("body_size"), F.bool_or("bold").alias("bold"))


def classify_line(text: Column, size: Column, body: Column, bold: Column) -> Column:
    """`#` and `##` by the size against the body's, bullet, numbered, `###` for short bold lines, else text."""
    return (
        F.when(size / body >= 1.35, "#").when(size / body >= 1.15, "##").when(text.rlike(r"^[•▪◦‣·*]\s+"), "bullet").when(text.rlike(r"^\d{1,2}[.)]\s+"), "numbered")
        .when(bold & (F.length(text) < 80), "###").otherwise("text")
    )


def list_levels(lines: DataFrame) -> DataFrame:
    """Indent level of each line against the first line of its page."""
    first = F.first("x0").over(Window.partitionBy(*PAGE).orderBy("baseline"))
    level = F.greatest(F.lit(0), F.least(F.lit(3), F.floor((F.col("x0") - first) / 12 + 0.5)))
    return lines.withColumn("level", level.cast("int"))


def census(pages: DataFrame, least: int = 32) -> DataFrame:
    """(doc_id, n_pages, n_chars, mode) from (doc_id, page, chars): digital, scan or mixed by first, middle and last page."""
    n = F.max("page").over(Window.partitionBy("doc_id"))
    sampled = pages.withColumn("n", n).withColumn("sample", F.col("page").isin(1) | (F.col("page") == F.col("n")) | (F.col("page") == F.ceil(F.col("n") / 2)))
    digital = F.when(F.col("sample"), F.col("chars") >= least)
    mode = F.when(F.bool_and(digital), "digital").when(~F.bool_or(digital), "scan").otherwise("mixed")
    return sampled.groupBy("doc_id").agg(F.max("n").alias("n_pages"), F.sum("chars").alias("n_chars"), mode.alias("mode"))


# ---- kernels whose result depends on the order of the items of a page


def fold_rows(baselines: list[float], near: list[float]) -> list[int]:
    """Row of each item: the first whose running mean baseline is near enough; rows numbered downwards."""
    means: list[float] = []
    counts: list[int] = []
    rows = []
    for b, reach in zip(baselines, near, strict=True):
        for at, m in enumerate(means):
            if abs(m - b) <= reach:
                counts[at] += 1
                means[at] = m + (b - m) / counts[at]
                break
        else:
            at = len(means)
            means.append(b)
            counts.append(1)
        rows.append(at)
    place = {r: i for i, r in enumerate(sorted(range(len(means)), key=lambda r: means[r]))}
    return [place[r] for r in rows]


def first_fit_rows(baselines: list[float], sizes: list[float]) -> list[int]:
    """Row of each item: the first whose running mean baseline is within max(2, 0.35 size); rows numbered downwards.

    A mean lies among the baselines of its row. So the items are split where none reaches across a gap, what is left of
    them that all reach each other is one row, and only the rest is folded item by item: no step looks at all rows.
    """
    b, near = np.asarray(baselines, float), np.maximum(2.0, 0.35 * np.asarray(sizes, float))
    order = np.argsort(b, kind="stable")
    at, up, down = b[order], np.maximum.accumulate((b + near)[order]), np.minimum.accumulate((b - near)[order][::-1])[::-1]
    parts = np.split(order, np.flatnonzero((at[1:] - up[:-1] > SLACK) & (down[1:] - at[:-1] > SLACK)) + 1)
    rows, n = np.zeros(len(b), int), 0
    for part in parts if len(b) else []:
        if b[part[-1]] - b[part[0]] + SLACK <= near[part].min():
            rows[part] = n
            n += 1
        else:
            part.sort()
            rows[part] = np.add(fold_rows(b[part].tolist(), near[part].tolist()), n)
            n = int(rows[part].max()) + 1
    return rows.tolist()


def rows_of_sorted(b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first_fit_rows of items in order of their baselines, and for each row the part that it was split into.

    A part whose running mean stays near enough to every item is one row; that is seen for all parts at once, and only
    parts where rounding could decide, or a second row begins, are folded item by item.
    """
    n, near = len(b), np.maximum(2.0, 0.35 * size)
    if n < 2:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    up, down = np.maximum.accumulate(b + near), np.minimum.accumulate((b - near)[::-1])[::-1]
    starts = np.concatenate([[0], np.flatnonzero((b[1:] - up[:-1] > SLACK) & (down[1:] - b[:-1] > SLACK)) + 1])
    ends = np.concatenate([starts[1:], [n]])
    part = np.repeat(np.arange(len(starts)), ends - starts)
    one = b[ends - 1] - b[starts] + SLACK <= np.minimum.reduceat(near, starts)
    if not one.all() and n * n * (b[-1] - b[0]) * 1e-15 < SLACK:
        above = b - b[0]
        total = np.cumsum(above) - above  # of the items before
        first, place = starts[part], np.arange(n)
        mean = (total - total[first]) / np.maximum(place - first, 1)
        one |= np.logical_and.reduceat((np.abs(mean - above) <= near - SLACK) | (place == first), starts)
    if one.all():
        return part, np.arange(len(starts))
    rows, parts = np.empty(n, np.int64), []
    for k, (at, end, alone) in enumerate(zip(starts.tolist(), ends.tolist(), one.tolist(), strict=True)):
        found = 0 if alone else np.asarray(fold_rows(b[at:end].tolist(), near[at:end].tolist()))
        rows[at:end] = found + len(parts)
        parts += [k] * (1 if alone else int(found.max()) + 1)
    return rows, np.asarray(parts)


def extent(baseline: np.ndarray, size: np.ndarray) -> float:
    return float((baseline + 0.25 * size).max() - (baseline - size).min()) if len(baseline) else 0.0


def row_means(rows: list[int], values: list[float]) -> list[float]:
    """The mean of each row's values, rows being numbered from 0; summed with compensation, as pandas does."""
    n = max(rows) + 1
    total, lost, count = [0.0] * n, [0.0] * n, [0] * n
    for r, v in zip(rows, values, strict=True):
        y = v - lost[r]
        t = total[r] + y
        lost[r] = t - total[r] - y
        total[r] = t
        count[r] += 1
    return [t / c for t, c in zip(total, count, strict=True)]


def run_means(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """row_means of rows whose values lie one behind the other, by where each begins."""
    values, bounds, means = values.tolist(), [*starts.tolist(), len(values)], []
    for at, end in pairwise(bounds):
        total = lost = 0.0
        for v in values[at:end]:
            y = v - lost
            t = total + y
            lost = t - total - y
            total = t
        means.append(total / (end - at))
    return np.asarray(means)


class Rows(NamedTuple):
    """The rows of some items: of each item its row; of each row its part, mean baseline and the size of its first item from the left; the items by row and x, and where each row begins there."""

    row: np.ndarray
    part: np.ndarray
    means: np.ndarray
    heads: np.ndarray
    order: np.ndarray
    starts: np.ndarray


def rows_across(x0: np.ndarray, baseline: np.ndarray, size: np.ndarray, found: tuple[np.ndarray, np.ndarray] | None = None) -> Rows:
    """Rows of items in order of their baselines; found: what rows_of_sorted gave for them, if that is known."""
    row, part = found or rows_of_sorted(baseline, size)
    order = np.lexsort((x0, row))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(row[order])) + 1])
    return Rows(row, part, run_means(baseline[order], starts), size[order[starts]], order, starts)


def region_places(
    x0: np.ndarray, x1: np.ndarray, baseline: np.ndarray, size: np.ndarray, at: np.ndarray, body: float, depth: int = 0, found: tuple[np.ndarray, np.ndarray] | None = None
) -> Iterator[np.ndarray]:
    """The places of the items of each leaf of a page's recursive cut: at the widest gutter between tall columns, else at the widest gap between rows.

    Items are in order of their baselines, and at in order; found: their rows_of_sorted, if that is known. The rows of a
    page that is cut between two parts of rows are those of the whole.
    """
    yield from (places for places, _ in regions(x0, x1, baseline, size, at, body, depth, None if found is None else rows_across(x0[at], baseline[at], size[at], found)))


def regions(x0: np.ndarray, x1: np.ndarray, baseline: np.ndarray, size: np.ndarray, at: np.ndarray, body: float, depth: int, rows: Rows | None) -> Iterator[tuple[np.ndarray, Rows | None]]:
    """region_places with the rows of each, where they are known."""
    if depth >= 6 or len(at) <= 1:
        yield at, rows
        return
    deeper = lambda part, known=None: regions(x0, x1, baseline, size, part, body, depth + 1, known)
    left_ends, right_ends, b, s = x0[at], x1[at], baseline[at], size[at]
    top, low = b - s, b + 0.25 * s
    tall = float(low.max() - top.min())
    if tall >= 3 * body:
        order = np.argsort(left_ends, kind="stable")
        starts = left_ends[order]
        reach = np.concatenate([starts[:1], np.maximum.accumulate(right_ends[order])[:-1]])
        gaps = starts - reach
        wide = np.flatnonzero(gaps >= 18)
        for k in wide[np.argsort(-gaps[wide], kind="stable")]:
            left, right = right_ends <= reach[k] + 0.5, left_ends >= starts[k] - 0.5
            if all(extent(b[side], s[side]) >= 0.6 * tall for side in (left, right)):
                yield from deeper(at[left])
                yield from deeper(at[right])
                return
    rows = rows or rows_across(left_ends, b, s)
    larger = np.maximum(rows.heads[1:], rows.heads[:-1])
    gap = np.diff(rows.means) - larger
    wide = np.flatnonzero(gap >= 0.9 * larger)
    if not len(wide):
        yield at, rows
        return
    cut = int(wide[np.argmax(gap[wide])]) + 1
    above = rows.row < cut
    for side, first, last in ((above, 0, cut), (~above, cut, len(rows.means))):
        known = None
        if rows.part[cut - 1] != rows.part[cut]:
            begin, end = rows.starts[first], rows.starts[last] if last < len(rows.starts) else len(at)
            renumbered = np.cumsum(side) - 1
            known = Rows(rows.row[side] - first, rows.part[first:last], rows.means[first:last], rows.heads[first:last], renumbered[rows.order[begin:end]], rows.starts[first:last] - begin)
        yield from deeper(at[side], known)


def body_of(sizes: np.ndarray) -> float:
    """The most frequent of the sizes, in halves; the first seen on ties."""
    counts = Counter((np.floor(sizes * 2 + 0.5) / 2).tolist())
    return max(counts, key=counts.get)


def reading_order(items: DataFrame) -> DataFrame:
    """doc_id, page, line_no, off, region: regions of each page in reading order. A page is cut in one task, in a time of n log n."""
    names = [*PAGE, "line_no", "off"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_pages(batches):
            order, bounds = by_place(whole)
            x0, x1, baseline, size = (whole.column(c).to_numpy()[order] for c in ("x0", "x1", "baseline", "size"))
            taken, region = [], []
            for at, end in pairwise(bounds):
                page = slice(at, end)
                places = list(region_places(x0[page], x1[page], baseline[page], size[page], np.arange(end - at), body_of(size[page])))
                taken += [at + p for p in places]
                region.append(np.repeat(np.arange(len(places)), [len(p) for p in places]))
            kept = pa.array(order[np.concatenate(taken)])
            yield pa.RecordBatch.from_arrays([*(whole.column(c).take(kept) for c in names), pa.array(np.concatenate(region), pa.int32())], names=[*names, "region"])

    placed = in_order(sanitise_items(items).select(*names, "x0", "x1", "baseline", "size"), PAGE, "line_no", "off")
    return placed.mapInArrow(cut, "doc_id long, page int, line_no int, off int, region int")


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of in_order, as batches of whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("opens").to_numpy(zero_copy_only=False))
        if len(starts):
            last = int(starts[-1])
            if held or last:
                yield pa.concat_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def by_place(whole: pa.RecordBatch) -> tuple[np.ndarray, list[int]]:
    """The rows of whole pages, each page's by baseline and x0 and else in order; where the pages begin and end."""
    opens = whole.column("opens").to_numpy(zero_copy_only=False)
    order = np.lexsort((whole.column("x0").to_numpy(), whole.column("baseline").to_numpy(), np.cumsum(opens)))
    return order, [*np.flatnonzero(opens).tolist(), whole.num_rows]


def in_order(rows: DataFrame, group: list[str], *order: str | Column) -> DataFrame:
    """rows with opens, whether one is the first of its group: a group's rows lie one behind the other in a task, in that order."""
    return rows.withColumn("opens", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1)


def first_fit(items: DataFrame) -> DataFrame:
    """doc_id, page, line_no, off, row_no by running mean baselines, as first_fit_rows.

    Spark sorts a page's items by how far up they reach, and a task reads page after page. Of a page of over MAX_ITEMS it
    holds what lies behind the last gap that no item reaches across.
    """
    near = F.greatest(F.lit(2.0), 0.35 * F.col("size"))
    names = [*PAGE, "line_no", "off"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, wait, row = [], 0, 0, 0  # what is left of the last page, how many that is, how many to wait for, and the row that it begins with
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= wait or batch.column("opens").true_count:
                whole = pa.concat_batches(held)
                rows, row = fold_pages(whole, row, False)
                yield numbered(whole, rows)
                held, n = [whole.slice(len(rows))], len(whole) - len(rows)
                wait = 2 * n
        if n:
            whole = pa.concat_batches(held)
            yield numbered(whole, fold_pages(whole, row, True)[0])

    def numbered(whole: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(whole.column(c).slice(0, len(rows)) for c in names), pa.array(rows, pa.int32())], names=[*names, "row_no"])

    placed = in_order(items.select(*names, "baseline", "size"), PAGE, F.col("baseline") - near)
    return placed.mapInArrow(fold, "doc_id long, page int, line_no int, off int, row_no int")


def fold_pages(items: pa.RecordBatch, row: int, ended: bool) -> tuple[np.ndarray, int]:
    """The rows of the items of whole pages, the first going on with that row, and of the last page as far as chunk_of goes; the row that it goes on with."""
    line, off, b, s = (items.column(c).to_numpy(zero_copy_only=False) for c in ("line_no", "off", "baseline", "size"))
    starts = np.flatnonzero(items.column("opens").to_numpy(zero_copy_only=False))
    bounds = [0, *starts[starts > 0].tolist(), len(b)]
    if not ended:
        near = np.maximum(2.0, 0.35 * s[bounds[-2] :])
        bounds[-1] = bounds[-2] + chunk_of(b[bounds[-2] :] - near, b[bounds[-2] :] + near)
    rows = np.empty(bounds[-1], np.int64)
    for k, (at, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
        row = 0 if k else row
        order = at + np.lexsort((off[at:end], line[at:end]))
        rows[order] = np.add(first_fit_rows(b[order], s[order]), row)
    return rows, int(rows[bounds[-2] :].max(initial=row - 1 if len(bounds) == 2 else -1)) + 1


def chunk_of(down: np.ndarray, up: np.ndarray, size: int = MAX_ITEMS) -> int:
    """How many of a page's items, by how far up they reach, lie before the last gap that none reaches across; 0 for fewer than `size`."""
    gaps = np.flatnonzero(down[1:] - np.maximum.accumulate(up)[:-1] > SLACK) if len(down) >= size else ()
    return int(gaps[-1]) + 1 if len(gaps) else 0

"""Table regions and markdown of pages: kernels of one page, run for all pages of a corpus.

A page is the group of one task; pages with more items than a caller's
maximum are set aside with a reason rather than cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.operators.layout import BOLD, MAX_ITEMS, PAGE, Rows, body_of, by_place, in_order, regions, rows_across, rows_of_sorted, run_means, sanitise_items, whole_pages

#: What rounding makes of places.
EPSILON = 1e-9
MIN_GAP, MIN_GUTTERS, EDGE, COVER = 6.0, 2, 3.0, 0.65
#: Glyphs that open a list item.
BULLET = re.compile(r"[•▪◦‣·*]\s+")
BOLD_NAME = re.compile(BOLD)
NUMBERED = re.compile(r"(\d{1,2})[.)]\s+")


def bands(rows: np.ndarray, baseline: np.ndarray) -> list[np.ndarray]:
    """Places of the items of runs of rows whose pitch is at most 1.8 times the upper median pitch."""
    order = np.argsort(rows, kind="stable")
    heights = run_means(baseline[order], np.concatenate([[0], np.flatnonzero(np.diff(rows[order])) + 1]))
    if len(heights) < 2:
        return [np.arange(len(rows))]
    pitch = np.diff(heights)
    most = 1.8 * np.sort(pitch)[len(pitch) // 2]
    breaks = pitch > most
    if not breaks.any():
        return [np.arange(len(rows))]
    band = np.concatenate([[0], np.cumsum(breaks)])[rows]
    return np.split(np.argsort(band, kind="stable"), np.cumsum(np.bincount(band))[:-1])


def shared_edges(rows: np.ndarray, xs: np.ndarray, n_rows: int) -> list[float]:
    """Left edges, within three points of the first seen, that half of the rows have.

    Only places that lie near each other can share an edge, so that those of too few items are passed over as a whole. In
    the others a place goes to the edge first seen, and so to the same one each time.
    """
    places, seen, n = np.unique(xs[np.lexsort((xs, rows))], return_index=True, return_counts=True)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(places) > EDGE + EPSILON) + 1])
    ends, least, found = np.concatenate([starts[1:], [len(places)]]), -(-n_rows // 2), []
    for k in np.flatnonzero(np.add.reduceat(n, starts) >= least).tolist():
        near = slice(int(starts[k]), int(ends[k]))
        hits: dict[float, int] = {}  # of each edge, in the order that they were first seen
        order = np.argsort(seen[near])
        for x, count in zip(places[near][order].tolist(), n[near][order].tolist(), strict=True):
            hit = next((e for e in hits if abs(e - x) <= EDGE), x)
            hits[hit] = hits.get(hit, 0) + count
        found += sorted(x for x, count in hits.items() if count >= least)
    return found


def gutters(x0: np.ndarray, x1: np.ndarray) -> list[float]:
    """Left end and corridor midpoints where no item crosses a gap of over six points; none if there are too few."""
    order = np.argsort(x0, kind="stable")
    starts, reach = x0[order][1:], np.maximum.accumulate(x1[order])[:-1]
    found = ((starts + reach) / 2)[starts - reach > MIN_GAP].tolist()
    return [float(x0.min()), *found] if len(found) >= MIN_GUTTERS else []


def column_of(xs: np.ndarray, columns: list[float]) -> np.ndarray:
    """Number of the column whose band holds each x; -1 before the first."""
    return np.searchsorted(np.asarray(columns) - EDGE, xs, side="right") - 1


def covered(rows: np.ndarray, x0: np.ndarray, x1: np.ndarray, columns: list[float], inked: bool) -> bool:
    """Whether the upper median extent of every column but the last is at most 0.65 of its width."""
    column = column_of(x0, columns)
    order = np.lexsort((rows, column))
    at, row = column[order], rows[order]
    starts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 0) | (np.diff(row) != 0)) + 1])
    ends, at = np.maximum.reduceat(x1[order], starts), at[starts]
    widths, places = np.diff(columns), np.maximum(at, 0)
    extents = ends - (np.minimum.reduceat(x0[order], starts) if inked else np.asarray(columns)[places])
    order = np.lexsort((extents, at))
    bounds = np.searchsorted(at, np.arange(len(columns)))  # at is in order, and so is at[order]
    n = np.diff(bounds)
    filled = np.flatnonzero(n)
    medians = extents[order][bounds[filled] + n[filled] // 2]
    return not (medians > COVER * widths[filled]).any()


def grid(rows: np.ndarray, x0: np.ndarray, texts: list[str], columns: list[float]) -> tuple[list[list[str]], np.ndarray] | None:
    """Cell texts of the rows that fill two columns or more, and the places of their items; None under three such rows."""
    column = column_of(x0, columns)
    order = np.lexsort((x0, rows))
    cells: dict[int, dict[int, list[str]]] = {}
    for r, col, k in zip(rows[order].tolist(), column[order].tolist(), order.tolist(), strict=True):
        if col >= 0:
            cells.setdefault(r, {}).setdefault(col, []).append(" ".join(texts[k].split()))
    full = [r for r, by in cells.items() if len(by) >= 2]
    if len(full) < 3:
        return None
    found = [[" ".join(cells[r].get(i, [])) for i in range(len(columns))] for r in full]
    return found, np.flatnonzero((column >= 0) & np.isin(rows, full))


def table_of(rows: np.ndarray, x0: np.ndarray, x1: np.ndarray, texts: list[str], band: np.ndarray) -> tuple[list[list[str]], np.ndarray] | None:
    """The table of a band of a page's items, by shared left edges, else by gutters, and the places of its items."""
    if len(band) < len(rows):
        rows, x0, x1, texts = rows[band], x0[band], x1[band], [texts[k] for k in band.tolist()]
    n_rows = int(rows.max() - rows.min()) + 1  # a band's rows follow each other
    if n_rows < 3:
        return None
    lattice = shared_edges(rows, x0, n_rows)
    found = grid(rows, x0, texts, lattice) if len(lattice) >= 2 and covered(rows, x0, x1, lattice, inked=False) else None
    if not found:
        open_ = gutters(x0, x1)
        found = grid(rows, x0, texts, open_) if open_ and covered(rows, x0, x1, open_, inked=True) else None
    return found and (found[0], band[found[1]])


REGION = "doc_id long, page int, region int, rows array<array<string>>, x0 double, y0 double, x1 double, y1 double, refused string"


def detect_tables(items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """REGION rows: tables of each page by bands; bands with rotated text and pages with too many items are refused."""

    def run(page: Page) -> list[tuple]:
        if len(page.x0) > max_items:
            return [(0, None, None, None, None, None, "items")]
        out: list[tuple] = []
        rows, _ = rows_of_sorted(page.baseline, page.size)
        top, low = page.baseline - page.size, page.baseline + 0.25 * page.size
        for band in bands(rows, page.baseline):
            box = lambda: tuple(map(float, (page.x0[band].min(), top[band].min(), page.x1[band].max(), low[band].max())))  # noqa: B023, E731
            if page.rotated[band].any():
                out.append((len(out), None, *box(), "rotated"))
            elif len(band) >= 6 and (found := table_of(rows, page.x0, page.x1, page.texts, band)):
                out.append((len(out), found[0], *box(), None))
        return out

    return each_page(sanitise_items(items), ["rotated"], run, REGION)


class Page(NamedTuple):
    """The items of a page, by baseline and x0; what wasn't asked for is None."""

    texts: list[str]
    x0: np.ndarray
    x1: np.ndarray
    baseline: np.ndarray
    size: np.ndarray
    rotated: np.ndarray | None
    bold: np.ndarray | None


def each_page(items: DataFrame, more: list[str], run: Callable[[Page], list[tuple]], schema: str) -> DataFrame:
    """The rows that run gives for each page of items, behind doc_id and page; more: rotated, font_name or both. A task reads page after page."""
    numbers = ["x0", "x1", "baseline", "size"]
    fields = [x.strip().split() for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_pages(batches):
            order, bounds = by_place(whole)
            columns = [whole.column(c).to_numpy()[order] for c in numbers]
            texts = whole.column("str").to_numpy(zero_copy_only=False)[order].tolist()
            rotated = whole.column("rotated").to_numpy(zero_copy_only=False)[order] if "rotated" in more else None
            bold = is_bold(whole.column("font_name"))[order] if "font_name" in more else None
            docs, numbers_of = (whole.column(c).take(pa.array(bounds[:-1])).to_pylist() for c in PAGE)
            out: list[tuple] = []
            for doc, number, (at, end) in zip(docs, numbers_of, pairwise(bounds), strict=True):
                out += [(doc, number, *row) for row in run(Page(texts[at:end], *(c[at:end] for c in columns), *(None if c is None else c[at:end] for c in (rotated, bold))))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*out, strict=True) if out else [()] * len(fields), fields, strict=True)], names=[n for n, _ in fields])

    placed = in_order(items.select(*PAGE, "line_no", "off", "str", *numbers, *more), PAGE, "line_no", "off").drop("line_no", "off")
    return placed.mapInArrow(read, schema)


def is_bold(fonts: pa.Array) -> np.ndarray:
    """Whether a font's name says that it is bold, each name being read once."""
    named = fonts.dictionary_encode()
    bold = np.array([bool(f and BOLD_NAME.search(f)) for f in named.dictionary.to_pylist()] + [False])
    return bold[named.indices.fill_null(len(bold) - 1).to_numpy()]


def line_texts(page: Page, at: np.ndarray, rows: Rows) -> list[tuple[str, float, float, float, bool]]:
    """The rows of some items of a page as lines: text, x0, baseline, size, bold; empty ones are left out."""
    order = at[rows.order]
    x0, x1, size, bold = (c[order] for c in (page.x0, page.x1, page.size, page.bold))
    gap = np.zeros(len(order), bool)
    gap[1:] = x0[1:] - x1[:-1] > np.maximum(1.0, 0.2 * size[:-1])
    # white space is evened out at the end, so that a space beside another, or before a line's first item, does nothing
    put = [f" {page.texts[k]}" if g else page.texts[k] for k, g in zip(order.tolist(), gap.tolist(), strict=True)]
    bounds = [*rows.starts.tolist(), len(order)]
    texts = [" ".join("".join(put[i:j]).split()) for i, j in pairwise(bounds)]
    columns = np.minimum.reduceat(x0, rows.starts), rows.means, np.maximum.reduceat(size, rows.starts), np.logical_or.reduceat(bold, rows.starts)
    return [x for x in zip(texts, *(c.tolist() for c in columns), strict=True) if x[0]]


def region_markdown(lines: list[tuple[str, float, float, float, bool]], body: float) -> str:
    """A region's lines as headings, list items and paragraphs; a paragraph of one short bold line is a heading too."""
    out: list[str] = []
    open_ = None  # the last line of the paragraph that is being written
    alone: list[int] = []  # places of paragraphs of one short bold line
    for text, x0, baseline, size, bold in lines:
        bullet, number = BULLET.match(text), NUMBERED.match(text)
        if size / body >= 1.15:
            out.append(f"{'#' if size / body >= 1.35 else '##'} {text}")
            open_ = None
        elif bullet or number:
            level = int(min(3, max(0, (x0 - lines[0][1]) / 12 + 0.5)))
            mark, rest = ("-", text[bullet.end() :]) if bullet else (f"{number[1]}.", text[number.end() :])
            out.append(f"{'  ' * level}{mark} {rest.strip()}")
            open_ = None
        else:
            if open_ is not None and baseline - open_[0] - max(size, open_[1]) <= 0.55 * size:
                out[-1] += f" {text}"
                alone = [i for i in alone if i < len(out) - 1]
            else:
                if bold and len(text) < 80:
                    alone.append(len(out))
                out.append(text)
            open_ = baseline, size
    for i in alone:
        out[i] = f"### {out[i]}"
    return "\n".join(out)


def table_markdown(rows: list[list[str]]) -> str:
    line = lambda cells: f"| {' | '.join(c.replace('|', chr(92) + '|') for c in cells)} |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def page_markdown(items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, page, markdown, refused): the first table, with the text above before it and the text below behind it.

    A page of more than max_items items has no markdown, and `items` as the reason.
    """

    def run(page: Page) -> list[tuple]:
        if len(page.x0) > max_items:
            return [(None, "items")]
        body = body_of(page.size)
        rows = rows_of_sorted(page.baseline, page.size)

        def text(at: np.ndarray) -> list[str]:
            if not len(at):
                return []
            part = [c[at] for c in (page.x0, page.x1, page.baseline, page.size)]
            known = rows_across(part[0], *part[2:], rows) if len(at) == len(page.x0) else None
            found = []
            for places, its in regions(*part, np.arange(len(at)), body, 0, known):
                here = at[places]
                if len(here):
                    found.append(region_markdown(line_texts(page, here, its or rows_across(page.x0[here], page.baseline[here], page.size[here])), body))
            return [m for m in found if m]

        found = next((t for band in bands(rows[0], page.baseline) if (t := table_of(rows[0], page.x0, page.x1, page.texts, band))), None)
        every = np.arange(len(page.x0))
        if found is None:
            blocks = text(every)
        else:
            cells, used = found
            top, low = page.baseline[used].min(), page.baseline[used].max()
            rest = np.delete(every, used)
            b = page.baseline[rest]
            blocks = [*text(rest[b < top]), table_markdown(cells), *text(rest[b > low]), *text(rest[(b >= top) & (b <= low)])]
        return [("\n\n".join(blocks), None)]

    return each_page(sanitise_items(items), ["font_name"], run, "doc_id long, page int, markdown string, refused string")


def group_runs_relative(items: DataFrame, height: float) -> DataFrame:
    """(doc_id, page, run, text, x0, x1): runs whose band follows the tallest item so far, texts put together as they are.

    Spark sorts a page's items downwards. An item that the last band doesn't reach is reached by none before it, so they
    are read one by one, and only the last band is held.
    """

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band: list[tuple] = []
        key, run, top, tall = (), 0, 0.0, 0.0  # the band's page, its first run's number, its first item's place and its tallest size
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("opens", "baseline", "size", "x0", "x1", *PAGE))
            for (new, baseline, size, x0, x1, *page), text in zip(zip(*columns, strict=True), batch.column("str").to_pylist(), strict=True):
                y, h = baseline / height, size / height
                if new or abs(top - y) > max(0.004, 0.35 * tall):
                    out += (found := cut_band(band, tall * height, key, run))
                    key, run = (page, 0) if new else (key, run + len(found))
                    band, top, tall = [], y, h
                band.append((x0, x1, text))
                tall = max(tall, h)
            yield written(out)
        yield written(cut_band(band, tall * height, key, run))

    def written(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[*PAGE, "run", "text", "x0", "x1"])

    placed = in_order(items.select(*PAGE, "baseline", "x0", "x1", "size", "str"), PAGE, "baseline", "x0", "str", "x1", "size")
    return placed.mapInArrow(runs_of, "doc_id long, page int, run int, text string, x0 double, x1 double")


def cut_band(band: list[tuple], tall: float, key: tuple, run: int) -> list[tuple]:
    """(*key, number, text, x0, x1) of the runs of a band's (x0, x1, text), numbered from run: items that follow by -1 to 2.5 of the tallest size."""
    found: list[tuple] = []
    last = None
    for x0, x1, text in sorted(band, key=lambda i: i[0]):
        if last is not None and -1 <= (x0 - last) / tall <= 2.5:
            texts.append(text)
            right = max(right, x1)
        else:
            if last is not None:
                found.append((*key, run + len(found), "".join(texts), left, right))
            texts, left, right = [text], x0, x1
        last = x1
    return [*found, (*key, run + len(found), "".join(texts), left, right)] if band else found

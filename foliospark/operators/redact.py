"""Redaction marks: planning, overlaps, residues and scrubbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators.layout import in_order
from foliospark.operators.needles import find

PAGE = ["doc_id", "page"]


def mark_to_rect(marks: DataFrame) -> DataFrame:
    """marks (fractions from the top left) with x, y, w, h in points from the bottom left."""
    return marks.withColumns({
        "x": F.col("nx") * F.col("width"), "y": (1 - F.col("ny_top") - F.col("nh")) * F.col("height"), "w": F.col("nw") * F.col("width"), "h": F.col("nh") * F.col("height"),
    })


def overlap(a: str, b: str, eps: float = 0.5) -> Column:
    """Whether the rects of two aliases overlap by more than eps."""
    c = lambda t, n: F.col(f"{t}.{n}")
    one = lambda p, q, at, size: c(p, at) + eps < c(q, at) + c(q, size)
    return one(a, b, "x", "w") & one(b, a, "x", "w") & one(a, b, "y", "h") & one(b, a, "y", "h")


def overlap_join(a: DataFrame, b: DataFrame, eps: float = 0.5) -> DataFrame:
    """Pairs of rects of one page that overlap: the page is the join key, the rects a condition on it."""
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page"))
    return a.alias("a").join(b.alias("b"), same & overlap("a", "b", eps))


def plan(marks: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, page, plan): marks (doc_id, page) on pages with flags (doc_id, page, choice: burn, keep or null)."""
    marked = marks.select(*PAGE).distinct().withColumn("marked", F.lit(True))
    both = flags.withColumn("flagged", F.lit(True)).join(marked, PAGE, "full_outer")
    named = F.when(F.col("choice") == "burn", "raster").when(F.col("choice") == "keep", "untouched").when(F.col("marked") & F.col("flagged"), "raster").when(F.col("marked"), "surgical")
    return both.select(*PAGE, named.alias("plan")).filter("plan is not null")


def containment(items: DataFrame, rects: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """Items (doc_id, page, item, x, y, w, h) that touch a rect of their page: inside, or only partly."""
    c = F.col
    inside = (c("a.x") >= c("b.x") - tolerance) & (c("a.x") + c("a.w") <= c("b.x") + c("b.w") + tolerance) & (c("a.y") >= c("b.y") - tolerance) & (c("a.y") + c("a.h") <= c("b.y") + c("b.h") + tolerance)
    hit = overlap_join(items, rects, 0.0).select("a.doc_id", "a.page", "a.item", inside.alias("inside"))
    return hit.groupBy("doc_id", "page", "item").agg(F.bool_or("inside").alias("inside"))


def dedupe_proposals(marks: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Proposals (doc_id, page, mark_id, nx, ny, nw, nh) that no earlier kept one of their page covers.

    Spark sorts a page's proposals, and a task reads page after page; it holds those that it kept.
    """
    names, box = marks.columns, ["nx", "ny", "nw", "nh"]

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[float, float, float, float]] = []
        for batch in batches:
            stays = []
            for new, x, y, w, h in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("opens", *box)), strict=True):
                if new:
                    kept = []
                right, low = x + w, y + h
                covered = any(x >= left - tolerance and y >= top - tolerance and right <= end + tolerance and low <= bottom + tolerance for left, top, end, bottom in kept)
                if not covered:
                    kept.append((x, y, right, low))
                stays.append(not covered)
            yield batch.select(names).filter(pa.array(stays, pa.bool_()))

    return in_order(marks, PAGE, "mark_id", *box).mapInArrow(greedy, marks.schema)


def coalesce_marks(marks: DataFrame, gap: float = 0.012) -> DataFrame:
    """Marks (doc_id, page, kind, nx, ny, nw, nh) of one row and kind joined where they touch or nearly touch.

    Spark sorts the marks of a page and kind; they are then read one by one, and only the mark that the next may join is held.
    """
    group, box = [*PAGE, "kind"], ["nx", "ny", "nw", "nh"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = left = None  # the open mark: its group, and its box
        for batch in batches:
            opens = batch.column("opens").to_numpy(zero_copy_only=False)
            names = iter(batch.select(group).filter(batch.column("opens")).to_pylist())
            out: list[tuple] = []
            for new, nx, ny, nw, nh in zip(opens.tolist(), *(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in box), strict=True):
                if left is not None and not new:
                    shared = min(top + high, ny + nh) - max(top, ny)
                    if max(0.0, shared) >= 0.5 * min(high, nh) and nx <= left + wide + gap:
                        right, low = max(left + wide, nx + nw), max(top + high, ny + nh)
                        left, top = min(left, nx), min(top, ny)
                        wide, high = right - left, low - top
                        continue
                if left is not None:
                    out.append((*key, left, top, wide, high))
                if new:
                    key = tuple(next(names).values())
                left, top, wide, high = nx, ny, nw, nh
            yield written(out)
        if left is not None:
            yield written([(*key, left, top, wide, high)])

    def written(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=[*group, *box])

    return in_order(marks.select(*group, *box), group, "ny", "nx", "nw", "nh").mapInArrow(join, "doc_id long, page int, kind string, nx double, ny double, nw double, nh double")


def keyword_hits(texts: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """texts with keyword and n_hits, a row for each lower-case keyword that the text holds, of any number of them."""
    searched = texts.withColumn("_lower", F.lower(text))
    return find(searched, "_lower", keywords.withColumn("_pattern", F.col("keyword")), "_pattern", ["keyword"]).drop("_lower")


def residue(blobs: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc_id, needle, enc) of needles found in the content of a blob in any of their encodings."""
    text = F.col("needle")
    forms = {"utf8": F.encode(text, "utf-8"), "utf16be": F.encode(text, "utf-16be"), "bom-utf16be": F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "utf-16be")),
             "hex-utf8": F.encode(F.lower(F.hex(F.encode(text, "utf-8"))), "utf-8"), "hex-utf16be": F.encode(F.lower(F.hex(F.encode(text, "utf-16be"))), "utf-8")}
    coded = needles.select("needle", F.explode(F.array(*[F.struct(F.lit(k).alias("enc"), v.alias("bytes")) for k, v in forms.items()])).alias("f"))
    return find(blobs.select("doc_id", "content"), "content", coded.select("needle", "f.enc", "f.bytes"), "bytes", ["needle", "enc"]).select("doc_id", "needle", "enc")

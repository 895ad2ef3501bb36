"""Removal of long repeated byte strings by column-wise multi-document construction.

A string of LENGTH bytes that starts at two places anywhere in the collection is
repeated; every byte that a repeated string covers is removed.

1. Each string is known by an anchor, the least hash among its grams (the
   leftmost on ties), so equal strings meet at equal anchors and at the same
   place relative to it. Neighbouring strings with one anchor form a context of
   at most 2 * LENGTH bytes. Contexts whose anchor occurs once hold no repeat.
2. Contexts that are equal are repeated outright; one of each goes on.
3. The contexts of an anchor are a collection of documents aligned at it. They
   are sorted column by column from the right: each round inserts one symbol of
   every document, which updates the collection's Burrows-Wheeler transform (the
   symbols before its suffixes, in the suffixes' order) and the common prefixes
   of neighbours. Where a common prefix reaches LENGTH at a string's first
   column, it is repeated.

A round passes once, in sequence, over the transform, the order and the common
prefixes. In place of external files these are arrays of a batch of anchors, so
a task's memory is bounded by HOT contexts. An anchor with more of them is split
by the bytes beside it: a string holds half of what it has besides its anchor on
one side of it at least, and those bytes are part of the finer anchor. Parts
that are still too large are split again; equal strings stay together.

Defined cases
  null or empty text       0 bytes, nothing removed, hash of nothing
  shorter than LENGTH      nothing removed
  very long text           read in parts of CHUNK bytes, cut whole
  null doc_id              a document like any other
  repeated rows, ties      each is a place of its own, so a repeated row of LENGTH bytes or more is removed
  empty table              empty result
  clashing columns         a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import BROADCAST_ROWS, settled, small, stored
from foliospark.llm.minmax import made, mix

LENGTH, GRAM = 200, 32
#: Bytes of a text that are looked at at once; contexts of one task's round; contexts of an anchor beyond which it is split.
CHUNK, BATCH, HOT = 1 << 20, 4096, 20_000
PAD = 256
OUT = ["n_bytes", "n_removed", "spans", "kept_bytes"]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on; GRAM is a power of two."""
    h, factor, n = raw.astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor = factor * factor % 2**64 | 1
        n *= 2
    return mix(h)


def least_of(v: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    at = 1
    while 2 * at <= n:
        v, at = np.minimum(v[:-at], v[at:]), 2 * at
    return np.minimum(v[: len(v) - (n - at)], v[n - at :]) if n > at else v


def contexts(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, strings, lead, anchor) arrays: where a context starts, how many strings start in it, how far on its anchor is."""
    for base in range(0, len(raw) - LENGTH + 1, CHUNK):
        part = raw[base : base + CHUNK + LENGTH - 1]
        h = gram_hashes(part)
        place = np.arange(len(h), dtype=np.uint64)
        least = least_of((h & np.uint64(0xFFFFFFFFFFE00000)) | place, LENGTH - GRAM + 1)
        anchor = (least & np.uint64(0x1FFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        strings = np.diff(np.append(start, len(anchor)))
        yield start + base, strings, anchor[start] - start, h[anchor[start]].view(np.int64)


CONTEXT = "anchor long, ctx long, doc_id long, text_hash long, place long"


def unpacked() -> tuple[Column, Column, Column]:
    """start, lead and strings: place holds them in one number, as contexts are many."""
    part = lambda shift, mask: F.shiftright("place", shift).bitwiseAND(mask).cast("int")
    return part(16, 2**31 - 1), part(8, 255), part(0, 255)


def all_contexts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """CONTEXT rows of the texts; ctx is a hash of the context's bytes and lead."""
    schema = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = t.as_buffer()
                if data is None or len(data) < LENGTH:
                    continue
                view = memoryview(data)
                for start, strings, lead, anchor in contexts(np.frombuffer(data, np.uint8)):
                    end = start + strings + LENGTH - 1
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
                    ctx = mix(ctx + lead.astype(np.uint64)).view(np.int64)
                    n = len(start)
                    columns = [anchor, ctx, pa.array([doc] * n, pa.int64()), np.full(n, key), (start << 16) | (lead << 8) | strings]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    narrow = docs.select(F.col(doc_id).cast("long"), F.xxhash64(text), F.col(text).cast("binary").alias("raw"))
    return narrow.mapInArrow(run, CONTEXT)


def context_bytes(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """PIECE rows, whole contexts, for the wanted rows of CONTEXT."""
    start, lead, strings = unpacked()
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "ctx", start.alias("start"), lead.alias("lead"), strings.alias("strings"))).alias("parts"))
    lists = stored(lists.toDF("_doc", "_hash", "parts"), "lists")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("raw"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    names = lists.select("_doc", "_hash")
    if names.count() <= BROADCAST_ROWS:  # then only texts that are asked for are shuffled
        texts = texts.join(F.broadcast(names), same, "left_semi")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                raw, rows = batch.column("raw")[at].as_py(), batch.column("parts")[at].as_py()
                yield made([(p["anchor"], p["anchor"], p["ctx"], 0, 0, GRAM, p["lead"], raw[p["start"] : p["start"] + p["strings"] + LENGTH - 1]) for p in rows], PIECE_ARROW)

    # a row given twice gives its contexts twice: see shared_strings
    return texts.join(lists, same).select("raw", "parts").mapInArrow(run, PIECE)


#: A context or the part of one that a finer anchor has: part is the anchor that it is dealt by, first the number of its
#: first string in the context, back and ahead how far the anchor reaches to the left and right of its place, lead that place.
PIECE = "part long, anchor long, ctx long, first int, back int, ahead int, lead int, raw binary"
PIECE_ARROW = pa.schema([*((n, pa.int64()) for n in ("part", "anchor", "ctx")), *((n, pa.int32()) for n in ("first", "back", "ahead", "lead")), ("raw", pa.binary())])


def split(part: int, anchor: int, ctx: int, first: int, back: int, ahead: int, lead: int, raw: bytes) -> Iterator[tuple]:
    """The parts of a piece under finer anchors: strings that reach far to the left of the anchor, and the others."""
    strings, free = len(raw) - LENGTH + 1, LENGTH - back - ahead
    half = (free + 1) // 2
    far = max(0, min(strings, lead - back - half + 1))  # so many strings have half of their free bytes on the left
    for left, a, b in ((True, 0, far), (False, far, strings)):
        if a == b:
            continue
        wide, deep = (back + half, ahead) if left else (back, ahead + free - half + 1)
        key = mix(np.array([xxhash.xxh3_64_intdigest(raw[lead - wide : lead + deep], seed=2 * wide + left)], np.uint64) + np.uint64(part % 2**64)).view(np.int64)
        yield int(key[0]), anchor, ctx, first + a, wide, deep, lead - a, raw[a : b + LENGTH - 1]


def dealt(pieces: DataFrame, hot: int) -> DataFrame:
    """pieces whose parts have at most hot rows each, or hold one string alone; made from stored pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces_of(batch):
                yield made([x for row in rows for x in split(*row)], PIECE_ARROW)

    done, free = [], F.lit(LENGTH) - F.col("back") - F.col("ahead")
    while True:
        much = pieces.groupBy("part").agg(F.count("*").alias("n"), F.max(free).alias("free")).filter((F.col("n") > hot) & (F.col("free") > 0))
        much = stored(much.select("part"), "hot")
        if not much.limit(1).count():
            break
        much = small(much)
        done.append(pieces.join(much, "part", "left_anti"))
        pieces = stored(pieces.join(much, "part", "left_semi").mapInArrow(run, PIECE), "split")
    for part in done:
        pieces = pieces.unionByName(part)
    return pieces


def pieces_of(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[list[tuple]]:
    for at in range(0, batch.num_rows, rows):
        yield list(zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True))




def insert_columns(group: np.ndarray, lead: np.ndarray, raws: list[bytes]) -> np.ndarray:
    """repeated[i, c]: whether the string of context i that starts c columns before its anchor's last place is shared.

    group: sorted numbers of the anchors. Column-wise construction: from the last
    column to the first, one symbol of every context is put before its suffix.
    """
    n, reach = len(raws), LENGTH - GRAM
    table = np.full((n, reach + LENGTH), PAD, np.int32)
    strings = np.array([len(r) - LENGTH + 1 for r in raws])
    for i, raw in enumerate(raws):
        table[i, reach - lead[i] : reach - lead[i] + len(raw)] = np.frombuffer(raw, np.uint8)
    table += (group * (PAD + 1)).astype(np.int32)[:, None]
    pad = (group * (PAD + 1) + PAD).astype(np.int32)
    order, common = np.arange(n), np.zeros(n, np.int64)
    repeated = np.zeros((n, reach + 1), bool)
    first = reach - lead
    for column in range(reach + LENGTH - 1, -1, -1):
        transform = table[order, column]  # the symbols before the suffixes, in their order
        by = np.argsort(transform, kind="stable")
        symbols = transform[by]
        low, high = by[:-1], by[1:]
        near = common[high]
        apart = np.flatnonzero((symbols[1:] == symbols[:-1]) & (high != low + 1))
        if len(apart):  # the least common prefix over the rows between
            bounds = np.empty(2 * len(apart), np.int64)
            bounds[0::2], bounds[1::2] = low[apart] + 1, high[apart] + 1
            near[apart] = np.minimum.reduceat(np.append(common, 0), bounds)[0::2]
        order = order[by]
        common = np.zeros(n, np.int64)
        common[1:] = np.where((symbols[1:] == symbols[:-1]) & (symbols[1:] != pad[order[1:]]), near + 1, 0)
        if column <= reach:
            most = np.maximum(common, np.append(common[1:], 0))
            repeated[order, column] = most >= LENGTH
    columns = np.arange(reach + 1)[None, :]
    return repeated & (columns >= first[:, None]) & (columns < (first + strings)[:, None])


def runs_of(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"from": int(a), "to": int(b)} for a, b in zip(edges[0::2], edges[1::2], strict=True)]


def shared_strings(pieces: DataFrame) -> DataFrame:
    """(anchor, ctx, runs): runs of repeated strings in each context, from PIECE rows."""
    schema = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("runs", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        parts, lead = np.array([r[0] for r in rows]), np.array([r[6] for r in rows])
        group = np.cumsum(np.concatenate([[0], parts[1:] != parts[:-1]])).astype(np.int64)
        flags = insert_columns(group, lead, [r[7] for r in rows])
        at = LENGTH - GRAM - lead
        out = [(r[1], r[2], [{"from": x["from"] + r[3], "to": x["to"] + r[3]} for x in runs_of(f[a:])]) for r, f, a in zip(rows, flags, at, strict=True) if f.any()]
        return made(out, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for row in (r for batch in batches for rows in pieces_of(batch) for r in rows):
            if last is not None and row[:4] == last[:4]:
                continue  # the same row was given twice
            if last is not None and row[0] != last[0] and len(held) >= BATCH:
                yield solve(held)
                held = []
            held.append(row)
            last = row
        if held:
            yield solve(held)

    single = F.col("back") + F.col("ahead") == LENGTH
    several = pieces.filter(~single).repartition("part").sortWithinPartitions("part", "anchor", "ctx", "first")
    inserted = several.mapInArrow(run, "anchor long, ctx long, runs array<struct<from:int,to:int>>")
    # a part whose anchor is a whole string holds that string alone: nothing is left to insert
    alone = pieces.filter(single).select("part", "anchor", "ctx", "first").distinct()
    often = small(stored(alone.groupBy("part").count().filter("count > 1").select("part"), "often"))
    run_ = F.array(F.struct(F.col("first").alias("from"), (F.col("first") + 1).alias("to")))
    return inserted.unionByName(alone.join(often, "part").select("anchor", "ctx", run_.alias("runs")))


def repeated_spans(docs: DataFrame, text: str, doc_id: str, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, spans): for each document with a repeated string, the bytes that such strings cover."""
    found = stored(all_contexts(docs, text, doc_id), "all-contexts")
    start, _, strings = unpacked()
    # anchors grow with the corpus: they are shuffled, never broadcast
    anchors = stored(found.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    found = stored(found.join(anchors.hint("merge"), "anchor"), "contexts")
    first = F.min(F.struct("doc_id", "text_hash", "place"))
    distinct = stored(found.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), first.alias("rep")).select("anchor", "ctx", "n", "rep.*"), "distinct")
    several = stored(distinct.groupBy("anchor").count().filter("count > 1").select("anchor"), "several")
    wanted = distinct.join(several.hint("merge"), "anchor")
    pieces = context_bytes(docs, wanted.select("anchor", "ctx", "doc_id", "text_hash", "place"), text, doc_id)
    pieces = dealt(stored(pieces, "pieces"), hot)
    shared = shared_strings(pieces)
    whole = F.array(F.struct(F.lit(0).alias("from"), strings.alias("to")))
    same = distinct.filter("n > 1").select("anchor", "ctx", whole.alias("runs"))
    single = distinct.filter("n = 1").select("anchor", "ctx")
    verdict = stored(same.unionByName(stored(shared, "shared").join(single, ["anchor", "ctx"], "left_semi")), "verdict")
    hit = found.join(verdict, ["anchor", "ctx"]).select("doc_id", "text_hash", F.transform("runs", lambda r: F.struct((r["from"] + start).alias("start"), (r["to"] - 1 + LENGTH + start).alias("end"))).alias("spans"))
    hit = hit.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.array([merged(s.as_py()) for s in batch.column("spans")], span)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), whole], names=batch.schema.names)

    return hit.mapInArrow(join, "doc_id long, text_hash long, spans array<struct<start:int,end:int>>")


def merged(spans: list[dict]) -> list[dict]:
    """The spans sorted, those that overlap or touch made one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """docs with n_bytes, n_removed, spans (array<struct<start,end>> of removed bytes) and kept_bytes (the rest).

    keep: the columns of docs to return, all by default.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    found = settled(lambda: repeated_spans(docs, text, doc_id, hot).toDF("_doc", "_hash", "_spans"), "spans")
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_hash"))
    both = docs.join(small(found), same, "left").select(*{*keep}, F.col(text).cast("binary").alias("_raw"), "_spans")
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_bytes binary").fields])
    own = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for raw, spans in zip(part.column("_raw"), part.column("_spans"), strict=True):
                    raw, gone = raw.as_py() or b"", spans.as_py() or []
                    cuts = [0, *(x for s in gone for x in (s["start"], s["end"])), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(cuts[0::2], cuts[1::2], strict=True))
                    rows.append((len(raw), len(raw) - len(left), gone, left))
                yield pa.RecordBatch.from_arrays([*map(part.column, keep), *made(rows, own).columns], names=[*keep, *own.names])

    return both.mapInArrow(run, schema)

"""Ranked lexical search: Block-Max MaxScore over shards of documents.

1. The queries (items) are taken in blocks of bounded bytes; a block's terms get numbers. One pass over the documents
   counts each text's terms and keeps those of the block, as a forward index that is stored. Document frequencies, the
   number of documents and of terms are counted from it by Spark, over all documents.
2. A task reads its part of the forward index shard by shard (a bounded run of documents). Of each shard it makes
   posting lists in blocks of 128, compressed: gaps and frequencies in the least width that holds them. A list knows its
   largest impact, a block its own.
3. A query takes its lists in descending order of their bounds. As long as all lists to come could lift a new document
   over the threshold, lists are essential and read whole. Beyond that no document is added: for the documents found,
   the bounds of their blocks in the next list are added up, those that can't reach the threshold any more are dropped,
   and only blocks that hold one of the others are decompressed. The threshold is the k-th best score so far, of this
   shard's partial scores or of the task's earlier shards.
4. Each task gives its heap of k documents a query; heaps are merged by Spark.

Only documents that are strictly below the threshold are dropped, so ties are whole.

Scores are integers of 64 bits, by the weights stated in `weigh` and `part`; both take the whole texts.

Defined cases
  null or empty text, no terms   a document is not counted and never found; an item has no rows
  null doc_id                    a document like any other, behind all ids on ties
  repeated rows                  each document row is a document; equal rows of items are one item
  null item_id                   an item like any other
  ties                           by ascending doc_id
  very long text                 held by one task; a shard holds a bounded number of postings, or one document's
  empty table                    empty result
  extra columns                  left out, whatever their names
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import settled, stored, text_key

#: Terms of lower-cased UTF-8: ASCII letters and digits, and every other character.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of the items in a block of queries; postings in a block of a list; documents and postings of a shard.
QUERY_BYTES, BLOCK, SHARD_DOCS, SHARD_POSTINGS = 8 * 1024 * 1024, 128, 16_384, 4_000_000
#: Stands for a missing id: behind all others.
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())  # bytes: A-Z only


def weigh(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's part of the score but for the weight: saturating in tf, smaller in longer documents."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def narrow(values: np.ndarray) -> np.ndarray:
    """values in the least unsigned type that holds them."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 2**8 else np.uint16 if top < 2**16 else np.uint32)


class PostingList:
    """Places (ascending) and frequencies of a term in a shard, in compressed blocks with bounds."""

    def __init__(self, places: np.ndarray, tfs: np.ndarray, parts: np.ndarray) -> None:
        self.n = len(places)
        pad = -self.n % BLOCK
        at = np.concatenate([places, np.full(pad, places[-1])]).reshape(-1, BLOCK)
        self.first, self.last = at[:, 0].copy(), at[:, -1].copy()
        self.gaps = narrow(np.diff(at, axis=1, prepend=at[:, :1]))
        self.tfs = narrow(np.concatenate([tfs, np.zeros(pad, tfs.dtype)]).reshape(-1, BLOCK))
        self.bounds = np.concatenate([parts, np.zeros(pad, parts.dtype)]).reshape(-1, BLOCK).max(axis=1)
        self.bound = int(self.bounds.max())

    def blocks(self, some: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Places and frequencies of some blocks, decompressed; what pads the last block has frequency 0."""
        at = np.cumsum(self.gaps[some], axis=1, dtype=np.int64) + self.first[some][:, None]
        return at.ravel(), self.tfs[some].ravel().astype(np.int64)


class Shard:
    """The lists of a bounded run of documents."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """ids and m by document; terms and tfs of all documents, lengths of them each."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.m = ids[order], m[order]
        owner = np.repeat(place, lengths)
        by = np.lexsort((owner, terms))
        terms, owner, tfs = terms[by], owner[by], tfs[by].astype(np.int64)
        parts = part(tfs, self.m[owner])
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        ends = np.append(starts[1:], len(terms))
        self.lists = {int(terms[a]): PostingList(owner[a:b], tfs[a:b], parts[a:b]) for a, b in zip(starts, ends, strict=True)}

    def best(self, query: list[tuple[int, int]], k: int, threshold: int, seen: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best documents that reach the threshold, for (term, weight) pairs."""
        lists = sorted(((w * self.lists[t].bound, w, self.lists[t]) for t, w in query if w > 0 and t in self.lists), key=lambda x: -x[0])
        left = sum(x[0] for x in lists)
        score = np.zeros(len(self.ids), np.int64)
        found = np.empty(0, np.int64)
        essential = 0
        for bound, w, one in lists:  # while a document that no list before holds could still reach the threshold
            if left < threshold:
                break
            at, tf = one.blocks(slice(None))
            at, tf = at[: one.n], tf[: one.n]
            score[at] += w * part(tf, self.m[at])
            left -= bound
            essential += 1
            found = np.flatnonzero(score)
            if len(found) >= k:
                threshold = max(threshold, int(np.partition(score[found], -k)[-k]))
        if seen is not None:
            seen["essential"] += essential
        found = found[score[found] + left >= threshold]
        for bound, w, one in lists[essential:]:
            if not len(found):
                break
            left -= bound
            block = np.minimum(np.searchsorted(one.last, found), len(one.last) - 1)
            inside = (one.first[block] <= found) & (found <= one.last[block])
            limit = np.where(inside, w * one.bounds[block], 0)
            can = score[found] + limit + left >= threshold
            found, block, inside = found[can], block[can], inside[can]
            need = np.unique(block[inside])
            if seen is not None:
                seen["blocks"] += len(one.first)
                seen["decompressed"] += len(need)
            if len(need):
                at, tf = one.blocks(need)
                hit = (tf > 0) & np.isin(at, found)
                at, tf = at[hit], tf[hit]
                score[at] += w * part(tf, self.m[at])
            if len(found) >= k:
                threshold = max(threshold, int(np.partition(score[found], -k)[-k]))
                found = found[score[found] + left >= threshold]
        found = found[(score[found] >= threshold) & (score[found] > 0)]
        top = found[np.lexsort((found, -score[found]))][:k]
        return self.ids[top], score[top]


def forward(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have terms: how many in all, and numbers and counts of those in number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, lengths, terms, tfs = [], [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    held = [(number[t], c) for t, c in Counter(words).items() if t in number]
                    ids.append(doc)
                    sizes.append(len(words))
                    lengths.append(len(held))
                    terms += [t for t, _ in held]
                    tfs += [c for _, c in held]
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.int32())
            of = lambda flat: pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), of(terms), of(tfs)], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def merge(heap: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two heaps."""
    ids, scores = np.concatenate([heap[0], more[0]]), np.concatenate([heap[1], more[1]])
    top = np.lexsort((ids, -scores))[:k]
    return ids[top], scores[top]


def heaps(index: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each task's documents for each query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        best = [none] * len(queries)
        held: list[tuple] = []

        def close() -> None:
            ids, n, lengths, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            shard = Shard(ids, 25 + 75 * n * n_docs // n_terms, lengths, terms, tfs)
            for i, query in enumerate(queries):
                threshold = int(best[i][1][-1]) if len(best[i][1]) == k else 1
                best[i] = merge(best[i], shard.best(query, k, threshold), k)

        rows = postings = 0
        for batch in batches:
            lists = {c: batch[c] for c in ("terms", "tfs")}
            lengths = np.diff(lists["terms"].offsets.to_numpy()).astype(np.int64)
            flat = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
            ids = batch["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            n = batch["n"].to_numpy(zero_copy_only=False)
            to = np.concatenate([[0], np.cumsum(lengths)])
            for a in range(0, len(ids), 1024):
                b = min(a + 1024, len(ids))
                held.append((ids[a:b], n[a:b], lengths[a:b], flat["terms"][to[a] : to[b]], flat["tfs"][to[a] : to[b]]))
                rows, postings = rows + b - a, postings + to[b] - to[a]
                if rows >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    close()
                    rows = postings = 0
        if held:
            close()
        sizes = [len(x[0]) for x in best]
        ids, scores = (np.concatenate([x[c] for x in best]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())],
            names=["query", "doc_id", "score"],
        )

    return index.mapInArrow(search, "query long, doc_id long, score long")


def top_k(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text) with a score above 0."""
    wanted = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // query_bytes + 1
    named = stored(wanted.withColumn("part", F.pmod(F.xxhash64(text_key(F.col("text"))), F.lit(parts))), "items")
    spark = docs.sparkSession
    out = None
    for p in range(parts):
        block = [(r.item_id, terms_of(r.text)) for r in named.filter(F.col("part") == p).select("item_id", "text").collect()]
        block = [(i, Counter(t)) for i, t in block if t]
        if not block:
            continue
        number = {t: j for j, t in enumerate(sorted({t for _, c in block for t in c}))}
        index = stored(forward(docs, number), "forward")
        n_docs, n_terms = index.agg(F.count("*"), F.sum("n")).first()
        df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = {t: weigh(n_docs, df[j]) for t, j in number.items() if j in df}
        queries = [[(number[t], c * weight[t]) for t, c in terms.items() if t in weight] for _, terms in block]
        found = heaps(index, queries, n_docs, n_terms or 1, k)
        names = spark.createDataFrame([(j, i) for j, (i, _) in enumerate(block)], f"query long, item_id {dict(items.dtypes)['item_id']}")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(F.broadcast(names), "query")
        ranked = stored(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
    kind = dict(items.dtypes)["item_id"]
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def search(docs: DataFrame, items: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """top_k as one stored table; the index is deleted."""
    return settled(lambda: top_k(docs, items, k, query_bytes), "found")

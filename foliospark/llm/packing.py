"""Vector best-fit packing of documents into sequences.

A document's ids are cut into pieces only where they are longer than a
sequence. A sequence has three capacities: tokens, documents, and attention
cost (the sum of the squared lengths, as documents don't attend to each other).
Pieces are placed from the longest down. Of the bins that can take a piece under
every constraint, the one with the least norm of its weighted residual
capacities is chosen, or the one with the largest weighted dot product of
residual and demand; a new bin is opened only when none can.

Every open bin is scored for every piece, in one array of residuals; bins that
no later piece can enter leave it.

Pieces are dealt into blocks by a hash and each block is packed by one task, so
memory is bounded by BLOCK_PIECES; a block costs at most one sequence that is
less than half full.

With the default capacities only the tokens bind, as a sequence is to hold as
much as it can: 1,024 documents have 1,024 tokens at least, and squares of
lengths that sum to the capacity sum to its square at most. The other two then
choose between bins of equal residual tokens; the pipeline bounds the documents.

Defined cases
  null or empty text    the end id alone
  null doc_id           packed like any other
  repeated rows, ties   each row is packed; ties go by id, then by place
  very long text        tokenized whole by one task, in time linear in its length, and cut
  special strings       `<|endoftext|>` in a text is the one id that the tokenizer gives it
  empty table           empty result
  clashing columns      only the id and text columns are read
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

END, CAPACITY, DOCUMENTS = 2, 1024, 1024
BLOCK_PIECES = 5_000
#: Texts with as long a run of white space go to the tokenizers library: tiktoken's pattern fails on very long ones.
LONG_BLANK = re.compile(r"\s{10000}")
#: The tokenizer's one special string, and the pattern by which it splits texts.
SPECIAL = {"<|endoftext|>": 50256}
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids binary"


class Encoder:
    """Ids of texts by a tokenizers file.

    Its ranks and merges are given to tiktoken, which finds the same ids in a quarter of the time.
    """

    def __init__(self, path: str) -> None:
        self.exact = Tokenizer.from_file(path)
        raw = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(raw[c] for c in piece): i for piece, i in self.exact.get_vocab(with_added_tokens=False).items() if piece not in SPECIAL}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= 10_000 and LONG_BLANK.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in visible)}


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of each row of docs; ids are unsigned 32-bit, little-endian.

    path: the tokenizers file (.json), on every machine.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.append(encode(t.as_py() or ""), np.array([end], "<u4"))
                    rows += [(doc, i, start, n, ids[start : start + n].tobytes()) for i, (start, n) in enumerate(cut(len(ids), capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


class Bins:
    """Residual capacities of the open bins, a row each, and their numbers."""

    def __init__(self, capacity: int, documents: int, attention: int, weights: tuple[float, float, float], rule: str) -> None:
        self.full = np.array([capacity, documents, attention], float)
        self.weights, self.rule = np.array(weights), rule
        self.left, self.number = np.zeros((64, 3)), np.zeros(64, np.int64)
        self.open = self.made = 0

    def choose(self, demand: np.ndarray) -> int | None:
        """The row of the best bin that can take the demand; of equal ones the first opened."""
        left = self.left[: self.open]
        fits = np.flatnonzero((left >= demand).all(axis=1))
        if not len(fits):
            return None
        left = left[fits]
        if self.rule == "norm":
            share = (left - demand) / self.full
            score = -(share * share) @ self.weights
        else:
            score = (left / self.full) @ (self.weights * demand / self.full)
        return int(fits[np.argmax(score)])

    def place(self, n: int, least: int) -> int:
        """The number of the bin that takes a piece of n tokens; least: tokens of the smallest piece to come."""
        demand = np.array([n, 1, n * n], float)
        at = self.choose(demand)
        if at is None:
            at = self.open
            if at == len(self.left):
                self.left, self.number = np.resize(self.left, (2 * at, 3)), np.resize(self.number, 2 * at)
            self.left[at], self.number[at] = self.full, self.made
            self.open, self.made = self.open + 1, self.made + 1
        number = int(self.number[at])
        self.left[at] -= demand
        if (self.left[at] < (least, 1, least * least)).any():  # closed: later rows move up, so that ties stay in order
            self.left[at : self.open - 1] = self.left[at + 1 : self.open]
            self.number[at : self.open - 1] = self.number[at + 1 : self.open]
            self.open -= 1
        return number


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, documents: int = DOCUMENTS, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """pieces with sequence_id (long) and offset (long). pieces needs doc_id, piece, start and length.

    documents, attention: the other capacities of a sequence; attention is capacity squared by default, what one
    document of full length costs. rule: `norm` of residuals or `dot` product with the demand.
    """
    attention = capacity * capacity if attention is None else attention
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in {"sequence_id", "offset"}])
    whole = F.col("length") >= capacity
    n = pieces.filter(~whole).count()
    blocks = max(1, round(n / block_pieces))
    by = F.xxhash64("doc_id", "piece", *[c for c in pieces.columns if c not in ("doc_id", "piece")])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def run(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("_block").sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, used = Bins(capacity, documents, attention, weights, rule), []
        number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        lengths = rows.column("length").to_pylist()
        for i, length in enumerate(lengths):
            b = bins.place(length, lengths[-1])
            if b == len(used):
                used.append(0)
            number[i], offset[i] = b, used[b]
            used[b] += length
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 40) + number * 2)).append_column("offset", pa.array(offset))

    short = pieces.filter(~whole).withColumn("_block", F.pmod(by, F.lit(blocks)).cast("int")).groupBy("_block").applyInArrow(run, schema)
    # a piece of full length is a sequence of its own; odd numbers are theirs
    alone = pieces.filter(whole).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return short.unionByName(alone)


def digest(pieces: DataFrame) -> DataFrame:
    """pieces with the checksum of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")

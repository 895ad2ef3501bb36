"""Search for many needles at once: one automaton reads each text or blob a single time, however many needles there are.

The needles are taken in blocks of bounded bytes, so that an automaton fits every worker; each block is one pass over the
texts, and no task compares a text with needles that it doesn't hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the needles in an automaton.
BLOCK_BYTES = 4 * 1024 * 1024
#: The automaton that a worker has made last.
MADE: dict[str, ahocorasick.Automaton] = {}


def plain(value: str | bytes) -> str:
    """Bytes as the characters of their numbers: the automaton knows strings only."""
    return value if isinstance(value, str) else bytes(value).decode("latin-1")


def automaton(name: str, patterns: list[str]) -> ahocorasick.Automaton:
    if name not in MADE:
        MADE.clear()
        made = ahocorasick.Automaton()
        for i, pattern in enumerate(patterns):
            made.add_word(pattern, i)
        made.make_automaton()
        MADE[name] = made
    return MADE[name]


def counts(made: ahocorasick.Automaton, patterns: list[str], text: str) -> dict[int, int]:
    """Occurrences of each pattern in text that don't overlap one before."""
    found: dict[int, int] = {}
    reach: dict[int, int] = {}
    for end, i in made.iter(text):
        if end - len(patterns[i]) >= reach.get(i, -1):
            reach[i] = end
            found[i] = found.get(i, 0) + 1
    return found


def find(rows: DataFrame, column: str, needles: DataFrame, pattern: str, labels: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with the labels of each needle that their column holds, and n_hits: how often, without overlaps.

    column and pattern are both strings or both binary; empty needles and nulls match nothing. labels are strings.
    """
    wanted = needles.filter(F.octet_length(pattern) > 0).select(pattern, *labels).distinct()
    size = wanted.agg(F.sum(F.octet_length(pattern))).first()[0] or 0
    parts = size // block_bytes + 1
    kept = rows.schema.names
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *(f"`{x}` string" for x in labels), "n_hits int"])

    def one(block: list) -> DataFrame:
        by: dict[str, list] = {}
        for row in block:
            by.setdefault(plain(row[0]), []).append(list(row[1:]))
        patterns, name = list(by), uuid.uuid4().hex
        shared = rows.sparkSession.sparkContext.broadcast((patterns, list(by.values())))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            patterns, named = shared.value
            made = automaton(name, patterns) if patterns else None
            for batch in batches:
                at, hits, texts = [], [], []
                for k, text in enumerate(batch["_searched"].to_pylist()):
                    if text and made:
                        for i, n in counts(made, patterns, plain(text)).items():
                            for label in named[i]:
                                at.append(k)
                                texts.append(label)
                                hits.append(n)
                held = batch.select(kept).take(pa.array(at, pa.int64()))
                columns = [pa.array([t[x] for t in texts], pa.string()) for x in range(len(labels))]
                yield pa.RecordBatch.from_arrays([*held.columns, *columns, pa.array(hits, pa.int32())], names=[*kept, *labels, "n_hits"])

        return rows.withColumn("_searched", F.col(column)).mapInArrow(search, out_schema)

    if parts == 1:
        return one(wanted.collect())
    numbered = wanted.withColumn("_part", F.pmod(F.xxhash64(pattern), F.lit(parts)))
    out = None
    for p in range(parts):
        found = one(numbered.filter(F.col("_part") == p).drop("_part").collect())
        out = found if out is None else out.unionByName(found)
    return out

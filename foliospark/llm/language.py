"""Language identification by hierarchical discrimination.

First the language family is predicted, then the language within it. Families
are the clusters of the learned languages' mean features. A linear support
vector machine tells families apart (one against the rest); within a family one
machine for each pair of languages votes.

Features are hashed byte trigrams of the whole lower-cased text. Every language
that a document is labelled with is learned. The machines are fitted on a
bounded sample of distinct labelled texts: max_rows in all, shared out evenly,
per_lang of a language at most and one at least. All documents are judged, one
by one in Arrow batches.

Defined cases
  null text, no letter     und, score 0
  nothing to learn from    und, score 0
  null label               not learned from
  null doc_id              not held out
  repeated rows, ties      judged alike; a text counts once in the sample
  very long text           judged whole
  empty table              empty result
  clashing columns         a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import small, stored

DIMENSIONS = 4096
OUT = ["held_out", "lang_pred", "family", "score"]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a unit vector: the square roots of hashed trigram counts."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    codes = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    counts = np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMENSIONS)
    at = np.flatnonzero(counts).astype(np.uint16)
    x = np.sqrt(counts[at]).astype(np.float32)
    return at, x / np.linalg.norm(x)


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 200, penalty: float = 1e-3, rate: float = 1.0) -> np.ndarray:
    """Weights of a linear machine under squared hinge loss; y is +1 or -1, both sides weighted alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = speed = np.zeros(x.shape[1], np.float32)
    for _ in range(steps):
        miss = np.maximum(0, 1 - y * (x @ w)) * weight * y
        speed = 0.9 * speed + (2 * (miss @ x) - penalty * w)
        w = w + rate * 0.25 * speed
    return w


@dataclass
class Model:
    """families: names of languages by family; against: a machine for each family; between: one for each pair within."""

    families: list[list[str]]
    against: np.ndarray
    between: dict[tuple[str, str], np.ndarray]

    def predict(self, text: str | None) -> tuple[str, str | None, float]:
        if not self.families or not text or not any(map(str.isalpha, text)):
            return "und", None, 0.0
        at, x = trigrams(text)
        margin = lambda w: w[..., at] @ x + w[..., -1]
        margins = margin(self.against) if len(self.families) > 1 else np.ones(1)
        family = int(np.argmax(margins))
        sure = [float(margins[family])]
        names, votes = self.families[family], dict.fromkeys(self.families[family], 0.0)
        for (a, b) in combinations(names, 2):
            m = float(margin(self.between[a, b]))
            votes[a if m > 0 else b] += 1 + min(abs(m), 9.0) / 1000  # ties go to the wider margins
            sure.append(abs(m))
        return max(names, key=lambda n: votes[n]), "+".join(names), float(1 / (1 + np.exp(-2 * min(sure))))


def families_of(names: list[str], centres: np.ndarray) -> list[list[str]]:
    """Clusters of the languages by average similarity, about as many as the square root of their number."""
    groups, sums = [[n] for n in names], centres @ centres.T
    sizes = np.ones(len(names))
    for _ in range(len(names) - max(1, round(len(names) ** 0.5))):
        near = sums / np.outer(sizes, sizes)
        near[np.tril_indices(len(near))] = -np.inf
        i, j = np.unravel_index(int(np.argmax(near)), near.shape)
        sums[i] += sums[j]
        sums[:, i] += sums[:, j]
        sizes[i] += sizes[j]
        sums, sizes = np.delete(np.delete(sums, j, 0), j, 1), np.delete(sizes, j)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model of (language, places, values) rows."""
    rows = sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    if not rows:
        return Model([], np.zeros((0, DIMENSIONS + 1), np.float32), {})
    x = np.zeros((len(rows), DIMENSIONS + 1), np.float32)
    x[:, -1] = 1
    for i, (_, at, values) in enumerate(rows):
        x[i, at] = values
    names, known = np.array([r[0] for r in rows]), sorted({r[0] for r in rows})
    centres = np.stack([x[names == n, :-1].mean(axis=0) for n in known])
    families = families_of(known, centres / np.linalg.norm(centres, axis=1, keepdims=True))
    against = np.stack([fit_svm(x, np.where(np.isin(names, g), 1, -1).astype(np.float32)) for g in families])
    between = {}
    for g in families:
        for a, b in combinations(g, 2):
            own = np.isin(names, [a, b])
            between[a, b] = fit_svm(x[own], np.where(names[own] == a, 1, -1).astype(np.float32))
    return Model(families, against, between)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, text: str, lang: str, per_lang: int, max_rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Trigrams of distinct texts of every language, chosen by hash: max_rows in all, per_lang of each and one of each at least."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    order = F.xxhash64(F.col(text))
    first = known.select(F.col(lang).cast("string").alias("lang"), order.alias("h")).distinct()
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # Spark keeps per_lang rows of each task
    first = stored(first.withColumn("n", turn).filter(F.col("n") <= per_lang), "sample")
    share = max(1, max_rows // max(1, first.select("lang").distinct().count()))
    bounds = small(stored(first.filter(F.col("n") <= share).groupBy("lang").agg(F.max("h").alias("_h")).withColumnRenamed("lang", "_lang"), "bounds"))
    chosen = known.join(bounds, (F.col(lang).cast("string") == F.col("_lang")) & (order <= F.col("_h"))).select("_lang", F.col(text).alias("t"))
    chosen = chosen.dropDuplicates(["_lang", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [trigrams(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("_lang"), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (0, 1))], names=["lang", "at", "x"])

    return [(r.lang, np.frombuffer(r.at, np.uint16), np.frombuffer(r.x, np.float32)) for r in chosen.mapInArrow(run, "lang string, at binary, x binary").collect()]


def identify_language(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", keep: list[str] | None = None, per_lang: int = 300, max_rows: int = 20_000
) -> DataFrame:
    """docs with the columns OUT. The machines learn from labelled documents that aren't held out.

    keep: the columns of docs to return, all by default.
    per_lang, max_rows: bounds of the sample that the machines are fitted on.
    """
    model = fit(sample(docs.filter(~held_out(F.col(doc_id))), text, lang, per_lang, max_rows))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string("held_out boolean, lang_pred string, family string, score double").fields])
    judged = docs.withColumn("_held", held_out(F.col(doc_id))).select(*{*keep, text}, "_held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), batch.column("_held"), *columns], names=[*keep, *OUT])

    return judged.mapInArrow(run, schema)

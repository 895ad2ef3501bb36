"""Personal data by base rules and bootstrapped contextual extraction.

The base rules find e-mail and IP addresses, card and phone numbers: the seed
entities. Around every identifier-like token, seed or not, stands a lexical
pattern: the words before it, or the key that it is assigned to. Patterns and
token shapes form a graph whose scores Spark refines in rounds: a pattern is
worth the mean score of its distinct instances, shrunk towards 0 by the few;
an instance is worth the best pattern that it stands in. Seeds stay at 1.
Patterns above a bound then mark the identifiers that no base rule knows.

Texts are read twice by Python in Arrow batches; patterns are counted with
partial aggregation, so a frequent one costs no more than a rare one.

Defined cases
  null or empty text     no spans; the hash is that of the empty string
  repeated rows, ties    judged alike; each counts as a document
  very long text         read whole; a hundred thousand spans take seconds
  empty table            empty result
  clashing columns       a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import small, stored

KINDS = ("email", "ip", "card", "phone", "id")
OUT = {"base": "array<struct<kind:string,start:long,end:long>>", "spans": "array<struct<kind:string,start:long,end:long>>"}
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Starts only where no digit stands before: a start inside a run of digits fails when the run's start does.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A token that may identify: characters of identifiers with a digit among them.
TOKEN = re.compile(r"[A-Za-z0-9@#_][A-Za-z0-9@#_./+-]{4,}[A-Za-z0-9]")
KEY = re.compile(r"([A-Za-z_]+)\s*[:=]\s*[\"']?\Z")
BEFORE = re.compile(r"(\S+)\s+(\S+)\s+\Z")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
#: Opaque values seed patterns too; they become spans only where a trusted pattern stands before them.
OPAQUE = re.compile(r"[0-9a-f]{16,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that no run of characters is scanned twice."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL_PART.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def pattern(text: str, start: int) -> str | None:
    """What stands before an identifier: the key that it is assigned to, or two words."""
    left = text[max(0, start - 80) : start]
    if m := KEY.search(left):
        return f"={m[1].lower()}"
    if m := BEFORE.search(left):
        return f"{m[1].lower()} {m[2].lower()}"
    return None


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, bool, bool]]:
    """(start, end, pattern, seed, base) of the base spans and of other identifier-like tokens."""
    for start, _, end in base:
        if p := pattern(text, start):
            yield start, end, p, True, True
    at = 0
    for m in TOKEN.finditer(text):
        if sum(c.isdigit() for c in m[0]) < 4:
            continue
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        near = at
        while near < len(base) and base[near][0] < m.end() and base[near][2] <= m.start():
            near += 1
        if near < len(base) and base[near][0] < m.end():
            continue
        if p := pattern(text, m.start()):
            yield m.start(), m.end(), p, bool(OPAQUE.fullmatch(m[0])), False


def read(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep with _base and _cands: array<struct<start, end, pattern, instance, seed, base>>."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_()), ("base", pa.bool_())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), *T._parse_datatype_string(f"_base {OUT['base']}, _cands array<struct<start:long,end:long,pattern:string,instance:string,seed:boolean,base:boolean>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, cands = [], []
            for t in batch.column(text):
                t = t.as_py() or ""
                base = base_spans(t)
                bases.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in base])
                cands.append([{"start": s, "end": e, "pattern": p, "instance": t[s:e], "seed": seed, "base": own} for s, e, p, seed, own in candidates(t, base)])
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(bases, span), pa.array(cands, cand)], names=[*keep, "_base", "_cands"])

    return docs.mapInArrow(run, schema)


def trusted_patterns(found: DataFrame, rounds: int, bound: float, support: int) -> DataFrame:
    """Patterns (one column) whose score reaches the bound, from (pattern, instance, seed)."""
    edges = found.groupBy("pattern", F.sha2("instance", 256).alias("instance")).agg(F.max(F.col("seed").cast("double")).alias("seed"))
    # an instance that is a seed anywhere is one everywhere
    edges = stored(edges, "edges")
    scores = edges.groupBy("instance").agg(F.max("seed").alias("score"))
    patterns = None
    for turn in range(rounds):
        patterns = edges.join(scores, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + F.lit(2.0))).alias("worth"), F.count("*").alias("n"))
        patterns = stored(patterns, "patterns")
        if turn < rounds - 1:
            best = edges.join(patterns.filter(F.col("n") >= support), "pattern").groupBy("instance").agg(F.greatest(F.max("seed"), F.max("worth")).alias("score"))
            rest = edges.groupBy("instance").agg(F.max("seed").alias("own"))
            scores = stored(rest.join(best, "instance", "left").select("instance", F.coalesce("score", "own").alias("score")), "scores")
    return patterns.filter((F.col("worth") >= bound) & (F.col("n") >= support)).select("pattern")


def find_personal(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rounds: int = 3, bound: float = 0.5, support: int = 5) -> DataFrame:
    """docs with base and spans; spans holds the base spans and the method's, of kind id, sorted.

    keep: the columns of docs to return, all by default.
    rounds, bound, support: rounds of scoring; a trusted pattern's least score and least number of distinct instances.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUT])
    read_ = stored(read(docs, text, docs.columns if keep is None else keep).withColumn("_row", F.monotonically_increasing_id()), "read")
    flat = read_.select("_row", F.explode("_cands").alias("c")).select("_row", "c.*")
    trusted = stored(trusted_patterns(flat.select("pattern", "instance", "seed"), rounds, bound, support), "trusted")
    more = flat.filter(~F.col("base")).join(small(trusted), "pattern", "left_semi")
    more = more.groupBy("_row").agg(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end")).alias("_more"))
    more = small(stored(more, "more"))
    both = F.concat("_base", F.coalesce("_more", F.array().cast(OUT["spans"])))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.transform(F.array_sort(F.transform(both, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return read_.join(more, "_row", "left").withColumn("spans", ordered).withColumnRenamed("_base", "base").drop("_row", "_cands", "_more")


def written(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, *keep: str) -> DataFrame:
    """The contract's columns, from the operator's."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(*keep, *map(count, KINDS[:4]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[dict]) -> str:
    """text with each of the sorted spans replaced by its kind in brackets."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans are one, named by the first."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    found = find_personal(docs, text, **how)
    hit = F.size("spans") > 0  # only those texts go to Python
    return found.withColumn(text, F.coalesce(clean(F.when(hit, F.col(text)), F.when(hit, F.col("spans"))), F.col(text))).select(*docs.columns)

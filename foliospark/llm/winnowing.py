"""Benchmark decontamination by winnowing.

Of every window of W consecutive k-gram hashes the smallest is kept, in the
training documents and in the benchmark alike. A shared span of k + W - 1 words
holds one whole window on both sides, so both keep its smallest hash: no such
span is missed. Fingerprints are joined; in the documents that share one, each
window around a shared gram is joined with the benchmark's by the hash of all
its words, and windows that overlap or touch make one span.

With k = 5 and W = 6 every shared span of ten words is found. An item of fewer
words than a span is one window of its own; for each such length that occurs
the documents keep the hashes of all their n-grams of that length.

All of it is DataFrame expressions, linear in the length of a text. Documents
with equal texts are matched once. Two windows are equal if a gram's and the
window's 64-bit hash both agree.

Defined cases
  null or empty text    no words and no hits
  null item id          its windows hit words, but it is not named among the items
  repeated rows, ties   judged alike
  very long text        matched whole; a million words take seconds
  empty tables          no rows, or no hits
  clashing columns      a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import NOT_ALNUM, ascii_lower, let, small, stored, text_key, words_of

K, SPAN = 5, 10
OUT = ["n_words", "n_hit", "spans", "items", "contaminated"]


def words(text: Column) -> Column:
    return words_of(ascii_lower(text), NOT_ALNUM)


def grams(h: Column, k: int) -> Column:
    """Hashes of all k-grams, given those of the words; none if there are fewer words."""
    whole = F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))
    return F.transform(whole, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(h, i + j) for j in range(1, k)]))


def picks(h: Column, k: int = K, span: int = SPAN) -> Column:
    """The smallest hash of each window of span - k + 1 k-grams."""
    w = span - k + 1

    def of(g: Column) -> Column:
        whole = F.slice(g, 1, F.greatest(F.size(g) - (w - 1), F.lit(0)))
        return F.transform(whole, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, w)]))

    return let(grams(h, k), of)


def fingerprints(h: Column, lengths: list[int], k: int = K, span: int = SPAN) -> Column:
    """Distinct hashes that a document is looked up by."""
    return F.array_distinct(F.concat(picks(h, k, span), *[grams(h, n) for n in lengths]))


def windows(h: Column, lengths: list[int], k: int = K, span: int = SPAN) -> Column:
    """array<struct<at, n, fp, whole>>: each window of a text, the hash that it keeps and that of its words."""

    def zipped(fps: Column, wholes: Column, n: int) -> Column:
        placed = F.transform(wholes, lambda x, i: F.struct(i.alias("at"), x.alias("whole")))
        return F.zip_with(fps, placed, lambda fp, w: F.struct(w["at"].alias("at"), F.lit(n).alias("n"), fp.alias("fp"), w["whole"].alias("whole")))

    def short(n: int) -> Column:
        return let(grams(h, n), lambda g: zipped(g, g, n))

    return F.concat(zipped(picks(h, k, span), grams(h, span), span), *map(short, lengths))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def reference_windows(benchmark: DataFrame, item: str, text: str, k: int, span: int) -> tuple[DataFrame, list[int]]:
    """(fp, n, whole, items): each window to look for; and the lengths of short items."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), word_hashes(F.col(text)).alias("h")).filter(F.size("h") > 0)
    short = [r[0] for r in items.filter(F.size("h") < span).select(F.size("h").alias("n")).distinct().orderBy("n").collect()]
    own = F.when(F.size("h") >= span, windows(F.col("h"), [], k, span))
    for n in short:
        own = own.when(F.size("h") == n, windows(F.col("h"), [n], k, span))
    each = items.select("item", F.explode(own).alias("w")).select("item", "w.fp", "w.n", "w.whole")
    return each.groupBy("fp", "n", "whole").agg(F.array_sort(F.collect_set("item")).alias("items")), short


def merged(spans: DataFrame) -> DataFrame:
    """(_of, _spans): the spans (_key, start, end) of each text sorted, those that overlap or touch made one."""
    order = Window.partitionBy("_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("_key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy(F.col("_key").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", k: int = K, span: int = SPAN
) -> DataFrame:
    """docs with n_words, n_hit, spans (array<struct<start,end>> of hit words, end exclusive), items and contaminated."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in OUT])
    looked_for, short = reference_windows(benchmark, item, item_text, k, span)
    looked_for = stored(looked_for, "windows")
    wanted = small(stored(looked_for.select("fp").distinct(), "wanted"))

    keyed = docs.withColumn("_key", text_key(F.col(text)))
    prints = keyed.select("_key", F.explode(let(word_hashes(F.col(text)), lambda h: fingerprints(h, short, k, span))).alias("fp"))
    hits = prints.join(wanted, "fp", "left_semi").select(F.col("_key").alias("_hit")).distinct()
    hits = small(stored(hits, "hits"))

    near = keyed.select("_key", F.col(text).alias("t")).join(hits, F.col("_key") == F.col("_hit"), "left_semi")
    near = near.groupBy("_key").agg(F.first("t").alias("t"))  # a text once
    at = near.select("_key", F.explode(let(word_hashes(F.col("t")), lambda h: windows(h, short, k, span))).alias("w")).select("_key", "w.*")
    met = stored(at.join(small(looked_for), ["fp", "n", "whole"]).select("_key", "at", "n", "items"), "met")
    spans = merged(met.select("_key", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end")))
    named = met.select("_key", "items").distinct().select("_key", F.explode_outer("items").alias("item")).groupBy("_key").agg(F.array_sort(F.collect_set("item")).alias("_items"))
    found = stored(spans.join(named, F.col("_of") == F.col("_key")).drop("_key"), "spans")

    judged = keyed.withColumn("n_words", F.size(words(F.col(text))).cast("long")).join(small(found), F.col("_key") == F.col("_of"), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return judged.withColumns(
        {
            "spans": F.coalesce("_spans", none),
            "items": F.coalesce("_items", F.array().cast("array<string>")),
            "n_hit": F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"])), F.lit(0).cast("long")),
            "contaminated": F.col("_spans").isNotNull(),
        }
    ).drop("_key", "_of", "_spans", "_items")


def digest(judged: DataFrame, *keep: str) -> DataFrame:
    """The contract's columns, from the operator's."""
    return judged.select(
        *keep, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )

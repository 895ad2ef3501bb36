"""Quality rules by the frequency of lines across documents.

Lines are normalised and hashed, and for each host the distinct documents that
hold a line are counted. Lines above the limit are boilerplate and are removed;
a document that loses most of its words so is depleted and rejected, as is one
that fails the base rules.

Copies must not turn a text into boilerplate, else all copies of a clean
document would go. So equal texts of a host count as one document, for a line as
for its host. Texts that differ at all are different documents: by their lines,
near copies can't be told from pages that are mostly menu.

Defined cases
  null or empty text   no words; the base rules reject it
  null host            a host of its own
  very long text       judged whole; its windows are sorted, and each of its lines is looked for by binary search
  repeated rows, ties  judged alike; they count as one document
  empty table          empty result
  clashing columns     a column of the input with the name of an output column is replaced; all others stay
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import SPACES, all_columns, let, own_columns, small, stored, text_key, words_of

#: Lines that one document's list can hold, as a power of two; shorter lists than this are read through.
SEARCH_BITS, SHORT = 24, 16
OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_words_removed", "clean_text", "kept"]


def repeat_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more in the text."""

    def of_windows(windows: Column) -> Column:
        def covered(pairs: Column) -> Column:
            twice = F.filter(pairs, lambda e, j: (F.get(pairs, j - 1)["w"] == e["w"]) | (F.get(pairs, j + 1)["w"] == e["w"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        marked = let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), covered)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(marked)

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return let(windows, of_windows)

    return F.coalesce(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes), F.lit(0)).cast("long")


def lines_of(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))


def line_hash(line: Column) -> Column:
    """Hash of a line without case, digits and outer or repeated spaces."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"[0-9]+", "0"), SPACES, " "))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn(
        "_base",
        let(
            words_of(t, SPACES),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).alias("n_repeat_words")
            ),
        ),
    )
    n, again = F.col("_base.n_words"), F.col("_base.n_repeat_words")
    dup_lines = let(lines_of(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return counted.withColumns(
        {
            "n_words": n,
            "word_chars": F.col("_base.word_chars"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": dup_lines.cast("long"),
            "n_repeat_words": again,
            "base_failed": (n < 50) | (100 * again > 50 * n),
        }
    ).drop("_base")


def line_sets(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(_host, _key, _lines) of the distinct documents of each host that hold a line."""
    hashed = docs.select(F.col(host).cast("string").alias("_host"), text_key(F.col(text)).alias("_key"), F.array_distinct(F.transform(lines_of(F.col(text)), line_hash)).alias("_lines"))
    return hashed.filter(F.size("_lines") > 0).groupBy("_host", "_key").agg(F.first("_lines").alias("_lines"))


def frequent_lines(distinct: DataFrame, max_share: float, min_docs: int) -> DataFrame:
    """(_host, _line) of the lines on more than min_docs and more than max_share of their host's distinct documents."""
    per_line = distinct.select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").count().filter(F.col("count") > min_docs)
    per_host = distinct.groupBy(F.col("_host").alias("_of")).agg(F.count("*").alias("docs"))
    return per_line.join(per_host, F.col("_host").eqNullSafe(F.col("_of"))).filter(F.col("count") > max_share * F.col("docs")).select("_host", "_line")


def held_lines(distinct: DataFrame, often: DataFrame) -> DataFrame:
    """(_of, _key, _gone): for each distinct document the frequent lines of its host that it holds, sorted.

    A document's list is no longer than the document; a host's lines are never gathered.
    """
    each = distinct.select(F.col("_host").alias("_of"), "_key", F.explode("_lines").alias("_l"))
    met = each.join(often, F.col("_of").eqNullSafe(F.col("_host")) & (F.col("_l") == F.col("_line")))
    return met.groupBy("_of", "_key").agg(F.sort_array(F.collect_set("_l")).alias("_gone"))


def among(sorted_: Column, x: Column) -> Column:
    """Whether the sorted array holds x: by binary search, as an array's own search would make long texts quadratic."""
    place = lambda at, step: F.when(F.coalesce(F.get(sorted_, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at)
    steps = F.array(*[F.lit(1 << k) for k in range(SEARCH_BITS - 1, -1, -1)])
    found = F.get(sorted_, F.aggregate(steps, F.lit(0), place) - 1)
    return F.when(F.size(sorted_) <= SHORT, F.array_contains(sorted_, x)).otherwise(F.coalesce(found == x, F.lit(False)))


def line_frequency_rules(
    docs: DataFrame, text: str = "text", host: str = "source", max_share: float = 0.05, min_docs: int = 20, min_left: float = 0.5
) -> DataFrame:
    """docs with the columns OUT.

    max_share, min_docs: a line on more of its host's documents than both is removed.
    min_left: a document that keeps a smaller share of its words is depleted.
    """
    rest = [c for c in docs.columns if c.lower() not in OUT]
    distinct = stored(line_sets(docs, text, host), "line-sets")
    often = small(stored(frequent_lines(distinct, max_share, min_docs), "lines"))
    gone = small(stored(held_lines(distinct, often), "held-lines"))
    packed = own_columns(docs.select(*[F.col(f"`{c}`") for c in rest]), *dict.fromkeys((text, host)))  # one column may be both
    judged = base_rules(packed, text).withColumns({"_h": F.col(host).cast("string"), "_k": text_key(F.col(text))})
    judged = judged.join(gone, judged["_h"].eqNullSafe(gone["_of"]) & (judged["_k"] == gone["_key"]), "left")
    left = F.filter(F.split(F.col(text), "\n"), lambda x: ~x.rlike(r"\S") | ~let(line_hash(x), lambda h: among(F.col("_gone"), h)))
    judged = judged.withColumn("_clean", F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    removed = F.when(F.col("_gone").isNotNull(), F.col("n_words") - F.size(words_of(F.col("_clean"), SPACES))).otherwise(F.lit(0)).cast("long")
    judged = judged.withColumns({"n_words_removed": removed, "clean_text": F.col("_clean")})
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_words_removed") >= min_left * F.col("n_words")))
    return judged.select(*all_columns(rest, text, host), *OUT)

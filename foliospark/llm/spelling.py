"""Spelling variants: words one edit apart, by an index of variable-length grams.

1. One pass counts the words of all texts; each task sums before Spark shuffles.
2. The gram dictionary grows level by level: a gram that more than EXTEND words hold is extended by a character, one that
   fewer hold is selective enough and its extensions are pruned. It is closed under prefixes and bounded by MOST grams;
   every choice of dictionary gives the same links.
3. A word is decomposed into the longest dictionary grams at each place (pairs of characters where there is none), but for
   those within a gram before. An edit at one place can change only grams that hold the place, that could grow over it,
   or that a grown gram could swallow: the largest number of these over all places is the word's bound.
4. Two words one edit apart share all other grams, so the rarest ones up to the bound, and one more, hold a common one:
   only those lists are merged, by a join on gram, lengths and place (an unchanged gram stands at the same place, or one
   further in the longer word). Pairs that a join makes are verified: a mask of characters, then the edit distance.

Grams are at most half as long as the shorter word of a pair, so that an edit never reaches all of a word's grams and the
bound always leaves a common one: no link is lost, and no word needs another way. A word of even length is therefore
decomposed twice, for partners of its own length and for shorter ones.

Defined cases
  null text                 no words
  null doc_id               an empty id in what is hashed
  repeated rows             counted each
  ties of the largest n     the smallest word in code-point order
  very long text            held by one task; its counts are summed there
  very long word            decomposed in one task, in time proportional to its length
  empty table               empty result
  extra columns             left out, whatever their names
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import settled, stored

#: Letters of lower-cased texts; least code points and occurrences of a word; times that a form is more frequent.
RUN, LEAST, OFTEN, TIMES = re.compile("[a-zÀ-ÿ]+"), 6, 5, 5
#: Longest gram; grams in more words than this are extended; grams of a dictionary at most; words that a task sums up before it passes them on.
LONGEST, EXTEND, MOST, SUMMED = 6, 200, 200_000, 500_000


def damaged(run: str, crc: int, one_in: int) -> str:
    """The run, or what is left of one that the hash chooses: typing errors are planted; crc: of the id and a colon."""
    h = zlib.crc32(run.encode(), crc)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least: int = LEAST, often: int = OFTEN, damage: int | None = None) -> DataFrame:
    """(word, n) of the words of (doc_id, text) with at least `least` code points and `often` occurrences.

    damage: of the words of a document, one in so many loses a letter first, as the id and the word decide.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if text:
                    crc = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: A-Z only
                        word = damaged(run, crc, damage) if damage else run
                        if len(word) >= least:
                            total[word] = total.get(word, 0) + n
                if len(total) >= SUMMED:
                    yield passed()
        yield passed()

    counted = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def grow(words: DataFrame, longest: int = LONGEST, extend: int = EXTEND, most: int = MOST) -> dict[str, int]:
    """Grams with the places that hold them: all pairs of characters, and extensions of the frequent ones; at most `most` by level."""

    def level(size: int, parents: set[str]) -> list[tuple[str, int]]:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for batch in batches:
                for word in batch["word"].to_pylist():
                    for i in range(len(word) - size + 1):
                        if size == 2 or word[i : i + size - 1] in parents:
                            total[word[i : i + size]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

        sums = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        return [tuple(r) for r in sums.orderBy(F.desc("n"), "gram").limit(most).collect()]

    out: dict[str, int] = {}
    parents: set[str] = set()
    for size in range(2, longest + 1):
        found = level(size, parents)
        out.update(found)
        parents = {g for g, n in found if n > extend}
        if not parents:
            break
    return out


class Decomposer:
    """Variable-length grams of words, none longer than `longest`, and how many of them one edit can change."""

    def __init__(self, counts: dict[str, int], longest: int) -> None:
        self.longest, self.counts = longest, counts
        self.whole = {g for g in counts if 2 < len(g) <= longest}
        self.heads = {g[:k] for g in self.whole for k in range(1, len(g))}
        self.tails = {g[k:] for g in self.whole for k in range(1, len(g))}

    def spans(self, word: str) -> list[tuple[int, int]]:
        """Start and end of the grams."""
        out, reach, n = [], 0, len(word)
        for a in range(n - 1):
            size = next((k for k in range(min(self.longest, n - a), 2, -1) if word[a : a + k] in self.whole), 2)
            if a + size > reach:
                reach = a + size
                out.append((a, reach))
        return out

    def affected(self, word: str, spans: list[tuple[int, int]]) -> int:
        """The most grams that one insertion, deletion or replacement changes."""
        n, most = len(word), 0
        for i in range(n + 1):
            low = next((p for p in range(max(0, i - self.longest + 1), i) if word[p:i] in self.heads), i)
            for gap in (0, 1):  # a character comes in before i; or that at i goes or is replaced
                if i + gap > n:
                    continue
                high = next((e for e in range(min(n, i + gap + self.longest - 1), i + gap, -1) if word[i + gap : e] in self.tails), i + gap)
                held = sum((a < i + gap and b > i) or (a >= low and b <= i) or (a >= i + gap and b <= high) for a, b in spans)
                most = max(most, held)
        return most

    def rarest(self, word: str) -> list[tuple[str, int]]:
        """(gram, place) of the rarest grams: as many as an edit can change, and one more."""
        spans = self.spans(word)
        least = self.affected(word, spans) + 1
        return [(g, a) for _, g, a in sorted((self.counts.get(word[a:b], 0), word[a:b], a) for a, b in spans)[:least]]


def entries(words: DataFrame, counts: dict[str, int], longest: int = LONGEST) -> DataFrame:
    """(key, word, n, mask, asks, lists): places of words in lists that they look through (asks) and stand in (lists)."""
    shared = words.sparkSession.sparkContext.broadcast(counts)
    names = ["key", "word", "n", "mask", "asks", "lists"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, Decomposer] = {}

        def rarest(word: str, shorter: int) -> list[tuple[str, int]]:
            size = min(shorter // 2, longest)
            if size not in by:
                by[size] = Decomposer(shared.value, size)
            return by[size].rarest(word)

        def key(short: int, long: int, gram: str, at: int) -> int:
            return xxhash.xxh64_intdigest(f"{short} {long} {at} {gram}") - 2**63

        for batch in batches:
            out: list[tuple] = []
            for word, count in zip(batch["word"].to_pylist(), batch["n"].to_pylist(), strict=True):
                n = len(word)
                mask = 0
                for c in set(word):
                    mask |= 1 << ord(c) % 63
                for gram, at in rarest(word, n):
                    out.append((key(n, n, gram, at), word, count, mask, True, True))
                    out += [(key(n, n + 1, gram, at + shift), word, count, mask, True, False) for shift in (0, 1)]
                out += [(key(n - 1, n, gram, at), word, count, mask, False, True) for gram, at in rarest(word, n - 1)]
            for a in range(0, max(1, len(out)), 50_000):
                columns = list(zip(*out[a : a + 50_000], strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return words.select("word", "n").mapInArrow(place, "key long, word string, n long, mask long, asks boolean, lists boolean")


def near_words(words: DataFrame, longest: int = LONGEST, extend: int = EXTEND, most: int = MOST) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of (word, n) that differ by one inserted, deleted or replaced code point, each once."""
    placed = stored(entries(words, grow(words, longest, extend, most), longest), "places")
    a = placed.filter("asks").select("key", *[F.col(c).alias(f"{c}_a") for c in ("word", "n", "mask")])
    b = placed.filter("lists").select("key", *[F.col(c).alias(f"{c}_b") for c in ("word", "n", "mask")])
    # the bound of the merged lists is 1: the shorter word asks, of two equally long ones the smaller
    ordered = (F.length("word_a") < F.length("word_b")) | (F.col("word_a") < F.col("word_b"))
    alike = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2
    met = a.join(b, "key").filter(alike & ordered).filter(F.levenshtein("word_a", "word_b", 1) == 1)
    return met.select(F.col("word_a").alias("a"), F.col("n_a"), F.col("word_b").alias("b"), F.col("n_b")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form); chains are halved in each round."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return at


def group(docs: DataFrame, longest: int, extend: int, most: int, damage: int | None) -> DataFrame:
    words = stored(count_words(docs, damage=damage), "words")
    pairs = stored(near_words(words, longest, extend, most), "near")
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = F.min(F.struct((-F.col("m")).alias("m"), "other"))
    near = ways.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left")
    larger = -F.col("best.m") >= TIMES * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(larger, F.col("best.other")).alias("form"), F.when(larger, -F.col("best.m")).alias("form_n")), "judged")
    roots = last_forms(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, longest: int = LONGEST, extend: int = EXTEND, most: int = MOST, damage: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of (doc_id, text); damage: as count_words has it.

    form: the near word of the largest n, where that is five times the word's own or more; root: the end of the chain of
    forms, the word itself if it has none.
    """
    return settled(lambda: group(docs, longest, extend, most, damage), "variants")

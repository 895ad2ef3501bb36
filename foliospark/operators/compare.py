"""Comparison of document revisions, page by page and word by word.

All pairs of documents are aligned at once, by windows over the digests of their
pages: a page that both revisions hold once, and that no pair of equal pages
crosses, belongs to every longest common subsequence, so the pages between two
such anchors form a gap of their own. Gaps that one side leaves empty need no
more. For the others a set-similarity join lists the pages that share half of
their words. Only where that leaves a choice, one task gets the numbers of a
gap's pages and that list, never their words. Only pairs of changed pages have their words compared, by a
shortest edit script.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import pairwise
from math import isqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.storage import discard, stored

#: Longest edit script, and steps, beyond which two pages are simply different.
MOST_EDITS, BUDGET = 1000, 20_000_000
#: Bytes of a table of subsequences, and of the masks of its words, that are held at most.
TABLE_BYTES = 64 * 1024 * 1024
#: Least similarity of two changed pages that count as revisions of one; the digest of a page without words.
ALIKE, EMPTY = 0.5, sha256(b"").hexdigest()
#: Between the words of a page that are kept as one text.
MARK = "\x01"
#: What a product of a count and a share may be off by.
TINY = 1e-9
Op = tuple[str, int, int, int, int]


class TooDifferent(Exception):
    """The edit script is longer than the budget allows."""


def edit_script(a: list, b: list, most: int | None = MOST_EDITS) -> list[Op]:
    """(kind, a_start, a_end, b_start, b_end) of a shortest script by greedy furthest-reaching paths.

    Of two paths that reach equally far the deletion is taken, so results are
    the same on every run. Where the steps can't exceed the budget the same script is read off the rows of the
    subsequences' table, a row being the bits of one integer; only longer pages are walked path by path. most None: the
    script of any two pages, however long it is, off the table.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return [("delete", 0, n, 0, 0)] if n else [("insert", 0, 0, 0, m)] if m else []
    within = most is None or (most + 1) * (most + 2) // 2 + (2 * most + 1) * min(n, m) <= BUDGET
    return joined_moves(moves_by_rows(a, b, most) if within else moves_by_paths(a, b, most))


def joined_moves(moves: list[Op]) -> list[Op]:
    """Moves from the last to the first, as a script from the first to the last; neighbours of a kind are one."""
    out: list[Op] = []
    for kind, a0, a1, b0, b1 in reversed(moves):
        if out and out[-1][0] == kind and out[-1][2] == a0 and out[-1][4] == b0:
            out[-1] = (kind, out[-1][1], a1, out[-1][3], b1)
        else:
            out.append((kind, a0, a1, b0, b1))
    return out


def moves_by_rows(a: list, b: list, most: int | None) -> list[Op]:
    """The moves of moves_by_paths, from the table of longest common subsequences.

    The zeros among the first y bits of row x count the longest subsequence of a[:x] and b[:y]; each row follows from the
    one before by one addition. On a diagonal the furthest point of d - 1 edits is the furthest of at most so many. Of a
    table that TABLE_BYTES don't hold, the first row of each block is kept, and the walk back makes a block's rows anew.
    """
    n, m, same = len(a), len(b), 0
    if most is not None and abs(n - m) > most:
        raise TooDifferent
    while same < n and same < m and a[same] == b[same]:
        same += 1
    a, b, n, m = a[same:], b[same:], n - same, m - same
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    masks, full = {}, (1 << m) - 1

    def rows_of(first: int, row: int) -> Iterator[int]:
        """The rows behind row number first, to the end of its block."""
        for x in a[first : first + step]:
            if x in places:
                if (met := masks.get(x)) is None:
                    met = bits(places[x])
                    if len(masks) * m <= 8 * TABLE_BYTES:
                        masks[x] = met
                met &= row
                row = (row + met | row - met) & full
            yield row

    step = max(n, 1) if n * m <= 8 * TABLE_BYTES else isqrt(n) + 1
    heads, rows, row = [], [], full
    for first in range(0, n, step):
        heads.append(row)
        if step >= n:
            rows = [row, *rows_of(0, row)]
            row = rows[-1]
        else:
            for row in rows_of(first, row):  # noqa: B007
                pass
    d, i, j, first = n - m + 2 * row.bit_count(), n, m, 0 if step >= n else n
    if most is not None and d > most:
        raise TooDifferent
    moves: list[Op] = []
    while d:
        # back along the diagonal to where its last move came in: at one point an insertion reaches further in a, so it wins
        x, y = i, j
        while True:
            if x <= first and x:
                first = (x - 1) // step * step
                rows = [heads[first // step], *rows_of(first, heads[first // step])]
            if y and (not x or rows[x - first] >> y - 1 & 1):
                px, py, kind = x, y - 1, "insert"
                break
            if x and (not y or not rows[x - 1 - first] >> y - 1 & 1):
                px, py, kind = x - 1, y, "delete"
                break
            x, y = x - 1, y - 1
        if x < i:
            moves.append(("equal", x, i, y, j))
        moves.append((kind, px, x, py, y))
        i, j, d = px, py, d - 1
    moves = [(kind, a0 + same, a1 + same, b0 + same, b1 + same) for kind, a0, a1, b0, b1 in moves]
    if same + i:
        moves.append(("equal", 0, same + i, 0, same + j))
    return moves


def bits(places: list[int]) -> int:
    """An integer with the bits at these places, the last of which is the greatest."""
    held = bytearray(places[-1] // 8 + 1)
    for j in places:
        held[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(held, "little")


def moves_by_paths(a: list, b: list, most: int) -> list[Op]:
    """Moves from the last to the first, by the furthest points that so many edits reach on each diagonal."""
    n, m, steps = len(a), len(b), 0
    off = m + 1  # diagonals from -m to n
    reach = [-1] * (n + m + 3)
    reach[1 + off] = 0
    history: list[tuple[int, list[int]]] = []
    for d in range(n + m + 1):
        if d > most:
            raise TooDifferent
        low, high = max(-d, -m), min(d, n)
        history.append((low - 1, reach[low - 1 + off : high + 2 + off]))
        for k in range(low + (low + d) % 2, high + 1, 2):
            below, above = reach[k - 1 + off], reach[k + 1 + off]
            i = above if k == -d or (k != d and below < above) else below + 1
            start, j = i, i - k
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            reach[k + off] = i
            steps += i - start + 1
        if steps > BUDGET:
            raise TooDifferent
        if reach[n - m + off] >= n:
            break
    moves: list[Op] = []
    i, j = n, m
    for d in range(len(history) - 1, 0, -1):
        (first, before), k = history[d], i - j
        at = lambda diagonal: before[diagonal - first] if 0 <= diagonal - first < len(before) else -1  # noqa: B023, E731
        down = k == -d or (k != d and at(k - 1) < at(k + 1))
        pi = at(k + 1 if down else k - 1)
        pj = pi - (k + 1 if down else k - 1)
        si, sj = (pi, pj + 1) if down else (pi + 1, pj)
        if i > si:
            moves.append(("equal", si, i, sj, j))
        moves.append(("insert", pi, pi, pj, sj) if down else ("delete", pi, si, pj, pj))
        i, j = pi, pj
    if i:
        moves.append(("equal", 0, i, 0, j))
    return moves


def without_reflow(ops: list[Op], a: list[str], b: list[str]) -> list[Op]:
    """ops without neighbouring deletions and insertions of the same letters: text that was only wrapped anew."""
    letters = lambda words: "".join("".join(words).split())
    out, at = [], 0
    while at < len(ops):
        two = ops[at : at + 2]
        if len(two) == 2 and {two[0][0], two[1][0]} == {"delete", "insert"}:
            gone, new = sorted(two)
            if letters(a[gone[1] : gone[2]]) == letters(b[new[3] : new[4]]):
                at += 2
                continue
        out.append(ops[at])
        at += 1
    return out


def similarity(a: list[str], b: list[str]) -> float:
    """Distinct shared words over the words of the longer page; 1 for two empty pages."""
    most = max(len(a), len(b))
    return len(set(a) & set(b)) / most if most else 1.0


def common_places(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: by a shortest edit script, or from all equal pairs where that is too long.

    What only one side holds can't be part of it. The pairs are taken in the order of a, those of one element from the
    last in b; the longest rising run of places in b is then found by binary search.
    """
    try:
        return [(a0 + k, b0 + k) for kind, a0, a1, b0, _ in edit_script(a, b) if kind == "equal" for k in range(a1 - a0)]
    except TooDifferent:
        at: dict = {}
        for j, x in enumerate(b):
            at.setdefault(x, []).append(j)
        ends: list[int] = []  # the least last place of a run of each length, and that run's chain
        chains: list[tuple] = []
        for i, x in enumerate(a):
            for j in reversed(at.get(x, ())):
                k = bisect_left(ends, j)
                chain = (i, j, chains[k - 1] if k else None)
                ends[k : k + 1], chains[k : k + 1] = [j], [chain]
        out, chain = [], chains[-1] if chains else None
        while chain:
            out.append(chain[:2])
            chain = chain[2]
        return out[::-1]


def pair_gap(old: list[tuple[int, str]], new: list[tuple[int, str]], alike: list[tuple[int, int, float]]) -> list[tuple[int | None, int | None, bool]]:
    """(old place, new place, equal) of the pages of one gap, (place, digest) in order; alike: similar pairs of places.

    Pages in a longest common subsequence are equal. Between two of them each old page, in order, takes the most similar
    new one that is free, the first on ties; two pages without words are as similar as can be.
    """
    equal = common_places([d for _, d in old], [d for _, d in new])
    pairs = [(old[i][0], new[j][0], True) for i, j in equal]
    cuts = [(-1, -1), *equal, (len(old), len(new))]
    near: dict[int, list[tuple[float, int]]] = {}
    for i, j, sim in alike:
        near.setdefault(i, []).append((-sim, j))
    for (i0, j0), (i1, j1) in pairwise(cuts):
        free = dict(new[j0 + 1 : j1])
        for place, digest in old[i0 + 1 : i1]:
            if digest == EMPTY:
                best = next((j for j, d in free.items() if d == EMPTY), None)
            else:
                best = min((x for x in near.get(place, ()) if x[1] in free), default=(0, None))[1]
            free.pop(best, None)
            pairs.append((place, best, False))
        pairs += [(None, j, False) for j in free]
    return pairs


def dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df in `parts` partitions by the columns that it is joined on, so that a join moves it once and a task's share fits its memory; None: as Spark deals it."""
    return df.repartition(parts, *by) if parts else df


def placed_pages(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, side, page, place, digest, ...) of both revisions: anchors, and the gaps between them.

    paired: an anchor's partner; gap: anchors up to the page; open: whether the gap has pages of both sides, pairs: how
    many pairs these make, repeated: whether one of them has an equal page anywhere; met: whether the documents share a
    page at all. The rows are dealt by document once; all windows find theirs in place.
    """
    c, doc = F.col, Window.partitionBy("doc_id")
    side = lambda df, k: df.select("doc_id", F.lit(k).alias("side"), c("page").cast("int").alias("page"), F.sha2(F.array_join("words", " "), 256).alias("digest"))
    pages = side(old, 0).unionByName(side(new, 1))
    pages = pages.repartition(parts, "doc_id") if parts else pages.repartition("doc_id")
    pages = pages.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "side").orderBy("page")))
    same = Window.partitionBy("doc_id", "digest")
    there = F.when(c("side") == 1, c("place"))
    pages = pages.withColumns({"n_old": F.count_if(c("side") == 0).over(same), "n_new": F.count(there).over(same), "low": F.min(there).over(same), "high": F.max(there).over(same)})
    pages = pages.withColumn("met", F.max((c("n_old") > 0) & (c("n_new") > 0)).over(doc))
    before = Window.partitionBy("doc_id", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id", "side").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumns({"reach": F.max("high").over(before), "ahead": F.min("low").over(after)})
    free = F.coalesce(c("reach") < c("low"), F.lit(True)) & F.coalesce(c("ahead") > c("low"), F.lit(True))
    pages = pages.withColumn("own", (c("side") == 0) & (c("n_old") == 1) & (c("n_new") == 1) & free)
    pages = pages.withColumn("anchor", F.max("own").over(same)).withColumn("paired", F.when(c("own"), c("low")))
    to_here = Window.partitionBy("doc_id", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("gap", F.sum(c("anchor").cast("int")).over(to_here))
    gap = Window.partitionBy("doc_id", "gap")
    loose = lambda k: F.count_if(~c("anchor") & (c("side") == k)).over(gap)
    pages = pages.withColumn("pairs", loose(0) * loose(1)).withColumn("open", (c("pairs") > 0) & ~c("anchor") & c("met"))
    pages = pages.withColumn("repeated", F.max(~c("anchor") & (c("n_old") > 0) & (c("n_new") > 0)).over(gap))
    pages = pages.withColumn("both", F.least(F.max(F.when(c("side") == 0, c("place"))).over(doc), F.max(there).over(doc)))
    return pages.select("doc_id", "side", "page", "place", "digest", "anchor", "paired", "gap", "open", "pairs", "repeated", "met", "both")


PAIR = "doc_id long, old_place int, new_place int, equal boolean, unaligned boolean"


#: Pages that are broadcast at most; pairs of pages of a gap that are compared directly.
BROADCAST_ROWS, FEW_PAIRS = 200_000, 16


def packed(words: Column) -> Column:
    """struct<text,list>: words as one text, which is shuffled and stored at half the size; the list itself where a word holds the mark, or none is there."""
    text = F.array_join(words, MARK)
    whole = F.size(F.split(text, MARK)) == F.size(words)
    return F.struct(F.when(whole, text).alias("text"), F.when(~whole, words).alias("list"))


def unpacked(words: Column) -> Column:
    """The words of packed."""
    return F.coalesce(F.split(words["text"], MARK), words["list"])


def changed_words(old: DataFrame, new: DataFrame, pages: DataFrame, wanted: Column, parts: int | None = None) -> DataFrame:
    """(doc_id, side, gap, place, open, pairs, words) of the wanted pages, their words packed.

    These pages are marked for broadcast where they were counted to be few; else Spark shuffles.
    """
    c, key = F.col, ["doc_id", "side", "page"]
    named = pages.filter(wanted).select("doc_id", "side", "page", "gap", "place", "open", "pairs")
    few = named.count() <= BROADCAST_ROWS
    sides = [df.select("doc_id", F.lit(k).alias("side"), c("page").cast("int").alias("page"), packed(c("words")).alias("words")) for k, df in enumerate((old, new))]
    both = sides[0].unionByName(sides[1])
    met = both.join(F.broadcast(named), key) if few else dealt(both, parts, *key).join(dealt(named, parts, *key), key)
    return met.select("doc_id", "side", "gap", "place", "open", "pairs", "words")


def align_pages(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """PAIR rows: each page of both revisions (doc_id, page, words) with its partner, if it has one.

    place: the page's number in its revision, from 1. Documents that share no page are paired by number; unaligned says
    that this was done for more than one pair. parts: into how many partitions pages are dealt, if that is given.
    """
    spark = old.sparkSession
    pages, placed = stored(placed_pages(old, new, parts), "pages")
    words, held = stored(changed_words(old, new, pages, F.col("open"), parts), "words")
    pairs, _ = stored(paired_pages(pages, words, parts), "pairs")
    discard(spark, placed, held)
    return pairs


def paired_pages(pages: DataFrame, words: DataFrame, parts: int | None = None) -> DataFrame:
    """align_pages from placed_pages and the words of open gaps."""
    c, none = F.col, F.lit(None).cast("int")
    anchors = pages.filter("paired is not null").select("doc_id", c("place").alias("old_place"), c("paired").alias("new_place"), F.lit(True).alias("equal"))
    lone = pages.filter(c("met") & ~c("anchor") & ~c("open"))
    lone = lone.select("doc_id", F.when(c("side") == 0, c("place")).alias("old_place"), F.when(c("side") == 1, c("place")).alias("new_place"), F.lit(False).alias("equal"))
    large, small = (words.filter(c("open") & x) for x in (c("pairs") > FEW_PAIRS, c("pairs") <= FEW_PAIRS))
    large = large.withColumn("words", unpacked(c("words")))
    found = similar_pages(large.filter("side = 0"), large.filter("side = 1"), ["doc_id", "gap"], "place", ALIKE).select("doc_id", "gap", "old_place", "new_place", "sim")
    side = lambda k, place, name: dealt(small.filter(c("side") == k).select("doc_id", "gap", c("place").alias(place), c("words").alias(name)), parts, "doc_id", "gap")
    direct = side(0, "old_place", "a").join(side(1, "new_place", "b"), ["doc_id", "gap"])
    direct = direct.withColumns({"a": unpacked(c("a")), "b": unpacked(c("b"))})
    direct = direct.select("doc_id", "gap", "old_place", "new_place", (F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size("a"), F.size("b"))).alias("sim")).filter(c("sim") >= ALIKE)
    alike = found.unionByName(direct)
    # in most gaps no page has two candidates and no digest comes twice: their pairs are known, and no task need hold the gap
    pages_of = lambda k: Window.partitionBy("doc_id", "gap", k)
    alike = alike.withColumn("twice", (F.count("*").over(pages_of("old_place")) > 1) | (F.count("*").over(pages_of("new_place")) > 1))
    crowded = alike.groupBy("doc_id", "gap").agg(F.max("twice").alias("twice"))
    opened = pages.filter("open").join(crowded, ["doc_id", "gap"], "left").withColumn("hard", c("repeated") | F.coalesce("twice", F.lit(False)))
    partner = alike.filter("not twice")
    partner = partner.select("doc_id", "gap", F.explode(F.array(F.struct(F.lit(0).alias("side"), c("old_place").alias("place"), c("new_place").alias("other")), F.struct(F.lit(1).alias("side"), c("new_place").alias("place"), c("old_place").alias("other")))).alias("p"))
    partner = partner.select("doc_id", "gap", "p.*")
    opened = opened.join(partner, ["doc_id", "gap", "side", "place"], "left")
    easy = opened.filter(~c("hard") & ((c("side") == 0) | c("other").isNull()))
    easy = easy.select("doc_id", F.when(c("side") == 0, c("place")).otherwise(c("other")).alias("old_place"), F.when(c("side") == 0, c("other")).otherwise(c("place")).alias("new_place"), F.lit(False).alias("equal"))
    nothing = F.lit(None).cast("double")
    members = opened.filter("hard").select("doc_id", "gap", "side", "place", "digest", none.alias("other"), nothing.alias("sim"))
    listed = alike.join(opened.filter("hard").select("doc_id", "gap").distinct(), ["doc_id", "gap"], "left_semi").select("doc_id", "gap", F.lit(2).alias("side"), c("old_place").alias("place"), F.lit(None).cast("string").alias("digest"), c("new_place").alias("other"), "sim")

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "place"])
        sides = [list(rows.loc[rows["side"] == k, ["place", "digest"]].itertuples(index=False, name=None)) for k in (0, 1)]
        near = rows.loc[rows["side"] == 2, ["place", "other", "sim"]]
        out = pd.DataFrame(pair_gap(*sides, [(i, int(j), s) for i, j, s in near.itertuples(index=False, name=None)]), columns=["old_place", "new_place", "equal"])
        return out.assign(doc_id=rows["doc_id"].iloc[0]).astype({"old_place": "Int32", "new_place": "Int32"})[["doc_id", "old_place", "new_place", "equal"]]

    filled = members.unionByName(listed).groupBy("doc_id", "gap").applyInPandas(pair, "doc_id long, old_place int, new_place int, equal boolean")
    numbered = pages.filter(~c("met")).groupBy("doc_id", "place").agg(F.max(c("side") == 0).alias("a"), F.max(c("side") == 1).alias("b"), F.max("both").alias("both"))
    numbered = numbered.select("doc_id", F.when(c("a"), c("place")).alias("old_place"), F.when(c("b"), c("place")).alias("new_place"), F.lit(False).alias("equal"), F.coalesce(c("both") > 1, F.lit(False)).alias("unaligned"))
    met = anchors.unionByName(lone).unionByName(easy).unionByName(filled).withColumn("unaligned", F.lit(False))
    return met.unionByName(numbered)


def compare_pages(a: list[str], b: list[str]) -> tuple[list[int], list[int], bool]:
    """Places of removed and inserted words, and whether the pages differ wholesale."""
    try:
        ops = without_reflow(edit_script(a, b), a, b)
    except TooDifferent:
        return [], [], True
    return [i for k, a0, a1, _, _ in ops if k == "delete" for i in range(a0, a1)], [j for k, _, _, b0, b1 in ops if k == "insert" for j in range(b0, b1)], False


def words_of_pairs(pairs: DataFrame, words: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, old_place, new_place, unaligned, a, b): pairs with the words of their pages, which are packed.

    Words are dealt by document, beside the places that pairs name; all that follows finds its rows in place, so that no words are shuffled twice.
    """
    c = F.col
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), c("old_place").alias("place")), F.struct(F.lit(1).alias("side"), c("new_place").alias("place"))))
    named = pairs.select("doc_id", ends.alias("e"), F.struct("old_place", "new_place", "unaligned").alias("pair")).select("doc_id", "e.*", "pair")
    rows = words.select("doc_id", "side", "place", "words").unionByName(named, allowMissingColumns=True)
    rows = rows.repartition(parts, "doc_id") if parts else rows.repartition("doc_id")
    rows = rows.withColumn("pair", F.max("pair").over(Window.partitionBy("doc_id", "side", "place"))).filter("pair is not null and words is not null")
    a, b = (F.min(F.when(c("side") == k, c("words"))) for k in (0, 1))
    met = rows.groupBy("doc_id", "pair").agg(a.alias("a"), b.alias("b"))
    return met.select("doc_id", "pair.*", unpacked(c("a")).alias("a"), unpacked(c("b")).alias("b"))


RESULT = "doc_id long, old_page int, new_page int, removed array<string>, inserted array<string>, n_removed int, n_inserted int, wholesale boolean, unaligned boolean"


def compare_documents(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """RESULT for each pair of pages of the documents of both sides: (doc_id, page, words).

    A page without a partner has nothing removed or inserted; equal pages aren't read again. Read again are pages in open
    gaps, and those of documents that share none. parts: into how many partitions pages are dealt, if that is given.
    """
    c, spark = F.col, old.sparkSession
    pages, placed = stored(placed_pages(old, new, parts), "pages")
    words, _ = stored(changed_words(old, new, pages, c("open") | ~c("met"), parts), "words")
    pairs, _ = stored(paired_pages(pages, words, parts), "pairs")
    discard(spark, placed)
    both = c("old_place").isNotNull() & c("new_place").isNotNull()
    changed = pairs.filter(~c("equal") & both)
    met = words_of_pairs(changed, words, parts)

    def run(batches):
        for rows in batches:
            out = []
            for doc, i, j, a, b, unaligned in rows[["doc_id", "old_place", "new_place", "a", "b", "unaligned"]].itertuples(index=False, name=None):
                a, b = list(a), list(b)
                gone, came, whole = compare_pages(a, b)
                out.append((doc, i, j, [a[k] for k in gone], [b[k] for k in came], len(gone), len(came), whole, unaligned))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULT.split(", ")])

    none = F.array().cast("array<string>")
    same = pairs.filter(c("equal") | ~both).select(
        "doc_id", c("old_place").alias("old_page"), c("new_place").alias("new_page"), none.alias("removed"), none.alias("inserted"), F.lit(0).alias("n_removed"), F.lit(0).alias("n_inserted"),
        F.lit(False).alias("wholesale"), "unaligned",
    )
    return met.select("doc_id", "old_place", "new_place", "a", "b", "unaligned").mapInPandas(run, RESULT).unionByName(same)


def compare_stats(pairs: DataFrame) -> DataFrame:
    """(doc_id, pages_changed, words_added, words_removed, pages_added, pages_removed)."""
    changed = (F.col("n_removed") > 0) | (F.col("n_inserted") > 0) | F.col("wholesale")
    return pairs.groupBy("doc_id").agg(
        F.count_if(changed).alias("pages_changed"), F.sum("n_inserted").alias("words_added"), F.sum("n_removed").alias("words_removed"),
        F.count_if(F.col("old_page").isNull()).alias("pages_added"), F.count_if(F.col("new_page").isNull()).alias("pages_removed"),
    )


def text_diff_clauses(pairs: DataFrame) -> DataFrame:
    """(pair_id, added, removed, wholesale) from (pair_id, a, b): changed runs of words joined to clauses."""

    def run(batches):
        for rows in batches:
            out = []
            for pair, a, b in rows[["pair_id", "a", "b"]].itertuples(index=False):
                x, y = (a or "").split(), (b or "").split()
                try:
                    ops = edit_script(x, y)
                    out.append((pair, [" ".join(y[o[3] : o[4]]) for o in ops if o[0] == "insert"], [" ".join(x[o[1] : o[2]]) for o in ops if o[0] == "delete"], False))
                except TooDifferent:
                    out.append((pair, [], [], True))
            yield pd.DataFrame(out, columns=["pair_id", "added", "removed", "wholesale"])

    return pairs.mapInPandas(run, "pair_id long, added array<string>, removed array<string>, wholesale boolean")


def similar_pages(old: DataFrame, new: DataFrame, group: list[str], page: str, least: float) -> DataFrame:
    """(group, old_<page>, new_<page>, shared, most, sim) of the pages of a group with a similarity of `least` or more.

    A similarity is the distinct words that two pages share over the words of the longer one. Pages that reach `least`
    share `least` of each one's words, so they share one of each one's rarest words, up to the number that may be missing:
    only those words are joined on, the rarest by how many pages of the group hold them. least 0: any shared word. Pages
    without words aren't listed.
    """
    c, names = F.col, (f"old_{page}", f"new_{page}")
    pages = [df.select(*group, c(page).alias("_page"), F.size("words").alias("_n"), F.array_distinct("words").alias("_set"), F.lit(k).alias("_side")) for k, df in enumerate((old, new))]
    both = pages[0].unionByName(pages[1])
    missing = F.size("_set") - F.greatest(F.lit(1), F.ceil(c("_n") * F.lit(least) - TINY)) + 1  # of so many words one is shared
    words = both.filter(missing > 0).select(*group, "_side", "_page", "_n", F.size("_set").alias("_d"), missing.alias("_take"), F.explode("_set").alias("_w"))
    held = words.withColumn("_f", F.count("*").over(Window.partitionBy(*group, "_w")))
    rank = F.row_number().over(Window.partitionBy(*group, "_side", "_page").orderBy("_f", "_w"))
    rare = held.withColumn("_k", rank).filter(c("_k") <= c("_take"))
    one = lambda k, x: rare.filter(c("_side") == k).select(*group, "_w", c("_page").alias(names[k]), c("_n").alias(f"_n{x}"), c("_d").alias(f"_d{x}"))
    can = (c("_da") >= least * c("_nb") - TINY) & (c("_db") >= least * c("_na") - TINY)
    met = one(0, "a").join(one(1, "b"), [*group, "_w"]).filter(can).select(*group, *names, F.greatest("_na", "_nb").alias("most")).distinct()
    sets = lambda k, x: pages[k].select(*group, c("_page").alias(names[k]), c("_set").alias(f"_set{x}"))
    whole = met.join(sets(0, "a"), [*group, names[0]]).join(sets(1, "b"), [*group, names[1]])
    counted = whole.select(*group, *names, F.size(F.array_intersect("_seta", "_setb")).cast("long").alias("shared"), "most").withColumn("sim", c("shared") / c("most"))
    return counted.filter((c("sim") >= least) & (c("shared") > 0))


def shared_words(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, old_page, new_page, shared, most, sim) of all pages of a document's revisions that share a word.

    Each page is shuffled once, whole, in `parts` partitions if given; its words never are, and no pair is.
    """
    c = F.col
    side = lambda df, k, x: df.select("doc_id", c("page").alias(f"{k}_page"), F.size("words").alias(f"_n{x}"), F.array_distinct("words").alias(f"_set{x}"))
    deal = lambda df: df.repartition(parts, "doc_id") if parts else df
    met = deal(side(old, "old", "a")).join(deal(side(new, "new", "b")), "doc_id")
    counted = met.select("doc_id", "old_page", "new_page", F.size(F.array_intersect("_seta", "_setb")).cast("long").alias("shared"), F.greatest("_na", "_nb").alias("most"))
    return counted.filter("shared > 0").withColumn("sim", c("shared") / c("most"))


def best_matches(old: DataFrame, new: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, old_page, new_page, sim): the most similar new page of each old page that shares a word, the first on ties."""
    best = F.max(F.struct("sim", (-F.col("new_page")).alias("p")))
    found = shared_words(old, new, parts).groupBy("doc_id", "old_page").agg(best.alias("b"))
    return found.select("doc_id", "old_page", (-F.col("b.p")).alias("new_page"), F.col("b.sim").alias("sim"))

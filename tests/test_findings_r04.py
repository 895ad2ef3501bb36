"""Cases of the findings of round 4."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.operators import compare as C
from foliospark.operators import layout as L
from foliospark.operators import redact as D
from foliospark.operators import regions as G
from foliospark.plans import catalog
from foliospark.plans import compare as R

SMALL = "/root/testdata/sf0.001"
ITEM = "doc_id long, page int, line_no int, off int, str string, x0 double, x1 double, baseline double, size double, rotated boolean, font_name string"


def over_batches(spark, df, sizes):
    """The rows of df, once for each number of rows that Python gets at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for n in sizes:
        spark.conf.set(key, n)
        try:
            yield sorted(map(str, df().collect()))
        finally:
            spark.conf.set(key, before)


def drawn_page(rng, n):
    """(baseline, x0, size) of items in columns, rows and blocks, uneven and in order."""
    rows = [(100.0 + 16 * r + 20 * (r // 4) + rng.choice([0.0, 0.9, -1.8, 4.0]), 48.0 + 5 * rng.randrange(100), rng.choice([10.0, 10.0, 12.0, 14.0])) for r in range(n // 12 + 1) for _ in range(12)]
    return sorted(rows[:n])


def plain_cut(x0, x1, b, s, at, body, depth=0):
    """The cut of a page with the rows of each part found anew."""
    if depth >= 6 or len(at) <= 1:
        return [at.tolist()]
    tall = L.extent(b[at], s[at])
    order = at[np.argsort(x0[at], kind="stable")]
    reach = np.concatenate([x0[order][:1], np.maximum.accumulate(x1[order])[:-1]])
    gaps = x0[order] - reach
    for k in [k for k in np.argsort(-gaps, kind="stable") if gaps[k] >= 18 and tall >= 3 * body]:
        sides = at[x1[at] <= reach[k] + 0.5], at[x0[at] >= x0[order][k] - 0.5]
        if all(L.extent(b[i], s[i]) >= 0.6 * tall for i in sides):
            return [p for i in sides for p in plain_cut(x0, x1, b, s, i, body, depth + 1)]
    rows = np.asarray(L.first_fit_rows(b[at].tolist(), s[at].tolist()))
    order = np.lexsort((x0[at], rows))
    means = L.row_means(rows[order].tolist(), b[at][order].tolist())
    heads = s[at][order][np.unique(rows[order], return_index=True)[1]]
    larger = np.maximum(heads[1:], heads[:-1])
    gap = np.diff(means) - larger
    wide = np.flatnonzero(gap >= 0.9 * larger)
    if not len(wide):
        return [at.tolist()]
    cut = wide[np.argmax(gap[wide])] + 1
    return [p for i in (at[rows < cut], at[rows >= cut]) for p in plain_cut(x0, x1, b, s, i, body, depth + 1)]


@pytest.mark.parametrize("name", ["f13_page_markdown", "l1_reading_order", "w10_detect_tables", "j8_dedupe_proposals"])
def test_no_page_is_a_frame(spark, name):
    """A task reads page after page as arrays; what a frame for each page costs is many times what its items do."""
    plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange") == 1


def test_pages_over_batches(spark):
    """Tables, markdown and regions of a page are the same over batches of any size."""
    rng, rows = random.Random(4), []
    for page in range(6):
        items = drawn_page(rng, [1, 30, 90, 24, 60, 12][page])
        items += [(400.0 + 16 * r, 48.0 + 130 * c, 10.0) for r in range(4 * (page % 2)) for c in range(3)]
        rows += [(1 + page // 4, page, k // 5, k % 5, f"t{k} ", x, x + 20.0, b, s, False, rng.choice(["Serif", "Serif-Bold", None])) for k, (b, x, s) in enumerate(items)]
    items = spark.createDataFrame(rows, ITEM)
    for work in (G.detect_tables, G.page_markdown, L.reading_order):
        want, *others = over_batches(spark, lambda: work(items), (10_000, 1, 7, 50))  # noqa: B023
        assert want and others == [want] * 3


def test_rows_and_cuts_of_sorted_items():
    """Rows of items in order of their baselines are those of the fold, and a cut that keeps the rows of the whole gives the regions of one that finds them anew."""
    rng = random.Random(6)
    for n in [1, 2, 5, 30, 100, 400] * 60:
        b, x0, s = np.array(drawn_page(rng, n)).T
        rows, part = L.rows_of_sorted(b, s)
        assert rows.tolist() == L.fold_rows(b.tolist(), np.maximum(2.0, 0.35 * s).tolist())
        assert len(part) == rows.max() + 1 and (np.diff(part) >= 0).all()
        x1 = x0 + rng.choice([5.0, 20.0, 60.0])
        assert [p.tolist() for p in L.region_places(x0, x1, b, s, np.arange(n), 10.0)] == plain_cut(x0, x1, b, s, np.arange(n), 10.0)


def plain_edges(rows, xs):
    """Item by item, to the first edge seen within three points."""
    edges = []
    for x in xs[np.lexsort((xs, rows))].tolist():
        for e in edges:
            if abs(e[0] - x) <= 3:
                e[1] += 1
                break
        else:
            edges.append([x, 1])
    return sorted(x for x, n in edges if n >= -(-len(set(rows.tolist())) // 2))


def test_shared_edges():
    """the edges that half of the rows share are those of a walk over all items."""
    rng = random.Random(8)
    for n in [1, 6, 40, 200] * 100:
        rows, step = np.sort(np.array([rng.randrange(8) for _ in range(n)])), rng.choice([0.5, 1.0, 3.0, 5.0])
        xs = np.array([48.0 + step * rng.randrange(40) for _ in range(n)])
        assert G.shared_edges(rows, xs, len(set(rows.tolist()))) == plain_edges(rows, xs)


def test_proposals_over_batches(spark):
    """the proposals that stay are the same over batches of any size, and are those of a walk over each page."""
    rng = random.Random(9)
    rows = [(d, p, m, rng.randrange(20) / 20, rng.randrange(9) / 9, rng.randrange(1, 12) / 20, 0.014) for d in (1, 2) for p in (1, 2, 3) for m in range(30)]
    want, kept = [], {}
    for r in rows:
        held = kept.setdefault(r[:2], [])
        x, y, w, h = r[3:]
        if not any(x >= a - 0.02 and y >= b - 0.02 and x + w <= a + c + 0.02 and y + h <= b + e + 0.02 for a, b, c, e in held):
            held.append(r[3:])
            want.append(r)
    marks = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, page int, mark_id int, nx double, ny double, nw double, nh double")
    assert sorted(map(tuple, D.dedupe_proposals(marks).collect())) == want
    first, *others = over_batches(spark, lambda: D.dedupe_proposals(marks), (10_000, 1, 7))
    assert others == [first] * 2


def test_any_two_pages_have_a_script(spark, tmp_path, monkeypatch):
    """pages of over 1,000 edits, or of any length, get their shortest script and no row that stands for it; a table in blocks gives the same moves."""
    old, new = ([f"{k}{i}" if i % 3 else f"c{i}" for i in range(1200)] for k in "ab")
    text = "\n".join([" ".join(old), *[""] * 7, " ".join(new)])
    pd.DataFrame({"doc_id": [1], "text": [text]}).to_parquet(tmp_path / "documents.parquet")
    rows = sorted(catalog.queries()["d1_lcs_diff"](spark, str(tmp_path)).drop("doc_id", "page").collect(), key=lambda r: (r.a_start, r.b_start, r.a_end, r.b_end))
    assert {r.kind for r in rows} == {"equal", "delete", "insert"}
    assert sum(r.a_end - r.a_start for r in rows if r.kind == "delete") == sum(r.b_end - r.b_start for r in rows if r.kind == "insert") == 800
    built = [w for r in rows for w in (old[r.a_start : r.a_end] if r.kind == "equal" else new[r.b_start : r.b_end] if r.kind == "insert" else [])]
    assert built == new
    rng = random.Random(7)
    for held in (1, 40, 2**20):
        monkeypatch.setattr(C, "TABLE_BYTES", held)
        for _ in range(500):
            a, b = ([rng.randrange(k) for _ in range(rng.randint(1, 60))] for k in (rng.choice([1, 2, 4, 20]),) * 2)
            assert C.moves_by_rows(a, b, None) == C.moves_by_paths(a, b, 10_000)


def test_packed_words(spark):
    """words are shuffled as one text and come back as they were, also those that hold the mark, are empty or null."""
    lists = [["a", "b c"], [], [""], ["", "x", ""], ["a\x01b", "c"], ["a", None], None, ["\x01"], ["|", "\\E", "é "]]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, w array<string>").withColumn("p", C.packed(F.col("w")))
    rows = df.withColumn("back", C.unpacked(F.col("p"))).orderBy("i").collect()
    assert [r.back for r in rows] == lists
    assert rows[0].p.list is None and rows[4].p.text is None


def test_revisions_in_parts(spark, monkeypatch):
    """dealt into any number of parts, and without a broadcast, revisions compare as before; words of pairs move once, into as many tasks as asked for."""
    rng = random.Random(3)
    text = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)]
    old = [(d, p, text(rng.randint(0, 12))) for d in range(12) for p in range(1, 1 + d % 7)]
    new = [(d, p + d % 2, [*w[:3], "new", *w[4:]] if rng.random() < 0.4 else w) for d, p, w in old if rng.random() < 0.8] + [(d, 9, text(5)) for d in range(0, 12, 3)]
    sides = [spark.createDataFrame(rows, "doc_id long, page int, words array<string>") for rows in (old, new)]
    want = sorted(map(str, C.compare_documents(*sides).collect()))
    aligned = sorted(map(str, C.align_pages(*sides).collect()))
    monkeypatch.setattr(C, "BROADCAST_ROWS", 0)
    assert sorted(map(str, C.compare_documents(*sides, 5).collect())) == want
    assert sorted(map(str, C.align_pages(*sides, 5).collect())) == aligned
    words = sides[0].select("doc_id", F.lit(0).alias("side"), F.col("page").alias("place"), C.packed(F.col("words")).alias("words"))
    pairs = sides[0].select("doc_id", F.col("page").alias("old_place"), F.col("page").alias("new_place"), F.lit(False).alias("unaligned"))
    met = C.words_of_pairs(pairs, words.union(words.withColumn("side", F.lit(1))), 5)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and met.rdd.getNumPartitions() == 5
    assert sorted((r.doc_id, r.old_place, r.a, r.b) for r in met.collect()) == sorted((d, p, w, w) for d, p, w in old)


def test_lone_pages_compare_no_words(spark):
    """pages without a partner follow from the alignment; the query reads its pairs only, and what led to them is deleted."""
    plan = catalog.queries()["u8_added_removed_pages"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Exchange" not in plan and plan.count("FileScan parquet") == 1


def test_last_pages_by_lines(spark, tmp_path):
    """the last page by a count of lines is the greatest page with words cut; nothing of an empty word is left."""
    texts = ["", " ", "a b", "\n" * 7, "\n" * 8, "a\n" * 30 + " b  c ", None]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    pages = R.page_words(spark, str(tmp_path))
    assert sorted(map(tuple, R.last_pages(spark, str(tmp_path)).collect())) == sorted(map(tuple, pages.groupBy("doc_id").agg(F.max("page")).collect()))
    assert [r.words for r in pages.filter("doc_id = 5").orderBy("page").collect()] == [["a"] * 8] * 3 + [["a"] * 6 + ["b", "c"]]
    same = [sorted(map(str, df.collect())) for df in (R.revised(pages), R.revised(pages, R.last_pages(spark, str(tmp_path))))]
    assert same[0] == same[1]

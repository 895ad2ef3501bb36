"""Cases of the findings of round 3."""

import os
import random
import time
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions.unicode import nfkc
from foliospark.operators import compare as C
from foliospark.operators import layout as L
from foliospark.operators import raster as R
from foliospark.operators import redact as D
from foliospark.operators import regions as G
from foliospark.operators.cells import safe_csv
from foliospark.plans import catalog
from foliospark.sources import bridge

SMALL = "/root/testdata/sf0.001"


def script(moves, *args):
    try:
        return moves(*args)
    except C.TooDifferent:
        return None


def test_edit_script_by_rows():
    """the table of subsequences gives the moves of the furthest paths, and pages without a common word cost no quadratic walk."""
    rng = random.Random(7)
    for _ in range(3000):
        a, b = ([rng.randrange(k) for _ in range(rng.randint(1, 14))] for k in (rng.choice([1, 2, 4, 20]),) * 2)
        most = rng.choice([3, 6, 1000])
        assert script(C.moves_by_rows, a, b, most) == script(C.moves_by_paths, a, b, most)
    start = time.process_time()
    for k in range(40):
        C.edit_script([f"a{k} {i}" for i in range(450)], [f"b{k} {i}" for i in range(450)])
    assert time.process_time() - start < 2  # 6 s and more by paths


def test_pages_are_dealt_by_size(spark, monkeypatch):
    """The items of a page are made in as many tasks as the documents' files ask for, not in what the few bytes shuffled would."""
    monkeypatch.setattr(bridge, "DEAL_BYTES", 4096)
    size = os.path.getsize(f"{SMALL}/documents.parquet")
    for items in (bridge.text_items, bridge.raw_items):
        assert items(spark, SMALL).rdd.getNumPartitions() == -(-size // 4096)


def test_a_task_gets_a_bounded_share(spark, tmp_path):
    """A task gets at most 1 MB of the files, and at most 4 million characters where the files hold the texts many times smaller."""
    rng = random.Random(5)
    for name, texts, bounds in (("plain", [rng.randbytes(500_000).hex() for _ in range(36)], lambda size, chars: -(-size // 2**20)), ("packed", ["the cat " * 500_000] * 20, lambda size, chars: -(-chars // 2**22))):
        docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "n_chars": [len(t) for t in texts]})
        (tmp_path / name).mkdir()
        docs.to_parquet(path := tmp_path / name / "documents.parquet")
        tasks = bridge.text_items(spark, str(tmp_path / name)).rdd.getNumPartitions()
        assert tasks == bounds(path.stat().st_size, docs["n_chars"].sum()) > 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["j22_replace_and_verify", "w3_split_runs", "a20_page_text"])
def test_a_query_keeps_the_deal(spark, monkeypatch, name):
    """The query's rows come from as many tasks as the documents are dealt to, and only the lines are shuffled."""
    monkeypatch.setattr(bridge, "DEAL_BYTES", 4096)
    df = catalog.queries()[name](spark, SMALL)
    assert plan_of(df).count("Exchange") == 1
    assert df.rdd.getNumPartitions() == -(-os.path.getsize(f"{SMALL}/documents.parquet") // 4096)


def test_numbers_in_runs(spark):
    """words and offsets are counted within their run, also where white space splits an item and another is blank."""
    rows = [(1, 1, 0, i, s, x, x + 5.0 * len(s), 100.0, 10.0, False) for i, (s, x) in enumerate([("a", 0.0), ("b c", 10.0), ("  ", 30.0), ("d", 41.0), ("e", 100.0), ("f", 105.0), ("g", 115.0)])]
    items = spark.createDataFrame(rows, "doc_id long, page int, line_no int, off int, str string, x0 double, x1 double, baseline double, size double, rotated boolean")
    assert sorted((r.run, r.word, r.text) for r in L.words_from_items(items).collect()) == [(0, 1, "a"), (0, 2, "b"), (0, 3, "cd"), (1, 1, "ef"), (1, 2, "g")]
    assert sorted((r.run, r.text, r.offsets) for r in L.run_texts(items).collect()) == [(0, "a b c  d", [0, 2, 5, 7]), (1, "ef g", [0, 1, 3])]


def test_minus_zero_is_no_formula(spark):
    """a balance of minus zero isn't below zero; texts and negative numbers are neutralised."""
    rows = spark.createDataFrame([("=a", -0.0), ("-b", -1.5), ("c", 0.0)], "name string, balance double")
    assert [r.line for r in safe_csv(rows, ["name", "balance"]).collect()] == ["'=a,-0.0", "'-b,'-1.5", "c,0.0"]


def test_nfkc_keeps_the_deal(spark):
    """the compatibility form is Unicode's, nulls and ASCII stay, and items aren't shuffled a second time for it."""
    texts = ["fi", "\ufb01x", "\uff11", "a\u0308", "\u212b", "\u1100\u1161", "\u0958", "\u00bd \ud55c", "e\u0323\u0302", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(nfkc(F.col("t"))).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    plan = L.scanned_lines(L.sanitise_items(L.scan_text_items(bridge.raw_items(spark, SMALL))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_all_pages_that_share_a_word(spark):
    """every pair with a shared word is listed, and only whole pages are shuffled."""
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, page int, words array<string>")
    old, new = df([(1, 1, ["a", "a", "b", "c"]), (1, 2, ["x"]), (2, 1, [])]), df([(1, 1, ["c", "d", "e", "f", "g"]), (1, 2, ["b", "a"]), (1, 3, ["q"]), (2, 1, [])])
    assert {(r.doc_id, r.old_page, r.new_page, r.shared, r.most) for r in C.shared_words(old, new, 3).collect()} == {(1, 1, 1, 1, 5), (1, 1, 2, 2, 4)}
    assert [tuple(r) for r in C.best_matches(old, new, 3).collect()] == [(1, 1, 2, 0.5)]
    assert C.best_matches(old, new, 3)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_regions_of_a_page():
    """Two columns are cut without a frame being grouped, and rows' means are the ones that pandas finds."""
    rng = random.Random(3)
    rows = [0, *sorted(rng.randrange(3) for _ in range(40)), 1, 2]
    values = [rng.random() * 10 ** rng.randint(-3, 9) for _ in rows]
    assert L.row_means(rows, values) == pd.Series(values).groupby(rows).mean().tolist()
    x0 = np.array([48.0, 300.0] * 6)
    y = np.repeat(np.arange(6) * 16.0, 2)
    places = list(L.region_places(x0, x0 + 100, y, np.full(12, 10.0), np.arange(12), 10.0))
    assert [p.tolist() for p in places] == [[0, 2, 4, 6, 8, 10], [1, 3, 5, 7, 9, 11]]


def read_in_batches(spark, n, work):
    """What work gives if Python gets n rows at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        return work()
    finally:
        spark.conf.set(key, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bands_over_batches(spark):
    """a page's bands are read one by one, whole ones over any batches, and no page is a frame of its own."""
    rows = [(d, p, "abc"[k % 3], x, x + 5.0, 100.0 + 9 * band + (k % 2), [10.0, 14.0][k % 2]) for d in (1, 2) for p in (1, 2, 3) for band in range(3) for k, x in enumerate((0.0, 10.0, 60.0, 62.0, 300.0))]
    items = spark.createDataFrame(rows, "doc_id long, page int, str string, x0 double, x1 double, baseline double, size double")
    df = G.group_runs_relative(items, 842.0)
    want = sorted(tuple(r) for r in df.collect())
    assert len(want) == 6 * 9 and [r[2] for r in want[:9]] == list(range(9)) and want[0][3:] == ("ab", 0.0, 15.0)
    for n in (1, 2, 7):
        assert sorted(tuple(r) for r in read_in_batches(spark, n, df.collect)) == want
    plan = plan_of(G.group_runs_relative(items, 842.0))
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange") == 1


def test_rows_over_batches(spark, monkeypatch):
    """pages and the chunks of large pages are folded over any batches; no page is a frame of its own."""
    draw = random.Random(5)
    pages = [[(draw.choice([0.0, 0.9, 1.8, 3.6]) + 7.5 * (k // 6), draw.choice([6.0, 10.0, 12.0])) for k in range(n)] for n in (1, 50, 3, 120)]
    rows = [(1, p, k // 7, k % 7, b, s) for p, page in enumerate(pages) for k, (b, s) in enumerate(page)]
    df = L.first_fit(spark.createDataFrame(rows, "doc_id long, page int, line_no int, off int, baseline double, size double"))
    want = [(p, r) for p, page in enumerate(pages) for r in L.fold_rows([b for b, _ in page], [max(2.0, 0.35 * s) for _, s in page])]
    for chunk, n in ((20_000, 7), (1, 1), (10, 4), (10, 1000)):
        monkeypatch.setattr(L.chunk_of, "__defaults__", (chunk,))
        assert [(r.page, r.row_no) for r in read_in_batches(spark, n, df.orderBy("page", "line_no", "off").collect)] == want
    plan = plan_of(L.first_fit(L.sanitise_items(L.scan_text_items(bridge.raw_items(spark, SMALL)))))
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange") == 1


def test_marks_over_batches(spark):
    """marks are joined one by one over any batches, and no page is a frame of its own."""
    draw = random.Random(2)
    rows = [(d, p, kind, draw.randrange(40) / 40, line / 10, draw.randrange(1, 6) / 40, 0.0137) for d in (1, 2) for p in (1, 2) for kind in ("del", "ins") for line in range(3) for _ in range(6)]
    marks = pd.DataFrame(rows, columns=["doc_id", "page", "kind", "nx", "ny", "nw", "nh"])
    df = D.coalesce_marks(spark.createDataFrame(marks, "doc_id long, page int, kind string, nx double, ny double, nw double, nh double"))
    want = []
    for key, group in marks.groupby(["doc_id", "page", "kind"]):
        out = []
        for nx, ny, nw, nh in group.sort_values(["ny", "nx", "nw"])[["nx", "ny", "nw", "nh"]].itertuples(index=False):
            if out and out[-1][1] == ny and nx <= out[-1][0] + out[-1][2] + 0.012:
                a = out[-1]
                out[-1] = [a[0], ny, max(a[0] + a[2], nx + nw) - a[0], max(a[1] + a[3], ny + nh) - ny]
            else:
                out.append([nx, ny, nw, nh])
        want += [(*key, *x) for x in out]
    for n in (1, 5, 10_000):
        assert sorted(tuple(r) for r in read_in_batches(spark, n, df.collect)) == sorted(want)
    assert "FlatMapGroupsInPandas" not in plan_of(df)


def test_filters_name_no_made_field(spark):
    """filters on raw items stay above what makes their fields, also where no text is read; rows without numbers go."""
    plan = plan_of(L.sanitise_items(L.scan_text_items(bridge.raw_items(spark, SMALL))).select("doc_id", "page", "x0"))
    assert not any("CASE WHEN" in x or "split(" in x for x in plan.splitlines() if " Filter " in x)
    rows = [(1.0, 2.0, 3.0, 10.0), (float("nan"), 2.0, 3.0, 10.0), (1.0, float("inf"), 3.0, 10.0), (1.0, 2.0, None, 10.0), (1.0, 2.0, 3.0, float("nan")), (1.0, 2.0, 3.0, 0.0), (-1e6, 2.0, 3.0, 1.0)]
    assert sorted(tuple(r) for r in L.sanitise_items(spark.createDataFrame(rows, "x0 double, x1 double, baseline double, size double")).collect()) == [(-1e6, 2.0, 3.0, 1.0), (1.0, 2.0, 3.0, 10.0)]


def test_pixels_are_compared_in_arrays(spark):
    """Ragged, null and missing lines and pixels of two rasters meet as before, and no lambda goes over pixels."""
    kind = "doc_id long, page int, rows array<array<int>>"
    a = spark.createDataFrame([(1, 1, [[0, 255, 10], None, [], [5], [7, None, 9]]), (1, 2, [[1]]), (1, 3, None), (2, 1, []), (3, 1, [[8, 9], [3]])], kind)
    b = spark.createDataFrame([(1, 1, [[8, 0, 19, 4], [1], [2], [], [7, 3, 200], [6]]), (1, 3, [[1]]), (2, 1, [[1]]), (3, 1, [[8]])], kind)
    want = {(1, 1): [[(0, 8, False), (255, 0, True), (10, 19, True)], None, [], [], [(7, 7, False), (None, 3, None), (9, 200, True)]], (1, 3): None, (2, 1): [], (3, 1): [[(8, 8, False)]]}
    got = {(r.doc_id, r.page): r.rows and [x and [tuple(p) for p in x] for x in r.rows] for r in R.visual_diff(a, b).collect()}
    assert got == want
    assert sorted(tuple(r) for r in R.line_changes(a, b).collect()) == [(1, 1, 0, 3, 2), (1, 1, 4, 3, 1), (3, 1, 0, 1, 0)]
    same = lambda df: df.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda v: (v - 128).cast("tinyint"))))
    assert sorted(tuple(r) for r in R.line_changes(same(a), same(b)).collect()) == sorted(tuple(r) for r in R.line_changes(a, b).collect())
    for name in ("a7_changed_ratio", "r2_change_regions", "l5_cap_regions", "j20_visual_diff_mask"):
        plan = plan_of(catalog.queries()[name](spark, SMALL))
        assert "aggregate(" not in plan and "zip_with(" not in plan and "ascii(" not in plan


def test_greys_beyond_a_byte_fail(spark):
    """F32: greys that no byte holds fail the query."""
    a = spark.createDataFrame([(1, 1, [[256]])], "doc_id long, page int, rows array<array<int>>")
    with pytest.raises(Exception, match="256|128|not in range|out of bounds"):
        R.visual_diff(a, a).collect()

"""Golden cases of the operators, on tiny inputs."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.functions import unicode as U
from foliospark.operators import compare as C
from foliospark.operators import jobs as J
from foliospark.operators import layout as L
from foliospark.operators import needles as N
from foliospark.operators import pages as P
from foliospark.operators import raster as R
from foliospark.operators import redact as D
from foliospark.operators import regions as G
from foliospark.plans import catalog, registry
from foliospark.sources import files as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edit_script_is_shortest_and_rebuilds():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        ops = C.edit_script(a, b)
        assert sum(o[2] - o[1] + o[4] - o[3] for o in ops if o[0] != "equal") == len(a) + len(b) - 2 * lcs(a, b)
        assert [w for k, a0, a1, b0, b1 in ops if k != "delete" for w in b[b0:b1]] == b
        assert [w for k, a0, a1, b0, b1 in ops if k != "insert" for w in a[a0:a1]] == a
        assert all(a[o[1] : o[2]] == b[o[3] : o[4]] for o in ops if o[0] == "equal")


def test_edit_script_budget():
    with pytest.raises(C.TooDifferent):
        C.edit_script([f"a{i}" for i in range(800)], [f"b{i}" for i in range(800)])


@pytest.mark.parametrize(
    ("a", "b", "removed", "inserted"),
    [
        ("pay $2,200 due now", "pay $2,400 due now", ["$2,200"], ["$2,400"]),
        ("one two three", "one two three", [], []),
        ("re- wrap ped line", "re-wrap ped line", [], []),
        ("", "a b", [], ["a", "b"]),
    ],
)
def test_compare_pages(a, b, removed, inserted):
    x, y = a.split(), b.split()
    gone, new, whole = C.compare_pages(x, y)
    assert [x[i] for i in gone] == removed and [y[j] for j in new] == inserted and not whole


def aligned(spark, old, new):
    """[(old place, new place)] by document, equal pairs and unaligned documents; revisions are lists of pages by document."""
    df = lambda docs: spark.createDataFrame([(d, 10 + 3 * i, w) for d, pages in docs.items() for i, w in enumerate(pages)], "doc_id long, page int, words array<string>")
    pairs, equal, unaligned = {}, {}, set()
    for r in C.align_pages(df(old), df(new)).collect():
        pairs.setdefault(r.doc_id, []).append((r.old_place and r.old_place - 1, r.new_place and r.new_place - 1))
        if r.equal:
            equal.setdefault(r.doc_id, []).append((r.old_place - 1, r.new_place - 1))
        if r.unaligned:
            unaligned.add(r.doc_id)
    return {d: sorted(p, key=str) for d, p in pairs.items()}, {d: sorted(p) for d, p in equal.items()}, unaligned


def test_page_pairs(spark):
    base = [f"w{i}" for i in range(10)]
    other, added = [f"x{i}" for i in range(10)], [f"y{i}" for i in range(10)]
    edited = [*base[:5], "changed", *base[6:]]
    got, _, unaligned = aligned(spark, {1: [base, other], 2: [base, other], 3: [base], 4: [base], 6: [[], base]}, {1: [edited, other, added], 2: [added, edited], 3: [added], 5: [base], 6: [base, []]})
    assert got == {1: [(0, 0), (1, 1), (None, 2)], 2: [(0, 0), (1, 1)], 3: [(0, 0)], 4: [(0, None)], 5: [(None, 0)], 6: got[6]} and unaligned == {2}
    assert got[6] in ([(0, 1), (1, None), (None, 0)], [(0, None), (1, 0), (None, 1)], [(0, 1), (1, 0)])
    assert C.similarity(["a", "a", "b"], ["a", "b", "c"]) == 2 / 3 and C.similarity([], []) == 1.0


def greedy(old, new, equal):
    """Pairs of pages by the rule spelled out: between equal pairs each old page takes the most similar free one."""
    out, cuts = list(equal), [(-1, -1), *equal, (len(old), len(new))]
    for (i0, j0), (i1, j1) in zip(cuts, cuts[1:]):
        free = list(range(j0 + 1, j1))
        for i in range(i0 + 1, i1):
            best = max(free, key=lambda j: (C.similarity(old[i], new[j]), -j), default=None)
            if best is not None and C.similarity(old[i], new[best]) >= 0.5:
                free.remove(best)
                out.append((i, best))
            else:
                out.append((i, None))
        out += [(None, j) for j in free]
    return sorted(out, key=str)


def test_alignment_against_plain_rules(spark):
    """Repeated, moved, blank, edited, added and removed pages: a longest common subsequence, and the greedy rule between."""
    rng = random.Random(8)
    old, new = {}, {}
    for d in range(60):
        page = lambda: [rng.choice("abcdefghijkl") + str(rng.randint(0, 3)) for _ in range(rng.choice([0, 1, 6, 6, 6]))]
        some = [page() for _ in range(6)]
        old[d] = [list(rng.choice(some)) if rng.random() < 0.5 else page() for _ in range(rng.randint(1, 14))]
        new[d] = [list(p) for p in old[d] if rng.random() < 0.8] + [page() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.5:
            rng.shuffle(new[d])
        for p in new[d]:
            if p and rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
    old, new = ({d: p for d, p in x.items() if p} for x in (old, new))
    got, equal, _ = aligned(spark, old, new)
    shared = [d for d in old if d in new and any(p in new[d] for p in old[d])]
    assert len(shared) > 40 and got.keys() == old.keys() | new.keys()
    for d in shared:
        a, b = ([" ".join(p) for p in x[d]] for x in (old, new))
        own = equal[d]
        assert len(own) == lcs(a, b) and all(a[i] == b[j] for i, j in own) and all(x < y and z < w for (x, z), (y, w) in zip(own, own[1:]))
        assert got[d] == greedy(old[d], new[d], own)


@pytest.mark.parametrize("n", [501, 5000])
def test_alignment_of_long_documents(spark, n):
    """Any number of changed pages: with an equal page among them, edited, reversed, and none equal at all."""
    pages = [[f"p{i}w{k}" for k in range(6)] for i in range(n)]
    fresh = [[f"q{i}w{k}" for k in range(6)] for i in range(n)]
    edited = [[*p[:5], "new"] for p in pages]
    middle = n // 2
    old = dict.fromkeys(range(4), pages)
    new = {0: fresh, 1: [*fresh[:middle], pages[middle], *fresh[middle + 1 :]], 2: [*edited[:middle], pages[middle], *edited[middle + 1 :]], 3: pages[::-1]}
    got, equal, unaligned = aligned(spark, old, new)
    assert unaligned == {0} and equal == {1: [(middle, middle)], 2: [(middle, middle)], 3: equal[3]} and len(equal[3]) == 1
    every = sorted(((i, i) for i in range(n)), key=str)
    assert got[0] == every and got[2] == every and len(got[1]) == 2 * n - 1
    assert len(got[3]) == len(greedy(old[3], new[3], equal[3])) if n < 1000 else 2 * n - 1 >= len(got[3]) >= n


def test_common_places_beyond_the_budget():
    rng = random.Random(2)
    a = [rng.randrange(3000) for _ in range(2500)]
    b = [rng.randrange(3000) for _ in range(2500)]
    got = C.common_places(a, b)
    assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got) and all(x < y and z < w for (x, z), (y, w) in zip(got, got[1:]))


def test_empty_sides():
    """An empty page against any number of words is one insertion or deletion."""
    words = [f"w{i}" for i in range(1001)]
    assert C.edit_script([], words) == [("insert", 0, 0, 0, 1001)] and C.edit_script(words, []) == [("delete", 0, 1001, 0, 0)] and C.edit_script([], []) == []
    assert C.compare_pages([], words) == ([], list(range(1001)), False)


def test_similar_pages(spark):
    """The joins find exactly the pairs at the threshold, and each page's best match."""
    rng = random.Random(4)
    make = lambda: [[rng.choice("aabcdefghijklmnop") + rng.choice("00012") for _ in range(rng.choice([0, 1, 5, 9, 30]))] for _ in range(40)]
    sides = {d: (make(), make()) for d in range(3)}
    for a, b in sides.values():
        b[:10] = [[*p[: len(p) // 2], *b[i][: len(p) // 2]] for i, p in enumerate(a[:10])]
    df = [spark.createDataFrame([(d, i, p) for d, two in sides.items() for i, p in enumerate(two[k])], "doc_id long, page int, words array<string>") for k in (0, 1)]
    every = {(d, i, j): C.similarity(p, q) for d, (a, b) in sides.items() for i, p in enumerate(a) for j, q in enumerate(b) if set(p) & set(q)}
    for least in (0.5, 0.2, 0.0):
        got = {(r.doc_id, r.old_page, r.new_page): r.sim for r in C.similar_pages(*df, ["doc_id"], "page", least).collect()}
        assert got == {k: s for k, s in every.items() if s >= least} and len(got) > 10
    best = {}
    for (d, i, j), s in sorted(every.items()):
        if s > best.get((d, i), (0,))[0]:
            best[d, i] = s, j
    assert {(r.doc_id, r.old_page): (r.sim, r.new_page) for r in C.best_matches(*df).collect()} == best


def test_compare_documents(spark):
    base, other = [f"w{i}" for i in range(10)], [f"x{i}" for i in range(10)]
    old = spark.createDataFrame([(1, 1, base), (1, 2, other)], "doc_id long, page int, words array<string>")
    new = spark.createDataFrame([(1, 1, [*base[:3], "new", *base[4:]]), (1, 2, other), (1, 3, ["z"])], "doc_id long, page int, words array<string>")
    got = C.compare_stats(C.compare_documents(old, new)).first()
    assert (got.pages_changed, got.words_added, got.words_removed, got.pages_added, got.pages_removed) == (1, 1, 1, 1, 0)


def test_names(spark):
    rows = [("a", i, n) for i, n in enumerate(["a-2.pdf", "a.pdf", "A.pdf", "con.txt", "x/y", "", "b", "B"])]
    got = {r.idx: (r.final, r.error) for r in S.resolve_names(spark.createDataFrame(rows, "batch string, idx long, name string")).collect()}
    assert got == {0: ("a-2.pdf", None), 1: ("a.pdf", None), 2: ("A-3.pdf", None), 3: (None, "reserved"), 4: (None, "separator"), 5: (None, "empty"), 6: ("b", None), 7: ("B-2", None)}


def plain_names(names, mark):
    """Names of a batch, one after the other."""
    taken, counts, final = set(), {}, []
    for name in names:
        stem, dot, ext = name.rpartition(".") if mark == "-" and name.rfind(".") > 0 else (name, "", "")
        chosen, n = name, counts.get(name.lower(), 1)
        while chosen.lower() in taken:
            n += 1
            chosen = f"{stem}{mark}{n}{dot}{ext}"
        counts[name.lower()] = n
        taken.add(chosen.lower())
        final.append(chosen)
    return final


def test_names_in_ranges(spark):
    """Names that clash with made ones, in ranges of few rows; no group of a whole batch is made."""
    rng, rows, expected = random.Random(3), [], {}
    for mark in "-#":
        rows = []
        for b in range(30):
            end = lambda: "".join(rng.choice(["", f"{mark}{rng.randint(2, 5)}"]) for _ in range(3))
            names = [rng.choice("aAb") + end() + rng.choice(["", ".pdf", ".PDF", ".p-2"]) + rng.choice(["", "", end()]) for _ in range(60)]
            rows += [(f"b{b}" if b else None, i, n) for i, n in enumerate(names)]
            expected |= {(mark, f"b{b}" if b else None, i): f for i, f in enumerate(plain_names(names, mark))}
        out = S.resolve_names(spark.createDataFrame(rows, "batch string, idx long, name string"), mark, 100)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = {(mark, r.batch, r.idx): r.final for r in out.collect()}
        assert len(got) == len(rows) and {k: (v, expected[k]) for k, v in got.items() if v != expected[k]} == {}


def test_scalars(spark):
    assert one(spark, U.fold_text(F.lit("Gộp Nguyễn Đổng"))) == "gop nguyen dong"
    assert one(spark, U.nfkc(F.lit("ﬁ Ⅳ"))) == "fi IV"
    assert [tuple(m) for m in one(spark, T.find_matches(F.lit("aXaxAxb.x"), "ax"))] == [(0, 2), (2, 4), (4, 6)]
    assert one(spark, T.try_iso_date(F.lit("2024-02-31"))).isoformat() == "2024-03-02"
    assert one(spark, T.try_iso_date(F.lit("31/02/2024"))) is None
    assert one(spark, T.try_number(F.lit("00123"))) is None and one(spark, T.try_number(F.lit("1,5"))).value == 1.5 and one(spark, T.try_number(F.lit("1234567890123456"))).risk
    assert one(spark, T.math_safe(F.lit("{" * 11))) is False and one(spark, T.math_safe(F.lit("{" * 10 + "}" * 10))) is True and one(spark, T.math_safe(F.lit(""))) is False
    assert one(spark, T.inline_format(F.lit("**a** [t](javascript:x) [u](https://y)"))).startswith("<strong>a</strong> [t](javascript:x) <a href")
    assert one(spark, T.format_bytes(F.lit(1536))) == "1.5 KB" and one(spark, T.format_bytes(F.lit(-1))) == "0 B" and one(spark, T.format_bytes(F.lit(512))) == "512 B"
    assert one(spark, T.sanitise_entry_name(F.lit("é" * 200))) == "é" * 127 and one(spark, T.sanitise_entry_name(F.lit("\x01"))) == "file"
    assert one(spark, T.neutralise_formula(F.lit("=1"))) == "'=1" and one(spark, T.neutralise_formula(F.lit("a\x02b"))) == "ab"
    assert one(spark, T.split_cells(F.lit(r"| a \| b | c |"))) == ["a | b", "c"]
    assert one(spark, T.basename_sans_ext(F.lit("a/b.c.pdf"))) == "b.c"
    assert one(spark, T.json_option_gate(F.lit('{"apiKey": 1}'))) == "secret" and one(spark, T.json_option_gate(F.lit("[1]"))) == "object"


@pytest.mark.parametrize(("spec", "error", "pages"), [("1-3, 7", None, [1, 2, 3, 7]), ("3-1", None, [1, 2, 3]), ("", "empty", []), ("x", "bad:x", []), ("1-99", "range:1-99", []), ("1-3,2", "overlap:2", [])])
def test_ranges(spark, spec, error, pages):
    got = P.parse_ranges(spark.createDataFrame([(1, spec, 10)], "id int, spec string, n int"), "id", "spec", "n").collect()
    assert {r.error for r in got} == {error} and sorted(r.page for r in got if r.page) == pages


def test_compact_ranges(spark):
    got = P.compact_ranges(spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 7, 9, 10, 0)], "id int, page int"), "id").first()
    assert got.spec == "1-3,7,9-10"


def test_two_columns_read_down(spark):
    rows = [(1, 1, i, 0, f"{side}{i}", x, x + 100, 100.0 + 14 * i, 10.0, False) for side, x in (("n", 50.0), ("s", 300.0)) for i in range(6)]
    rows = [(d, p, i if s[0] == "n" else 100 + i, o, s, a, b, y, z, r) for d, p, i, o, s, a, b, y, z, r in rows]
    got = L.reading_order(spark.createDataFrame(rows, "doc_id long, page int, line_no int, off int, str string, x0 double, x1 double, baseline double, size double, rotated boolean")).collect()
    assert {r.region for r in got if r.line_no < 100} == {0} and {r.region for r in got if r.line_no >= 100} == {1}


def test_first_fit_rows():
    assert L.first_fit_rows([100.0, 103.0, 120.0, 101.0], [10.0] * 4) == [0, 0, 1, 0]


def test_words_glue_and_split(spark):
    rows = [("foo ", 0.0, 20.0), ("bar", 20.0, 35.0), ("a b", 60.0, 75.0), ("far", 200.0, 215.0)]
    items = spark.createDataFrame([(1, 1, s, a, b, 100.0, 10.0, False) for s, a, b in rows], "doc_id long, page int, str string, x0 double, x1 double, baseline double, size double, rotated boolean")
    assert sorted(r.text for r in L.words_from_items(items).collect()) == ["a", "b", "far", "foobar"]


def test_blank_and_regions(spark):
    cells = [(1, 1, x, y, 0 if (x, y) in {(1, 1), (2, 2), (7, 7)} else 255) for x in range(10) for y in range(10)]
    a = spark.createDataFrame(cells, "doc_id long, page int, x int, y int, grey int")
    rows = [[0 if (x, y) in {(1, 1), (2, 2), (7, 7)} else 255 for x in range(10)] for y in range(10)]
    page = spark.createDataFrame([(1, 1, rows)], "doc_id long, page int, rows array<array<int>>")
    mask = R.visual_diff(page, page.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda v: F.lit(255)))))
    assert sorted((r.x0, r.y0, r.x1, r.y1, r.ink) for r in R.change_regions(mask).collect()) == [(1, 1, 2, 2, 2), (7, 7, 7, 7, 1)]
    flat = R.ink_stats(a.withColumn("grey", F.lit(100))).select(R.classify_blank(F.col("ink_ratio"), F.col("stddev"), F.lit(False))).first()[0]
    assert flat == "content"


def deskewed(spark, pages):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(pages)], "doc_id long, page int, rows array<array<int>>")
    return {r.page: (r.angle, r.score) for r in R.deskew_search(df).collect()}


def test_deskew_finds_a_planted_angle(spark):
    """Bars turned by -4 degrees need a turn of 4, also on a page that is thinned; a flat page none."""

    def bars(angle, size, times=1):
        wide, high = size
        page = [[255] * wide for _ in range(high)]
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        for below in (-144, -72, 0, 72, 144):
            for t in range(-160, 161):
                x, y = round(wide / 2 + times * (t * c - below * s)), round(high / 2 + times * (t * s + below * c))
                for dy in range(4 * times):
                    for dx in range(40):
                        if 0 <= x + dx < wide and 0 <= y + dy < high:
                            page[y + dy][x + dx] = 20
        return page

    got = deskewed(spark, [bars(-4, (400, 560)), bars(3, (400, 560)), bars(-4, (1200, 1680), 3), [[255] * 40] * 30, [], [[], [10]]])
    assert abs(got[0][0] - 4) <= 0.5 and abs(got[1][0] + 3) <= 0.5 and abs(got[2][0] - 4) <= 1 and got[3] == (0, 0) and got[4] == (0, 0) and got[5][0] == 0


def test_deskew_against_plain_loops(spark):
    rng = random.Random(5)
    pages = [[[rng.choice([255, 255, 200, 30, 160]) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 20))] for _ in range(12)]

    def score(page, angle):
        high, wide = len(page), max(map(len, page))
        s, c = math.sin(math.radians(angle)), math.cos(math.radians(angle))
        ink = [0] * high
        for y, row in enumerate(page):
            for x, v in enumerate(row):
                at = math.floor(high / 2 + (x - wide / 2) * s + (y - high / 2) * c + 0.5)
                if v <= 160 and 0 <= at < high:
                    ink[at] += 255 - v
        return sum((v - sum(ink) / high) ** 2 for v in ink) / high

    for i, (angle, best) in deskewed(spark, pages).items():
        scores = {a / 2: score(pages[i], a / 2) for a in range(-10, 11)}
        assert best == pytest.approx(max(scores.values())) and scores[angle] == pytest.approx(best) and (angle == 0 or scores[0] < best)


def test_marks(spark):
    marks = pd.DataFrame([(1, 1, "del", 0.1, 0.1, 0.05, 0.02), (1, 1, "del", 0.151, 0.1, 0.05, 0.02), (1, 1, "ins", 0.2, 0.1, 0.05, 0.02), (1, 1, "del", 0.1, 0.3, 0.05, 0.02)], columns=["doc_id", "page", "kind", "nx", "ny", "nw", "nh"])
    got = D.coalesce_marks(spark.createDataFrame(marks, "doc_id long, page int, kind string, nx double, ny double, nw double, nh double")).collect()
    assert sorted((r.kind, round(r.nx, 3), round(r.nw, 3)) for r in got) == [("del", 0.1, 0.05), ("del", 0.1, 0.101), ("ins", 0.2, 0.05)]


def test_residue_encodings(spark):
    blobs = spark.createDataFrame([(1, bytearray("a Secret b".encode())), (2, bytearray("Secret".encode("utf-16-be"))), (3, bytearray("Secret".encode().hex().encode())), (4, bytearray(b"none"))], "doc_id long, content binary")
    got = {(r.doc_id, r.enc) for r in D.residue(blobs, spark.createDataFrame([("Secret",)], ["needle"])).collect()}
    assert got == {(1, "utf8"), (2, "utf16be"), (3, "hex-utf8")}


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\x03"
    df = spark.createDataFrame([(bytearray(png), bytearray(jpeg))], "p binary, j binary")
    got = df.select(S.png_size(F.col("p")).alias("p"), S.jpeg_size(F.col("j")).alias("j")).first()
    assert tuple(got.p) == (640, 480) and tuple(got.j) == (200, 300)


def test_tree_cuts_cycles(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "node string, parent string")
    assert sorted((r.node, r.depth) for r in P.walk_tree(nodes).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_deep_tree(spark):
    """A chain of 1,000 with twigs, in about ten rounds; the cap as an option; several parents; missing parents; loops."""
    rows = [("0", None), *[(str(i), str(i - 1)) for i in range(1, 1000)], *[(f"t{i}", str(i)) for i in range(0, 1000, 100)]]
    nodes = spark.createDataFrame(rows, "node string, parent string")
    rounds, plain = [], P.checkpointed
    P.checkpointed = lambda df: rounds.append(1) or plain(df)
    try:
        got = {r.node: (r.depth, r.path[-3:]) for r in P.walk_tree(nodes).collect()}
    finally:
        P.checkpointed = plain
    assert len(rounds) <= 11 and len(got) == 1010
    assert got["999"] == (999, ["997", "998", "999"]) and got["t900"] == (901, ["899", "900", "t900"])
    cut = {r.node: r.cut for r in P.walk_tree(nodes, 32).collect()}
    assert set(cut) == {*map(str, range(32)), "t0"} and [n for n, c in cut.items() if c] == ["31"]
    odd = [("a", None), ("b", "a"), ("c", "b"), ("b", "c"), ("d", "b"), ("d", "a"), ("x", "gone"), ("l", "l"), (None, "a")]
    walked = P.walk_tree(spark.createDataFrame(odd, "node string, parent string")).filter("node is not null")
    assert sorted("/".join(r.path) for r in walked.collect()) == ["a", "a/b", "a/b/c", "a/b/d", "a/d"]
    assert P.walk_tree(nodes.limit(0)).count() == 0


def regions_of(grid):
    """Plain flood fill: (x0, y0, x1, y1, ink) of the 8-connected sets of True, by their first cells."""
    left, out = {(y, x) for y, line in enumerate(grid) for x, v in enumerate(line) if v}, []
    for cell in sorted(left):
        if cell in left:
            left.remove(cell)
            todo, seen = [cell], []
            while todo:
                y, x = todo.pop()
                seen.append((y, x))
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            ys, xs = zip(*seen, strict=True)
            out.append((min(xs), min(ys), max(xs), max(ys), len(seen)))
    return out


@pytest.mark.parametrize("strip", [1, 2, 256])
def test_regions_of_nulls(spark, strip):
    """Null pixels and lines aren't changed; pages without lines have no region."""
    one, none, same = (0, 9, True), (0, None, None), (0, 0, False)
    pages = [(1, 1, [[one, none, one], None, [], [same, one]]), (2, 1, []), (3, 1, None), (4, 1, [[]])]
    mask = spark.createDataFrame(pages, "doc_id long, page int, rows array<array<struct<grey: int, other: int, changed: boolean>>>")
    assert sorted(tuple(r) for r in R.change_regions(mask, strip).collect()) == [(1, 1, 0, 0, 0, 0, 0, 1), (1, 1, 1, 2, 0, 2, 0, 1), (1, 1, 2, 1, 3, 1, 3, 1)]


@pytest.mark.parametrize("strip", [1, 2, 5, 256])
def test_regions_across_strips(spark, strip):
    """Parts of strips are one region where they touch, whatever the height of strips: noise, spirals, ragged and empty lines."""
    draw = random.Random(7)
    grids = [[[draw.random() < share for _ in range(draw.randint(0, 23))] for _ in range(n)] for share in (0.1, 0.3, 0.45, 0.6) for n in (1, 7, 30)]
    spiral = [[(min(x, y, 22 - x, 22 - y) % 2 == 0 and (x, y) != (0, 1 + x)) for x in range(23)] for y in range(23)]
    comb = [[x % 2 == 0 or y == 18 for x in range(21)] for y in range(19)]
    grids += [spiral, comb, [], [[], [True], []], [[True, False], [], [True, True]], [[False] * 5] * 9]
    pages = [(1, k, [[(0, 0, v) for v in line] for line in grid]) for k, grid in enumerate(grids)]
    mask = spark.createDataFrame([*pages, (2, 0, None)], "doc_id long, page int, rows array<array<struct<grey: int, other: int, changed: boolean>>>")
    got = R.change_regions(mask, strip).orderBy("doc_id", "page", "region").collect()
    assert all(r.doc_id == 1 for r in got)
    for k, grid in enumerate(grids):
        assert [tuple(r)[3:] for r in got if r.page == k] == regions_of(grid)
        assert [r.region for r in got if r.page == k] == list(range(len(regions_of(grid))))


def test_rungs(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 5.0), ("a", 3, 4.0)], "k string, quality int, bytes double")
    assert [r.bytes for r in J.rung_points(df, ["k"]).orderBy("quality").collect()] == [10.0, 10.0, 5.0]
    three = spark.createDataFrame([("a", 22, 30.0), ("a", 50, 50.0), ("a", 80, 180.0)], "k string, quality int, bytes double")
    pick = lambda b: tuple(J.pick_setting_under_budget(three, ["k"], F.lit(b)).first())[1:]
    assert pick(40.0) == (36.0, True) and pick(10.0) == (22.0, False) and pick(999.0) == (80.0, True)


def test_registry_refuses_duplicates():
    name = next(iter(catalog.queries()))
    with pytest.raises(ValueError):
        registry.register(name)(lambda spark, sf_dir: None)


def test_registry_versions(monkeypatch):
    monkeypatch.setattr(registry, "OPERATIONS", {})
    for version in (2, 10, 1):
        registry.register("a", version=version)(version)
    registry.register("b")("b")
    assert set(registry.OPERATIONS) == {"a.v1", "a.v2", "a.v10", "b.v1"}
    assert registry.latest(registry.OPERATIONS) == {"a": 10, "b": "b"}


def test_dedupe_proposals(spark):
    """A mark goes if an earlier kept one of its page covers it; one that went covers nothing."""
    schema = "doc_id long, page int, mark_id int, nx double, ny double, nw double, nh double"
    rows = [
        (1, 1, 0, 0.2, 0.2, 0.3, 0.1), (1, 1, 1, 0.21, 0.21, 0.1, 0.05), (1, 1, 2, 0.185, 0.2, 0.33, 0.11), (1, 1, 3, 0.17, 0.2, 0.36, 0.11), (1, 1, 4, 0.175, 0.2, 0.02, 0.02),
        (1, 1, 5, 0.6, 0.6, 0.1, 0.1), (1, 2, 1, 0.21, 0.21, 0.1, 0.05), (2, 1, 1, 0.21, 0.21, 0.1, 0.05),
    ]
    got = D.dedupe_proposals(spark.createDataFrame(rows[::-1], schema)).collect()
    assert sorted(tuple(r) for r in got) == [rows[i] for i in (0, 3, 5, 6, 7)]
    assert D.dedupe_proposals(spark.createDataFrame([], schema)).count() == 0


def test_text_diff_clauses(spark):
    """Changed runs are clauses of words; what stays, goes and comes is what both texts hold."""
    rng = random.Random(3)
    texts = [(i, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))) for i in range(60)]
    planted = [(100, "the fee is due in May", "the large fee was due\n in  May 2020"), (101, None, "all new"), (102, "gone", None), (103, "same", " same "), (104, " ".join(["x"] * 1200), " ".join(["y"] * 1200)), (105, "", "z " * 1200)]
    got = {r.pair_id: r for r in C.text_diff_clauses(spark.createDataFrame(texts + planted, "pair_id long, a string, b string")).collect()}
    assert (got[100].added, got[100].removed) == (["large", "was", "2020"], ["is"])
    assert (got[101].added, got[101].removed) == (["all new"], []) and (got[102].added, got[102].removed) == ([], ["gone"])
    assert (got[103].added, got[103].removed, got[103].wholesale) == ([], [], False)
    assert len(got[105].added[0].split()) == 1200 and not got[105].wholesale
    assert (got[104].added, got[104].removed, got[104].wholesale) == ([], [], True)
    for i, a, b in texts:
        x, y = a.split(), b.split()
        came, went = (" ".join(c).split() for c in (got[i].added, got[i].removed))
        assert len(x) - len(went) == len(y) - len(came) == lcs(x, y)
        assert sorted(x + came) == sorted(y + went)


def test_keywords(spark):
    texts = spark.createDataFrame([(1, "One fish, one FISH", "x"), (2, "none", "y"), (3, None, "z"), (4, "aaaaa", None)], "i int, text string, n_hits string").drop("n_hits")
    words = spark.createDataFrame([("one",), ("fish",), ("one",), ("aa",), ("aaa",), ("",), (None,)], "keyword string")
    assert sorted((r.i, r.keyword, r.n_hits) for r in D.keyword_hits(texts, words).collect()) == [(1, "fish", 2), (1, "one", 2), (2, "one", 1), (4, "aa", 2), (4, "aaa", 1)]
    assert D.keyword_hits(texts, words.limit(0)).count() == 0 and D.keyword_hits(texts.limit(0), words).count() == 0


@pytest.mark.parametrize("block", [10_000, N.BLOCK_BYTES])
def test_many_needles(spark, block):
    """A hundred thousand needles, many inside others, against plain counting; in one block or in many."""
    rng = random.Random(6)
    n = 100_000 if block > 10_000 else 6_000
    needles = {"".join(rng.choice("abcdé") for _ in range(rng.randint(2, 9))) for _ in range(n)} | {f"needle{i}" for i in range(n - 5000)}
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [f"x needle{i} y" for i in (7, 70, 990)]
    found = N.find(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text", spark.createDataFrame([(w, w) for w in needles], "p string, keyword string"), "p", ["keyword"], block)
    got = {(r.i, r.keyword): r.n_hits for r in found.collect()}
    want = {}
    for i, t in enumerate(texts):
        for w in {t[a:b] for a in range(len(t)) for b in range(a + 2, min(len(t), a + 11) + 1)} & needles:
            want[i, w] = t.count(w)
    assert got == want and len(got) > 500


def test_numbered(spark):
    df = spark.range(5000).selectExpr("id", "hash(id) as h", "id % 3 as k")
    got = J.numbered(df, ["k", "h"], "pos").orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(1, 5001)) and [(r.k, r.h) for r in got] == sorted((r.k, r.h) for r in got)
    assert J.numbered(df.limit(0), ["k"], "pos").count() == 0


def test_chain(spark):
    df = registry.chain(spark.range(5), [(lambda d, n: d.filter(F.col("id") >= n), {"n": 2}), (lambda d: d.withColumn("x", F.col("id") * 2), {})])
    assert [r.x for r in df.collect()] == [4, 6, 8]


def test_local_mean_and_rotation(spark):
    """Rows of any length, against loops over the pixels."""
    import math
    import random

    rng = random.Random(1)
    rows = [[rng.randrange(256) for _ in range(n)] for n in (9, 0, 14, 3, 11)]
    pages = spark.createDataFrame([(1, 1, rows), (2, 1, [[], [7]])], "doc_id long, page int, rows array<array<int>>")
    got = {r.doc_id: r.means for r in R.local_mean(pages, 2).collect()}

    def mean(y, x):
        box = [rows[j][i] for j in range(max(0, y - 2), min(5, y + 3)) if len(rows[j]) > x for i in range(max(0, x - 2), min(len(rows[j]), x + 3))]
        return sum(box) / len(box)

    assert got[2] == [[], [7.0]]
    assert [[round(v, 9) for v in r] for r in got[1]] == [[round(mean(y, x), 9) for x in range(len(r))] for y, r in enumerate(rows)]
    turned = {r.doc_id: r.rows for r in R.rotate_raster(pages, 20.0).collect()}
    s, c, cx, cy = math.sin(math.radians(20)), math.cos(math.radians(20)), 6.5, 2.0

    def source(x, y):
        at = math.floor((x - cx) * c + (y - cy) * s + cx + 0.5), math.floor((y - cy) * c - (x - cx) * s + cy + 0.5)
        return rows[at[1]][at[0]] if 0 <= at[1] < 5 and 0 <= at[0] < len(rows[at[1]]) else 255

    assert turned[1] == [[source(x, y) for x in range(len(r))] for y, r in enumerate(rows)] and turned[2] == [[], [7]]


def test_scanned_items(spark):
    """Blank, narrow and sizeless items go; sizes and turns come from the matrix; characters are normalised."""
    raw = [
        ("\ufb01rst \uff11", 10.0, 0.5, 0.0, 10.0, 30.0), ("up", 0.0, 12.0, -12.0, 0.0, 10.0), (" ", 10.0, 0.0, 0.0, 10.0, 5.0), ("thin", 10.0, 0.0, 0.0, 10.0, 0.0), ("none", 10.0, 0.0, 0.0, 0.0, 20.0),
        ("leans", 10.0, 1.2, 3.0, 4.0, 20.0),
    ]
    df = spark.createDataFrame([(1, 1, i, 0, *r[:5], 50.0, 100.0, r[5], "Serif") for i, r in enumerate(raw)], "doc_id long, page int, line_no int, off int, str string, a double, b double, c double, d double, e double, f double, width double, font_name string")
    got = {r.str: (r.x0, r.x1, r.baseline, r["size"], r.rotated) for r in L.scan_text_items(df).collect()}
    assert got == {"first 1": (50.0, 80.0, 100.0, 10.0, False), "up": (50.0, 60.0, 100.0, 12.0, True), "leans": (50.0, 70.0, 100.0, 5.0, True)}


def page_items(spark, cells, page=1):
    """Items from (str, x0, baseline, size, font)."""
    rows = [(1, page, i, 0, s, float(x), float(x) + 5.0 * len(s), float(b), float(z), False, f) for i, (s, x, b, z, f) in enumerate(cells)]
    return spark.createDataFrame(rows, "doc_id long, page int, line_no int, off int, str string, x0 double, x1 double, baseline double, size double, rotated boolean, font_name string")


TABLE = [(f"r{r}c{c}", 50 + 130 * c, 200 + 16 * r, 10, "Serif") for r in range(4) for c in range(3)]


def test_tables_and_markdown(spark):
    """A table between a heading and text, found with its cells; a bold line is a heading, list items keep their marks."""
    text = [("Title", 50, 60, 15, "Serif"), ("Under", 50, 90, 12, "Serif"), ("Short", 50, 120, 10, "Serif-Bold"), ("below one", 50, 400, 10, "Serif"), ("two", 50, 412, 10, "Serif"), ("3) third", 62, 460, 10, "Serif"), ("• dot", 50, 490, 10, "Serif")]
    items = page_items(spark, TABLE + text)
    found = [r for r in G.detect_tables(items).collect() if r.rows]
    assert [r.rows for r in found] == [[[f"r{r}c{c}" for c in range(3)] for r in range(4)]] and found[0].refused is None
    got = G.page_markdown(items).first()
    assert got.refused is None
    want = ["# Title", "## Under", "### Short", "| r0c0 | r0c1 | r0c2 |", "| --- | --- | --- |", "| r1c0 | r1c1 | r1c2 |", "| r2c0 | r2c1 | r2c2 |", "| r3c0 | r3c1 | r3c2 |", "below one two", "3. third", "- dot"]
    assert [x.strip() for x in got.markdown.split("\n") if x.strip()] == want
    turned = G.detect_tables(items.withColumn("rotated", F.col("str") == "r1c1")).collect()
    assert [r.refused for r in turned if r.refused] == ["rotated"] and not any(r.rows for r in turned)


def test_pages_with_too_many_items(spark):
    from foliospark.operators.layout import MAX_ITEMS

    many = spark.range(MAX_ITEMS + 1).selectExpr("1L as doc_id", "1 as page", "cast(id as int) as line_no", "0 as off", "'x' as str", "cast(id % 500 as double) as x0", "cast(id % 500 + 5 as double) as x1", "cast(id div 500 * 12 as double) as baseline", "10D as size", "false as rotated", "'Serif' as font_name")
    assert [r.refused for r in G.detect_tables(many).collect()] == ["items"] and G.page_markdown(many).first().refused == "items"
    assert {r.region for r in L.reading_order(many).collect()} == {0}
    assert [r.refused for r in G.detect_tables(many, MAX_ITEMS + 1).collect() if r.refused] == []
    few = G.detect_tables(many.limit(MAX_ITEMS)).collect()
    assert not any(r.refused == "items" for r in few)


def plain_first_fit(baselines, sizes):
    """Item by item over all rows so far."""
    return L.fold_rows(baselines, [max(2.0, 0.35 * s) for s in sizes])


def plain_runs(items, height):
    """(text, x0, x1) of the runs of a page in order, item by item over all bands so far."""
    rows, out = [], []
    for i in sorted(items, key=lambda i: (i["baseline"], i["x0"], i["str"])):
        y, h = i["baseline"] / height, i["size"] / height
        for row in rows:
            if abs(row["y"] - y) <= max(0.004, 0.35 * row["h"]):
                row["h"] = max(row["h"], h)
                row["items"].append(i)
                break
        else:
            rows.append({"y": y, "h": h, "items": [i]})
    for row in rows:
        last = None
        for i in sorted(row["items"], key=lambda i: i["x0"]):
            if last is not None and -1 <= (i["x0"] - last) / (row["h"] * height) <= 2.5:
                out[-1] = (out[-1][0] + i["str"], out[-1][1], max(out[-1][2], i["x1"]))
            else:
                out.append((i["str"], i["x0"], i["x1"]))
            last = i["x1"]
    return out


@pytest.mark.parametrize("chunk", [1, 20, 20_000])
def test_rows_split_at_gaps(spark, monkeypatch, chunk):
    """Pages split at gaps give what the fold of the whole page gives: level, uneven, drifting and equal baselines, tall and tiny items."""
    draw, pages = random.Random(3), []
    for kind in range(40):
        n, step = draw.choice([1, 3, 40, 150]), draw.choice([0.4, 3.0, 12.0, 30.0])
        pages.append([(round(draw.randrange(n) * step + draw.uniform(0, kind % 5), draw.choice([1, 6])), draw.choice([4.0, 9.5, 10.0, 40.0]) if kind % 2 else 10.0) for _ in range(n)])
    pages.append([(k * 1.9, 10.0) for k in range(400)])
    rows = [(1, p, k // 7, k % 7, chr(97 + k % 26), float(draw.randrange(500)), 5.0 * draw.randrange(1, 9), b, s, False, "Serif") for p, page in enumerate(pages) for k, (b, s) in enumerate(page)]
    rows = [(*r[:6], r[5] + r[6], *r[7:]) for r in rows]
    items = spark.createDataFrame(rows, "doc_id long, page int, line_no int, off int, str string, x0 double, x1 double, baseline double, size double, rotated boolean, font_name string")
    monkeypatch.setattr(L.chunk_of, "__defaults__", (chunk,))
    fitted = L.first_fit(items).orderBy("page", "line_no", "off").collect()
    runs = G.group_runs_relative(items, 842.0).orderBy("page", "run").collect()
    for p, page in enumerate(pages):
        want = plain_first_fit(*map(list, zip(*page, strict=True)))
        assert L.first_fit_rows(*map(list, zip(*page, strict=True))) == want
        assert [r.row_no for r in fitted if r.page == p] == want
        named = [{"str": r[4], "x0": r[5], "x1": r[6], "baseline": r[7], "size": r[8]} for r in rows if r[1] == p]
        assert [(r.text, r.x0, r.x1) for r in runs if r.page == p] == plain_runs(named, 842.0)
        assert [r.run for r in runs if r.page == p] == list(range(len(plain_runs(named, 842.0))))
    assert L.first_fit_rows([], []) == [] and L.first_fit(items.limit(0)).count() == 0


def test_page_of_many_rows(spark):
    """200,000 items of one page, 50,000 rows: no step goes over all rows for each item."""
    many = spark.range(200_000).selectExpr("1L as doc_id", "1 as page", "cast(id as int) as line_no", "0 as off", "'x' as str", "cast(id % 4 * 100 as double) as x0", "cast(id % 4 * 100 + 5 as double) as x1", "cast(id div 4 * 12 as double) as baseline", "10D as size", "false as rotated")
    got = L.first_fit(many).agg(F.max("row_no").alias("top"), F.count_if(F.expr("row_no != line_no div 4")).alias("wrong")).first()
    assert (got.top, got.wrong) == (49_999, 0)
    assert L.reading_order(many).filter("region != line_no % 4").isEmpty()  # four columns
    assert G.group_runs_relative(many, 842.0).count() == 200_000


def test_runs_by_the_tallest(spark):
    items = page_items(spark, [("ab", 50, 100, 10, "S"), ("cd", 60, 101, 14, "S"), ("far", 200, 100, 10, "S"), ("low", 50, 120, 10, "S")])
    got = sorted((r.text, r.x0, r.x1) for r in G.group_runs_relative(items, 842.0).collect())
    assert got == [("abcd", 50.0, 70.0), ("far", 200.0, 215.0), ("low", 50.0, 65.0)]


def test_cap_of_regions():
    """Two hundred regions of a page are kept, and the rest is told of."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [[0 if x % 2 == 0 and y % 2 == 0 else 255 for x in range(40)] for y in range(21)]
    page = spark.createDataFrame([(1, 1, rows), (2, 1, rows[:5])], "doc_id long, page int, rows array<array<int>>")
    mask = R.visual_diff(page, page.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda v: F.lit(255)))))
    got = R.first_regions(R.change_regions(mask), 200).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("overflow").alias("o")).collect()
    assert {r.doc_id: (r.n, r.o) for r in got} == {1: (200, True), 2: (60, False)}

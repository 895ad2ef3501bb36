"""What each method adds, against plain versions; and both sides of each bound."""

import random
from collections import Counter
from math import comb
from pathlib import Path

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import common, language, licenses, line_frequency, minmax, packing, pii, queries, sharding

SMALL = "/root/testdata/sf0.001"


# ---- quality rules


def word(*n):
    return "".join(chr(97 + x // 16) + chr(97 + x % 16) for x in n)


@pytest.mark.parametrize("shared", [1, 2, 6])
def test_line_frequency(spark, shared):
    """Hosts with boilerplate, one-line documents, exact and near copies, rare lines."""
    rng = random.Random(shared)
    menu = [" ".join(f"menu{word(i, j)}" for j in range(9)) for i in range(shared)]
    rows = []
    for host in ("a", "b", None):
        for i in range(60):
            own = "\n".join(" ".join(f"own{word(i, k, j)}" for j in range(20)) for k in range(4))
            parts = [*menu, own, f"Page {i} of 60"] if i % 3 else [own, "seldom" if i < 15 else f"one {word(i)}"]
            rng.shuffle(parts)
            rows.append("\n".join(parts) if i % 7 else menu[0])
        rows += [rows[-1], rows[-2], rows[-1] + " x", rows[-1] + " y", "", None, "  \n\n", menu[-1] + "\n\n" + menu[0]]
    per = len(rows) // 3
    rows = [(i, t, ("a", "b", None)[i // per]) for i, t in enumerate(rows)]
    judged = line_frequency.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.doc_id: (r.n_words_removed, r.clean_text, r.kept) for r in judged.collect()}
    assert got == brute.boilerplate(rows) and any(n for n, _, _ in got.values())


def test_line_frequency_of_a_hot_host(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 4000")
    rows = [(r.doc_id, r.text, "one") for r in docs.select("doc_id", "text").collect()]
    judged = line_frequency.line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_share=0.01)
    got = {r.doc_id: (r.n_words_removed, r.clean_text, r.kept) for r in judged.collect()}
    assert got == brute.boilerplate(rows, 0.01) and any(n for n, _, _ in got.values())


# ---- near duplicates


def test_one_bucket_of_unlike_documents(spark):
    """Bands of two values put unlike documents into common buckets: no link is lost block by block."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(rng.choice([40, 60, 90]))]
        rows.append(" ".join(shared + own))
        if i % 5 == 0:
            rows.append(" ".join(shared + own[:-3]))
        if i % 10 == 0:
            rows.append(" ".join(shared[5:] + own))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(df, permutations=120, bands=120).collect()}
    want = brute.components(rows, 5, 80)
    assert got == want and any(not w[2] for w in want.values())


def test_blocks(spark):
    rows = [(1, i, 1, bytes(240), bytes(8 * n)) for i, n in enumerate([10] * 1200 + [1_000_000, 1_050_000, 2_000_000])]
    members = spark.createDataFrame(rows, "host long, node long, label long, sig binary, shingles binary")
    blocks = minmax.blocks_of(members).selectExpr("lo", "hi", "size(rows) as n", "aggregate(rows, 0L, (a, r) -> a + octet_length(r.shingles)) as bytes").collect()
    assert sum(b.n for b in blocks) == len(rows) and all(b.n <= 700 for b in blocks)
    assert all(b.hi <= 1.11 * b.lo for b in blocks) and all(b.bytes <= minmax.BLOCK_BYTES or b.n <= 2 for b in blocks)


# ---- sharding


def test_law_of_inversion():
    """The distribution function at each value's bounds, against binomial coefficients."""
    for good, bad, n in ((7, 9, 6), (3, 40, 11), (30, 4, 20), (1, 1, 1), (200, 300, 90)):
        total, below = comb(good + bad, n), 0
        for k in range(max(0, n - bad), min(n, good) + 1):
            weight = comb(good, k) * comb(bad, n - k)
            if weight / total > 1e-9:
                assert sharding.inverted((below + weight / 2) / total, good, bad, n) == k
            below += weight


def test_matrix_on_both_sides_of_numpys_limit():
    for limit in (0, sharding.NUMPY_LIMIT):
        m = sharding.communication_matrix([1000, 0, 57, 3], 7, 1, limit)
        assert m.sum(axis=1).tolist() == [1000, 0, 57, 3] and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and m.min() >= 0
        cells = [sharding.communication_matrix([50, 50], 2, s, limit)[0, 0] for s in range(400)]
        assert abs(np.mean(cells) - 25) < 0.6 and abs(np.var(cells) - 50 * 50 * 50 * 50 / (100 * 100 * 99)) < 1.5
    m = sharding.communication_matrix([30_000_000] * 40, 3, 2)
    big = np.array([sharding.draw(np.random.default_rng(s), 10**12, 23 * 10**12, 15 * 10**6) for s in range(200)])
    assert m.sum(axis=0).tolist() == [400_000_000] * 3 and abs(big.mean() - 625_000) < 300


def test_equal_rows_are_spread(spark):
    df = spark.createDataFrame([(None, "x")] * 4000, "doc_id long, text string").repartition(4)
    got = sharding.shuffle_exact(df, 8).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [500] * 8 and len({(r.shard, r.slot) for r in got}) == 4000


def test_places_are_uniform(spark):
    """Each of few rows comes to each place about equally often."""
    df, seen = spark.range(6).coalesce(2), Counter()
    for seed in range(25):
        for r in sharding.shuffle_exact(df, 3, seed=seed).collect():
            seen[r.id, r.shard] += 1
    assert len(seen) == 18 and max(seen.values()) < 20


# ---- licences


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.sampled_from(["MIT", "GPL-3.0", "AGPL-3.0", "MPL-2.0", "Unknown-1", "CC-BY-NC-2.5", "GPL-2.0 WITH Classpath-exception-2.0"]), lambda x: st.tuples(x, st.sampled_from(["AND", "OR", "and", "or"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})"), max_leaves=8))
def test_expressions_by_recursive_descent(expression):
    known = {name: x for name, (_, x) in licenses.IDENTIFIERS.items()}
    value = licenses.evaluate(expression)
    assert value.permissive == pytest.approx(brute.permissive(expression, known))
    assert value.labels == {licenses.IDENTIFIERS[t][0] for t in expression.lower().replace("(", " ").replace(")", " ").split() if t in licenses.IDENTIFIERS}


def test_labels_and_scores(spark):
    texts = {
        "SPDX-Licence-Identifier: MIT\n": ("mit", 1.0), "spdx-license-identifier: MIT AND LicenseRef-X": ("mit", 0.0), "GNU Lesser General Public License": ("lgpl", 0.5),
        "Mozilla Public License; All rights reserved.": ("mpl,reserved", 0.0), "under the MIT license, CC BY-SA": ("cc-by-sa,mit", 0.5), "License-Identifier: (MIT": ("mit", 1.0), "nothing": ("", 0.0),
        "license-identifier: EUPL-1.2 OR 0BSD": ("0bsd,eupl", 1.0), None: ("", 0.0),
    }
    got = {r.text: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == texts


def test_labels_of_documents(spark):
    """labels of every text: notice phrases looked for word by word, and what stands behind tags."""
    phrases = licenses.BASE_PHRASES | licenses.NOTICE_PHRASES
    got = {r.doc_id: (r.labels, r.score) for r in queries.op3_licenses(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        labels = {x for x in brute.licence(r.text, phrases)[4].split(",") if x}
        if "identifier" not in (r.text or "").lower():
            assert got[r.doc_id] == (",".join(sorted(labels)), min((licenses.PERMISSIVE[x] for x in labels if x in licenses.PERMISSIVE), default=0.0))


# ---- packing


@pytest.mark.parametrize(("full", "rule"), [((1024, 1024, 1024**2), "norm"), ((1024, 4, 1024**2), "norm"), ((1024, 1024, 300_000), "dot"), ((1024, 5, 400_000), "norm")])
def test_vector_best_fit(full, rule):
    lengths = sorted((int(x) for x in np.random.default_rng(1).integers(1, 540, 400)), reverse=True)
    weights = 1.0, 0.01, 0.01
    bins = packing.Bins(*full, weights, rule)
    assert [bins.place(n, lengths[-1]) for n in lengths] == brute.packed(lengths, full, weights, rule)


# ---- personal data


def test_bootstrapped_spans(spark):
    """The method's spans of every document, from patterns scored in plain Python."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    cands = {i: list(pii.candidates(t, pii.base_spans(t))) for i, t in docs.items()}
    trusted = brute.bootstrapped([(p, docs[i][s:e], seed) for i, some in cands.items() for s, e, p, seed, _ in some])
    got = {r.doc_id: r.spans for r in queries.op10_bootstrap_pii(spark, "/root/testdata/sf0.01").collect()}
    order = ("email", "ip", "card", "phone", "id")
    for i, t in docs.items():
        spans = brute.personal(t) + [("id", s, e) for s, e, p, _, base in cands[i] if not base and p in trusted]
        spans = sorted(set(spans), key=lambda x: (x[1], order.index(x[0])))
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in spans), i


# ---- languages


def test_every_language_is_learned(spark):
    """Two hundred and fifty languages, beyond any number that was ever a bound."""
    rng = random.Random(0)
    letters = [rng.sample("abcdefghijklmnopqrstuvwxyz", 6) for _ in range(250)]
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(6)) for _ in range(30)), f"l{k:03}") for i, k in enumerate(list(range(250)) * 8)]
    got = language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=5, max_rows=1000).collect()
    out = [r for r in got if r.held_out]
    assert len({r.lang_pred for r in got}) == 250 and np.mean([r.lang == r.lang_pred for r in out]) > 0.9


# ---- tables on the way


def test_settled(spark):
    """What was stored on the way is deleted; the result stays."""
    paths = []

    def make():
        first = common.stored(spark.range(10), "first")
        second = common.settled(lambda: common.stored(first, "inner").filter("id > 3"), "second")
        paths.extend(first.inputFiles() + second.inputFiles())
        return second.filter("id > 5")

    out = common.settled(make, "out")
    assert [r.id for r in out.orderBy("id").collect()] == [6, 7, 8, 9]
    assert not any(Path(p.removeprefix("file://")).exists() for p in paths)

"""The pipeline's stages, each held against a plain version on its own input."""

from collections import Counter

import brute
import corpus_pipeline
import numpy as np
from foliospark.llm import packing

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_rules"](spark, docs, SMALL)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {i for i, t in rows.items() if not brute.quality(t)[5]}  # no line here is on so many documents

    one = stage["near_duplicates"](spark, good, SMALL)
    assert one.columns == docs.columns
    groups = brute.components([(i, rows[i]) for i in kept], 5, 80)
    stay = {r.doc_id for r in one.collect()}
    assert stay == {i for i, g in groups.items() if g[2]}

    clean = stage["decontamination"](spark, one, SMALL)
    left = {r.doc_id for r in clean.collect()}
    assert left == {i for i in stay if not brute.leaks(rows[i], bench)[4]}

    masked = {r.doc_id: r.text for r in stage["personal_data"](spark, clean, SMALL).collect()}
    assert masked.keys() == left
    for i, t in masked.items():
        spans = brute.personal(rows[i])
        assert ("[" not in t or t != rows[i]) if spans else True
        assert all(rows[i][a:b] not in t for _, a, b in spans)

    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left


def test_special_cases(spark, docs, texts):
    """Null ids and texts, repeated rows, clashing columns: each stage's own result, in its docs' columns."""
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SMALL).count() == 0
        assert name == "best_fit_packing" or f(spark, docs, SMALL).columns == docs.columns
    assert ids(stage["quality_rules"](spark, docs, SMALL)) == Counter(i for i, t in rows if not brute.quality(t)[5])
    groups = brute.components(texts.items(), 5, 80)
    stay = Counter(i for i, g in groups.items() if g[2])
    assert ids(stage["near_duplicates"](spark, docs, SMALL)) == stay + Counter([None])  # the row without id and text
    assert ids(stage["decontamination"](spark, docs, SMALL)) == Counter(i for i, t in rows if not brute.leaks(t, bench)[4])
    assert ids(stage["personal_data"](spark, docs, SMALL)) == Counter(i for i, _ in rows)
    packed = stage["best_fit_packing"](spark, docs, SMALL)
    assert ids(packed.filter("start = 0")) == Counter(i for i, _ in rows)
    held = packed.groupBy("sequence_id").agg({"length": "sum", "*": "count"}).collect()
    assert max(r["sum(length)"] for r in held) <= 1024 and max(r["count(1)"] for r in held) <= corpus_pipeline.DOCUMENTS


#: Names that the operators of the first four stages give to columns of their own.
OPERATORS_OWN = """kept n_words clean_text word_chars n_symbols n_dup_lines n_repeat_words base_failed n_words_removed spans items n_hit contaminated base key label doc h t present_ row
    _h _base _of _kept _often _clean _gone _key _k _spans _items _row _cands _more _doc _host _lines columns_of_the_caller component_id n_shingles""".split()


def test_columns_pass(spark):
    """Every column of the caller's goes through all stages with its values, whatever its name."""
    prose = [" ".join(f"word{(7 * i + j) % 997}x{j}" for j in range(80)) for i in range(12)]
    rows = [(i, t + f" mail a{i}@b.de", "en", "s", len(t), *(f"{i} {c}" for c in OPERATORS_OWN)) for i, t in enumerate(prose)]
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in OPERATORS_OWN)])
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        got = {r.doc_id: r for r in docs.collect()}
        assert len(got) == 12 and all(got[i][c] == f"{i} {c}" for i in got for c in OPERATORS_OWN)
    assert all("[email]" in r.text and r.n_chars == len(r.text) and r.lang == "en" and r.source == "s" for r in got.values())


def test_frequent_lines_are_gone(spark):
    """What the quality rules remove from a text isn't in the stage's output."""
    word = lambda *n: "".join(chr(97 + x // 16) + chr(97 + x % 16) for x in n)
    own = [" ".join(f"own{word(i, j)}" for j in range(60)) for i in range(50)]
    rows = [(i, f"share this page\n{t}", "en", "a", len(t) + 16) for i, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.quality_rules(spark, docs, SMALL)
    assert out.dtypes == docs.dtypes
    assert {tuple(r) for r in out.collect()} == {(i, t, "en", "a", len(t)) for i, t in enumerate(own)}


def test_packed_ids(spark):
    """The last stage returns the ids: each document's pieces spell its text."""
    docs = spark.createDataFrame([(i, f"text {i} " * (400 * i), "en", "a", 0) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.best_fit_packing(spark, docs, SMALL).orderBy("doc_id", "start").collect()
    assert all(len(r.ids) == 4 * r.length for r in out)
    spelled = {}
    for r in out:
        spelled[r.doc_id] = spelled.get(r.doc_id, []) + np.frombuffer(r.ids, "<u4").tolist()
    decode = packing.encoder(corpus_pipeline.TOKENIZER).exact.decode
    assert all(ids[-1] == packing.END for ids in spelled.values())
    assert {i: decode(ids[:-1]) for i, ids in spelled.items()} == {r.doc_id: r.text for r in docs.collect()}

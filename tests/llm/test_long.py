"""Very long texts: whole results from every operator and every stage."""

import random
import time

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foliospark.llm import host_reputation, language, licenses, line_frequency, minmax, packing, pii, repeats, sharding, winnowing
from foliospark.llm.common import stored

WORDS = 1_000_000


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(3)
    some = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    return "\n".join(" ".join(rng.choice(some) for _ in range(100)) for _ in range(WORDS // 100))


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    rows = [(0, long_text, "en", "a", 0), (1, "short " * 60, "en", "a", 0), (2, long_text[:2_000_000] + " more", "fr", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)


def timed(df, *columns):
    began = time.time()
    rows = {r.doc_id: r for r in df.select("doc_id", *columns).collect()}
    assert time.time() - began < 60
    return rows


def test_decontamination(spark, long_docs, long_text):
    """A text that is an item itself: every window hits, and all are one span."""
    words = brute.alnum_words(long_text)
    bench = spark.createDataFrame([(7, long_text), (8, " ".join(words[500:515])), (9, " ".join(words[40:44]))], "item_id long, text string")
    got = timed(winnowing.decontaminate(long_docs, bench), "n_words", "n_hit", "spans", "items")
    assert got[0].n_words == got[0].n_hit == WORDS and [tuple(s) for s in got[0].spans] == [(0, WORDS)]
    assert got[0]["items"] == got[2]["items"] == ["7", "8", "9"] and got[1].n_hit == 0
    assert got[2].n_words - got[2].n_hit in (1, 2)  # the word that is cut, and the new one


def test_redaction(spark):
    """A hundred thousand spans in a text."""
    n = 100_000
    df = spark.createDataFrame([(0, " ".join(f"mail u{i}@x.org now" for i in range(n)))], "doc_id long, text string")
    assert timed(pii.redact(df), "text")[0].text == " ".join(["mail [email] now"] * n)


def test_quality_rules(long_docs):
    got = timed(line_frequency.line_frequency_rules(long_docs), "n_words", "n_dup_lines", "kept")
    assert got[0].n_words == WORDS and got[0].n_dup_lines == 0 and got[0].kept and not got[1].kept


def test_near_duplicates(long_docs, long_text):
    got = timed(minmax.near_duplicates(long_docs), "n_shingles", "component_id")
    assert got[0].n_shingles == len(brute.shingles(long_text, 5)) and {i: r.component_id for i, r in got.items()} == {0: 0, 1: 1, 2: 2}


def test_repeats(long_docs, long_text):
    got = timed(repeats.remove_repeats(long_docs), "n_bytes", "n_removed", F.size("spans").alias("s"))
    assert got[0].n_bytes == len(long_text) and got[0].n_removed == got[2].n_removed == 2_000_000 and got[0].s == got[2].s == 1


def test_others(spark, long_docs, long_text):
    assert timed(licenses.scan_licenses(long_docs.withColumn("text", F.concat("text", F.lit(" under the MIT license")))), "n_words", "last_word")[0].last_word == WORDS
    assert {r.lang_pred for r in timed(language.identify_language(long_docs), "lang_pred").values()} <= {"en", "fr"}
    assert {r.shard for r in timed(sharding.shuffle_exact(long_docs, 3), "shard").values()} == {0, 1, 2}
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.org/"), "text").alias("url"))
    judged = host_reputation.host_reputation(pages, spark.createDataFrame([(0, 1)], "doc_id long, toxic int"))
    assert {r.doc_id: r.n for r in judged.select(F.col("page_id").alias("doc_id"), F.length("path").alias("n")).collect()}[0] == len(long_text) + 1


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " " * 15_000 + "<|endoftext|>y"])
def test_tokens_of_runs(text):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode(text).tolist() == encode.exact.encode(text, add_special_tokens=False).ids


def test_packing(long_docs, long_text):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(packing.tokenize(long_docs, public_tokenizers.path("byte_bpe_50k.json"))).filter("doc_id = 0").orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in packed])
    assert ids.tolist() == [*encode(long_text).tolist(), packing.END]


def test_stages(spark, long_docs):
    """What is kept of a very long text goes through every stage whole."""
    docs = long_docs.filter("doc_id = 0")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert out.select("doc_id").distinct().collect()[0].doc_id == 0, name
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.select("text").collect() == docs.select("text").collect(), name
        docs = out

"""Chat formatting, spelling variants and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import chat, search, spelling

# ---- chat formatting


ROLES = ["system", "user", "assistant", "tool", "", "[ROLE]", "a\\-b"]
TEXT = st.text("</s>[INSTOUROLEAY] \\-\nxé", max_size=40) | st.sampled_from(["</s>", "[/INST]", "</s", "<", "[INST", "\\", "<\\-/s>", "[[INST]]", "<s><s>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), TEXT), min_size=1, max_size=6))
def test_round_trip(turns):
    t = chat.TEMPLATE
    segments = [t.segments(role, text, k == 0) for k, (role, text) in enumerate(turns)]
    whole = "".join(s for turn in segments for s, _ in turn)
    assert list(t.read(whole)) == turns
    assert t.unescape("".join(s for turn in segments for s, loss in turn if loss)) == "".join(text for role, text in turns if role == "assistant")
    for role, text in turns:
        assert not any(c in t.escape(text) for c in ["<s>", *sum(t.turns.values(), ()), *t.other])


@pytest.mark.parametrize("wrong", [{"start": "<"}, {"start": "<\\s>"}, {"turns": {"a": ("[A", "x]"), "b": ("[AB", "y]")}}, {"turns": {"a": ("[A]", "abxab")}}, {"turns": {"a": ("[A]", "]]")}}])
def test_unreadable_templates(wrong):
    right = {"start": "<s>", "turns": {"a": ("[A]", "[/A]")}, "other": ("[R]", "[T]", "[/R]"), "moves": {}, "learned": (), "final": ()}
    assert chat.Template(**right)
    with pytest.raises(ValueError, match="control strings|opening|ending"):
        chat.Template(**(right | wrong))


def conversations(rows):
    """conv -> DIGEST without formatted_chars, by plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        roles, texts = [t[2] for t in turns], [t[3] for t in turns]
        allowed = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
        valid = all(b in allowed.get(a, ()) for a, b in zip(["", *roles], roles)) and roles[-1] == "assistant"
        said = "".join(x for r, x in zip(roles, texts) if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for r, x in zip(roles, texts))
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), valid)
    return out


def test_conversations(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "\\ok [INST]"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, None, "who"), (4, 5, "user", "last"), (4, None, "user", "first")]
    rows += [(5, 0, "user", "again"), (5, 0, "user", "again"), (5, 1, "assistant", "é\U0001f600" * 50_000), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (6, 1, "assistant", "b"), (6, 1, "assistant", "a"), (7, 0, "tool", "x")]
    rows += [(8, k, "user" if k % 2 == 0 else "assistant", f"turn {k} </s>") for k in range(25_000)]  # over several batches
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n_turns", "'x' as segments", "'y' as legal")
    turns = chat.format_turns(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in chat.digest(turns).collect()}
    assert got == conversations(rows)
    chars = {r.conv_id: r.n for r in turns.select("conv_id", F.explode("segments").alias("s")).groupBy("conv_id").agg(F.sum(F.length("s.text")).alias("n")).collect()}
    assert chars == {r.conv_id: r.formatted_chars for r in chat.digest(turns).collect()}
    assert chat.digest(chat.format_turns(df.limit(0))).count() == 0


# ---- spelling variants


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, damage=None):
    """word -> (form, root, n, n_near, form_n)."""
    count = Counter()
    for i, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(brute.LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if damage and h % damage == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def neighbours(rng, word):
    at, c = rng.randrange(len(word) + 1), rng.choice("abcé")
    return [word[:at] + c + word[at:], word[: at - 1] + c + word[at:] if at else c + word[1:], word[:at] + word[at + 1 :]]


@pytest.mark.parametrize(("longest", "extend", "most"), [(6, 3, 200_000), (3, 0, 50), (6, 200, 200_000)])
def test_variants(spark, longest, extend, most):
    """Every link of words over a small alphabet, whatever the dictionary; chains of forms; special rows."""
    rng = random.Random(longest * 7 + extend)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 16))) for _ in range(120)]
    words = {v for s in stems for v in [s, *neighbours(rng, s), *neighbours(rng, neighbours(rng, s)[0])]}
    chain = ["zzzaaaa", "zzzaaab", "zzzaabb", "zzzabbb"]
    rows = [(i, " ".join([w] * rng.choice([4, 5, 6, 30, 200]))) for i, w in enumerate(sorted(words)) if w]
    rows += [(9000 + k, " ".join([w] * 5 * 6**k)) for k, w in enumerate(chain)] + [(None, "ÀBCDEFé àbcdefé ÀBCDEFG " * 9), (9, None), (10, ""), (11, "x" * 300_000), (11, "Straße strasse " * 6), (11, "Straße strasse " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as word", "1 as n", "2 as form")
    got = {r.word: tuple(r)[1:] for r in spelling.group_variants(df, longest, extend, most, damage=5).collect()}
    assert got == variants(rows, 5)
    assert len(got) > 150 and sum(v[3] for v in got.values()) > 200
    assert spelling.group_variants(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=14), min_size=1, max_size=15), st.integers(2, 7), st.randoms())
def test_bounds(some, longest, rng):
    """A word and one that an edit away from it always share one of their rarest grams, at the place that is looked up."""
    count = Counter(w[i : i + k] for w in some for k in range(2, longest + 1) for i in range(len(w) - k + 1))
    counts = {g: n for g, n in count.items() if len(g) == 2 or all(count[g[:k]] > 2 for k in range(2, len(g)))}
    by = {size: spelling.Decomposer(counts, size) for size in range(2, longest + 1)}
    for w in some:
        for v in neighbours(rng, w):
            if v == w or len(v) < 6:
                continue
            short, long = sorted((w, v), key=len)
            one = by[min(len(short) // 2, longest)]
            mine, theirs = set(one.rarest(short)), set(one.rarest(long))
            assert any((g, a + shift) in theirs for g, a in mine for shift in range(len(long) - len(short) + 1))


def test_last_forms(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)] + [("a", "b")]
    assert {r.word: r.root for r in spelling.last_forms(spark.createDataFrame(forms, "word string, form string")).collect()} == {f"w{i:03}": "w100" for i in range(100)} | {"a": "b"}


# ---- ranked search


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score) rows by scoring every document."""
    held = [(i, Counter(brute.alnum_words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in brute.alnum_words(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out.update((item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k]))
    return out


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    word = lambda: vocabulary[min(int(rng.paretovariate(0.6)), 400) - 1]
    return [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(n)], lambda size: " ".join(word() for _ in range(size))


@pytest.mark.parametrize("k", [1, 10])
def test_search(spark, monkeypatch, texts, k):
    """Ties, repeated rows, missing ids and texts; several blocks of queries give the same."""
    rng = random.Random(k)
    some, make = corpus(rng, 900)
    docs = [*enumerate(some), (5000, some[3]), (4000, some[3]), (4000, some[3]), (None, some[4]), (None, None), (1, None), (2, ""), (3, "..."), *((10_000 + i, t) for i, t in texts.items())]
    items = [(i, make(rng.randint(1, 40))) for i in range(30)] + [(100, some[3]), (100, some[3]), (100, some[4]), (101, None), (102, "?"), (103, "unknownword"), (None, some[5]), (104, (some[3] + " ") * 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms", "'x' as score").repartition(3)
    t = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as rank", "1 as part")
    got = search.search(d, t, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked(docs, items, k)
    assert Counter(tuple(r) for r in got.collect()) == want
    if k == 1:
        return
    assert Counter(tuple(r) for r in search.search(d, t, k, query_bytes=3000).collect()) == want
    assert search.search(d.limit(0), t, k).count() == 0 and search.search(d, t.limit(0), k).count() == 0


def test_shards():
    """A shard's best documents equal all scores, at any threshold; blocks are left compressed."""
    rng = np.random.default_rng(2)
    n, terms = 6000, 60
    share = 1 / (1 + np.arange(terms)) ** 0.7
    held = [np.flatnonzero(rng.random(terms) < share * 0.6) for _ in range(n)]
    tfs = [rng.integers(1, 300, len(h)) for h in held]
    m, ids = rng.integers(25, 900, n), rng.permutation(n) * 3
    shard = search.Shard(ids, m, np.array([len(h) for h in held]), np.concatenate(held), np.concatenate(tfs))
    seen = Counter()
    for turn in range(60):
        query = [(int(t), int(rng.integers(0, 100) * (1 + t) ** 1.3)) for t in rng.choice(terms + 5, rng.integers(1, 25), replace=False)]
        weight = dict(query)
        score = [sum(weight.get(int(t), 0) * int(search.part(f, m[i])) for t, f in zip(held[i], tfs[i])) for i in range(n)]
        best = sorted((-s, int(i)) for s, i in zip(score, ids) if s > 0)[:10]
        least = -best[rng.integers(len(best))][0] if turn % 2 and best else 1
        got = list(zip(*shard.best(query, 10, least, seen), strict=True))
        assert [(-int(s), int(i)) for i, s in got] == [x for x in best if -x[0] >= least]
    assert 0 < seen["decompressed"] < 0.8 * seen["blocks"]


def test_compression():
    for top in (200, 60_000, 5_000_000):
        at = np.unique(np.random.default_rng(top).integers(0, top, 1000))
        tfs = np.random.default_rng(1).integers(1, top, len(at))
        one = search.PostingList(at, tfs, tfs)
        places, counts = one.blocks(slice(None))
        assert (places[: one.n] == at).all() and (counts[: one.n] == tfs).all() and (counts[one.n :] == 0).all()
        assert one.bounds.max() == one.bound == tfs.max()

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Names that operators give to their own columns.
CLASHING = "n_words", "kept", "score", "spans", "shard", "host", "n_bytes", "held_out", "base", "component_id", "key", "label", "n"


def prose(rng, n, lines=1):
    words = ["".join(rng.choice("abcdeéüxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    per = max(1, n // lines)
    return "\n".join(" ".join(words[i : i + per]) for i in range(0, n, per))


@pytest.fixture(scope="session")
def texts():
    """doc_id -> text: every special case, unique ids."""
    rng = random.Random(5)
    base = prose(rng, 120, 4)
    long_ = prose(rng, 30_000, 200)
    passage = prose(rng, 60)
    out = {
        0: base, 1: base, 2: base.replace(base.split()[7], "changed", 1), 3: base + " tail", 4: None, 5: "", 6: " \n\t ", 7: "One two", 8: "ONE two", 9: long_,
        10: long_[: len(long_) // 2] + " middle " + long_[len(long_) // 2 :], 11: prose(rng, 70) + " " + passage + " " + prose(rng, 70), 12: passage + "\n" + prose(rng, 90),
        13: "a b c " * 40, 14: "x" * 1000, 15: "line one here\nline one here\n\nline two\n" * 10, 16: "Released under the MIT License. under the mit license",
        17: "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 WITH LLVM-exception\nx", 18: "Licensed under the Apache License, Version 2.0. CC BY-NC 4.0 cc by nc",
        19: "mail a.b@c.de and x@@y.com, a@b.c@d.e 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (555) 555-0100 ext", 20: "İÉ é ÀB ıA 12 ｱ",
        21: "#*$% |<>& " * 30, 22: "\U0001f600 emoji \U0001f600 4111111111111111 mail \U0001f600 q@r.st", 23: "<|endoftext|> a <|endoftext|>b", 24: prose(rng, 9), 25: prose(rng, 10),
    }
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The special cases with clashing columns, null ids, and repeated rows."""
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "fr", None if i % 7 == 0 else f"s{i % 2}") for i, t in texts.items()]
    rows += [(None, texts[11], "en", "s0"), (None, None, None, None), (11, texts[11], "en", "s0"), (12, texts[12], "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", *(f"'old' as {c}" for c in CLASHING))


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)

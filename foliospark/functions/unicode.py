"""Unicode normal forms, which Spark has no expression for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_text(c: Column) -> Column:
    """Lower case without combining marks."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t if t is None else t.lower()
            bare = "".join(x for x in unicodedata.normalize("NFD", t) if not "̀" <= x <= "ͯ")
            return bare.replace("đ", "d").replace("Đ", "D").lower()

        return texts.map(one)

    return fold(c)


def nfkc(c: Column) -> Column:
    """Compatibility normal form, by the ICU library that Spark ships; ASCII is its own.

    A Python function would lose how the rows are dealt, so that windows over pages had all items shuffled again.
    """
    other = c.isNotNull() & (F.octet_length(c) > F.length(c))  # in UTF-8 that is: not ASCII
    return F.when(other, F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)

"""Intake of files and naming of outputs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.text import name_error
from foliospark.storage import checkpointed


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of the files under a folder that Spark can read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def verdict(name: Column, size: Column, head: Column, most: int = 200 * 1024 * 1024) -> Column:
    """What a file is taken for, by its name, size and first bytes."""
    low = F.lower(name)
    pdf = F.when(F.hex(head) == "255044462D", "pdf").otherwise("not-pdf")
    return F.when(low.rlike(r"\.hei[cf]$"), "refused").when(size > most, "too-large").when(low.rlike(r"\.pdf$"), pdf).when(low.rlike(r"\.(png|jpe?g)$"), "image").otherwise("unsupported")


def png_size(content: Column) -> Column:
    """struct<width,height> that a PNG's header declares, or null."""
    at = lambda start: F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(at(17).alias("width"), at(21).alias("height")))


def jpeg_size(content: Column) -> Column:
    """struct<width,height> of a JPEG's first frame header, or null."""

    @F.pandas_udf("width long, height long")
    def size(heads: pd.Series) -> pd.DataFrame:
        out = []
        for raw in heads:
            at, found = 2, (None, None)
            while raw is not None and raw[:2] == b"\xff\xd8" and at + 9 <= len(raw) and raw[at] == 0xFF:
                marker, length = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    found = int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big")
                    break
                at += 2 + max(length, 2)
            out.append(found)
        return pd.DataFrame(out, columns=["width", "height"]).astype("Int64")

    return size(content)


def ranks(rows: DataFrame, keys: list[str], range_rows: int) -> DataFrame:
    """rows with rank, the number of rows of the same keys, marked real, that have a smaller idx. Keys of many rows are dealt into ranges of idx."""
    n, low, high = rows.agg(F.count("*"), F.min("idx"), F.max("idx")).first()
    ranges = max(1, min(10_000, -(-n // range_rows)))
    part = F.floor((F.col("idx").cast("double") - (low or 0)) / ((high or 0) - (low or 0) + 1.0) * ranges)
    dealt = rows.withColumn("_part", F.coalesce(part, F.lit(-1)).cast("int"))
    held = dealt.groupBy(*keys, "_part").agg(F.sum("real").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), before.alias("_start"))
    within = F.sum("real").over(Window.partitionBy(*keys, "_part").orderBy("idx", F.col("real").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("real")
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return dealt.withColumn("_in", within).join(starts, same).withColumn("rank", F.col("_start") + F.col("_in")).drop("_part", "_in", "_p", "_start", *(f"_{k}" for k in keys))


def resolve_names(names: DataFrame, mark: str = "-", range_rows: int = 200_000) -> DataFrame:
    """(batch, idx, final, error): bad names refused, later equal ones (without regard to case) numbered by the first free suffix.

    Equal names are ranked by idx. A name with a suffix can be made of one other name alone, its parent; where a
    batch has both, the number goes to whichever comes first. Those few are met by a join, round by round,
    as a name that has lost its place to its parent is numbered from 2 itself.
    """
    spark = names.sparkSession
    name, low = F.col("name"), F.col("low")
    linted = names.select(F.col("batch").cast("string"), F.col("idx").cast("long"), "name", name_error(name).alias("error"))
    good = linted.filter(F.col("error").isNull() & name.isNotNull()).withColumn("low", F.lower("name"))

    number = rf"{re.escape(mark)}([2-9]|[1-9][0-9]{{1,9}})"
    forms = [rf"^(.+){number}(\.[^.]*)$", rf"^(\.?[^.]*){number}()$"] if mark == "-" else [rf"^(.+){number}()$"]
    parsed = [(F.regexp_extract(low, f, 1), F.regexp_extract(low, f, 2), F.regexp_extract(low, f, 3), low.rlike(f)) for f in forms]
    parent = F.coalesce(*(F.when(fits, F.struct(F.concat(stem, ext).alias("low"), n.cast("long").alias("n"))) for stem, n, ext, fits in parsed))
    firsts = good.groupBy("batch", "low").agg(F.min("idx").alias("idx"))
    children = firsts.withColumn("parent", parent).filter("parent is not null").select(F.col("batch").alias("b"), F.col("parent.low").alias("of"), F.col("parent.n").alias("n"), "idx", F.col("low").alias("child"))
    both = children.join(firsts.select("batch", "low"), F.col("b").eqNullSafe(F.col("batch")) & (F.col("of") == low))
    clashes = checkpointed(both.select("batch", "low", "n", "idx", "child"))

    rows = good.select("batch", "low", "idx", "name", F.lit(1).alias("real"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("child"))
    any_clash = not clashes.isEmpty()
    if any_clash:
        rows = rows.unionByName(clashes.select("batch", "low", "idx", F.lit(None).cast("string").alias("name"), F.lit(0).alias("real"), "n", "child"))
    placed = ranks(rows, ["batch", "low"], range_rows)
    if not any_clash:
        numbered = placed.withColumn("n", F.col("rank") + 1)
    else:
        placed = checkpointed(placed)
        # m: how many of the parent's rows come before the child's first
        met = placed.filter("real = 0").groupBy("batch", "low").agg(F.array_sort(F.collect_list(F.struct("n", F.col("rank").alias("m"), "child"))).alias("met"))
        met = checkpointed(met.select(F.col("batch").alias("_b"), F.col("low").alias("_l"), "met"))
        lost = spark.createDataFrame([], "batch string, low string")
        skips = F.aggregate(
            "met", F.array().cast("array<long>"), lambda acc, x: F.when(x["n"] - 1 - F.col("late") - F.size(acc) >= x["m"], F.concat(acc, F.array(x["n"]))).otherwise(acc)
        )
        while True:
            late = lost.select(F.col("batch").alias("_lb"), F.col("low").alias("_ll"), F.lit(1).alias("late"))
            judged = met.join(late, F.col("_b").eqNullSafe(F.col("_lb")) & (F.col("_l") == F.col("_ll")), "left").select("_b", "_l", "met", F.coalesce("late", F.lit(0)).alias("late"))
            judged = checkpointed(judged.withColumn("skips", skips))
            now = judged.select(F.col("_b").alias("batch"), F.explode("met").alias("x"), "skips").filter(~F.array_contains("skips", F.col("x.n"))).filter(F.col("x.m") > 0)
            now = checkpointed(now.select("batch", F.col("x.child").alias("low")))
            if now.exceptAll(lost).isEmpty() and lost.exceptAll(now).isEmpty():
                break
            lost = now
        placed = placed.filter("real = 1").drop("n", "child")
        placed = placed.join(judged.select("_b", "_l", "skips"), F.col("batch").eqNullSafe(F.col("_b")) & (low == F.col("_l")), "left").drop("_b", "_l")
        placed = placed.join(late, F.col("batch").eqNullSafe(F.col("_lb")) & (low == F.col("_ll")), "left")
        free = F.col("rank") + 1 + F.coalesce("late", F.lit(0))
        numbered = placed.withColumn("n", F.aggregate(F.coalesce("skips", F.array().cast("array<long>")), free.cast("long"), lambda n, x: F.when(x <= n, n + 1).otherwise(n)))
    at = F.length("name") - F.locate(".", F.reverse("name")) + 1  # place of the last dot
    cut = (F.locate(".", F.reverse("name")) > 0) & (at > 1) & F.lit(mark == "-")
    stem, ext = F.when(cut, F.expr("substring(name, 1, length(name) - locate('.', reverse(name)))")).otherwise(name), F.when(cut, F.expr("right(name, locate('.', reverse(name)))")).otherwise("")
    final = F.when(F.col("n") == 1, name).otherwise(F.concat(stem, F.lit(mark), F.col("n").cast("string"), ext))
    refused = linted.filter(F.col("error").isNotNull() | name.isNull())
    return numbered.select("batch", "idx", final.alias("final"), F.lit(None).cast("string").alias("error")).unionByName(refused.select("batch", "idx", F.lit(None).cast("string").alias("final"), "error"))

"""Ranking, numbering and log audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.storage import checkpointed

#: Moves that a queue item may make.
MOVES = {
    "queued": ["running", "cancelled"],
    "running": ["awaiting-input", "paused", "succeeded", "failed", "cancelled"],
    "awaiting-input": ["running", "failed", "cancelled"],
    "paused": ["running", "cancelled"],
    "succeeded": [],
    "failed": ["queued"],
    "cancelled": [],
}


def search_rank(docs: DataFrame, key: str, tests: list[tuple[str, str, int]], rest: str, k: int) -> DataFrame:
    """The k best by score: tests are (=, ^ or ~, needle, score) on name, then rest in descr for 25; ties by key."""
    name, score = F.lower("name"), None
    for how, needle, points in tests:
        hit = name == needle if how == "=" else name.startswith(needle) if how == "^" else name.contains(needle)
        score = F.when(hit, points) if score is None else score.when(hit, points)
    score = score.when(F.lower("descr").contains(rest), 25).otherwise(0)
    return docs.withColumn("score", score.cast("int")).filter("score > 0").orderBy(F.desc("score"), key).limit(k).select(key, "score")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with its place in the order from 1: sorted by range, counted by range, so that no task holds all rows."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a checkpoint, as the bounds of ranges are sampled and both uses must see the same ones
    ranged = checkpointed(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    sizes = ranged.groupBy("_part").count()
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # a row for each shuffle partition, so the broadcast doesn't grow with df
    return ranged.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_part", "_in", "_p", "_before")


def first_k(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group, with their number rn."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rn") <= k)


def distinct_in_order(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Distinct values with the place where each is first."""
    return df.groupBy(*by).agg(F.min(order).alias("first_at"))


def allowed(was: Column, to: Column) -> Column:
    """Whether a queue item may move so."""
    ok = F.lit(False)
    for state, nexts in MOVES.items():
        ok = F.when(was == state, to.isin(*nexts) if nexts else F.lit(False)).otherwise(ok)
    return ok


def illegal_transitions(events: DataFrame) -> DataFrame:
    """(item_id, seq, was, to) of moves that aren't allowed."""
    was = F.lag("state").over(Window.partitionBy("item_id").orderBy("seq"))
    return events.withColumn("was", was).filter(F.col("was").isNotNull() & ~allowed(F.col("was"), F.col("state"))).select("item_id", "seq", "was", F.col("state").alias("to"))


def warm_measurement(runs: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The second run of each key; the first warms up."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 2").select(key, F.col(value).alias("measured"))


def delivery_overall(entries: DataFrame, batch: str, status: str) -> DataFrame:
    """(batch, overall): complete, dispatched, partial or failed."""
    n = lambda *s: F.count_if(F.col(status).isin(*s))
    counted = entries.groupBy(batch).agg(n("failed", "skipped").alias("bad"), n("dispatched").alias("sent"), n("saved").alias("saved"))
    overall = F.when((F.col("bad") == 0) & (F.col("sent") == 0), "complete").when(F.col("bad") == 0, "dispatched").when(F.col("saved") > 0, "partial").otherwise("failed")
    return counted.select(batch, overall.alias("overall"))


def rung_points(samples: DataFrame, key: list[str]) -> DataFrame:
    """Mean bytes for each quality, no less than the mean of the quality below."""
    mean = samples.groupBy(*key, "quality").agg(F.avg("bytes").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy(*key).orderBy("quality"))
    return mean.withColumn("bytes", F.greatest("mean", before)).select(*key, "quality", "bytes")


def pick_setting_under_budget(points: DataFrame, key: list[str], budget: Column, floor: float = 22.0) -> DataFrame:
    """The highest quality whose interpolated bytes fit the budget; the floor, not fitting, where none does."""
    w = Window.partitionBy(*key).orderBy("quality")
    seg = points.withColumn("lo_q", F.lag("quality").over(w)).withColumn("lo_b", F.lag("bytes").over(w)).withColumn("budget", budget)
    share = F.when(F.col("bytes") == F.col("lo_b"), 1.0).otherwise((F.col("budget") - F.col("lo_b")) / (F.col("bytes") - F.col("lo_b")))
    at = F.when(F.col("lo_q").isNotNull() & (F.col("budget") <= F.col("bytes")), F.struct(F.col("quality").alias("q"), (F.col("lo_q") + share * (F.col("quality") - F.col("lo_q"))).alias("at")))
    picked = seg.groupBy(*key).agg(
        F.max("budget").alias("budget"), F.max_by("bytes", "quality").alias("top_b"), F.max("quality").alias("top_q"), F.min_by("bytes", "quality").alias("low_b"), F.min(at).alias("hit")
    )
    quality = F.when(F.col("budget") >= F.col("top_b"), F.col("top_q").cast("double")).when(F.col("budget") < F.col("low_b"), F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.least(F.col("top_q").cast("double"), F.col("hit.at"))))
    return picked.select(*key, F.round(quality, 6).alias("quality"), (F.col("budget") >= F.col("low_b")).alias("fits"))


def corrective_step(quality: Column, ratio: Column, ladder: list[int]) -> Column:
    """The lower rung that an overshoot calls for, or null."""
    lower = F.filter(F.array(*map(F.lit, sorted(ladder, reverse=True))), lambda r: r < quality)
    jump = F.when(ratio > 2.5, F.size(lower)).when(ratio > 1.6, F.least(F.lit(2), F.size(lower))).otherwise(1)
    return F.get(lower, F.least(jump, F.size(lower)) - 1)


def size_verdict(size: Column, target: Column, given: Column) -> Column:
    return F.when(size <= target, "met").when(size > given, "refuse-bigger").otherwise("best-effort")

"""Exact uniform sharding by a hypergeometric communication matrix.

How many rows each partition sends to each shard is drawn beforehand, row by row
of the matrix, from the multivariate hypergeometric distribution: the counts of
a uniform permutation. Each partition permutes its rows and sends those counts;
each shard permutes what it gets. The result is a uniform shuffle whose shards
differ by at most one row.

The rows are stored once, permuted and numbered in their partition, so that a
task that is run again deals its rows as before, equal rows have places of their
own, and nothing is shuffled before the exchange. The driver holds only the
matrix: partitions times shards counts. A shard is permuted in parts that are
dealt at random, so no task holds a shard.

Defined cases
  null text              size 8, crc32 of nothing
  null doc_id            dealt like any other
  repeated rows, ties    each row is dealt by itself
  very long text         a column like any other
  fewer rows than shards shards without rows
  empty table            empty result
  clashing columns       a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import BROADCAST_BYTES, small, stored

SEED, PART_ROWS, MAX_PARTS = 20_240_229, 20_000, 65_536
#: From this many rows on numpy draws no hypergeometric variates.
NUMPY_LIMIT = 1_000_000_000
#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33
OUT = ["shard", "slot"]


def communication_matrix(blocks: list[int], shards: int, seed: int, limit: int = NUMPY_LIMIT) -> np.ndarray:
    """counts[block, shard] of a uniform permutation whose shards differ by one row at most."""
    rng = np.random.default_rng(seed)
    total = sum(blocks)
    room = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    counts = np.zeros((len(blocks), shards), np.int64)
    for i, n in enumerate(blocks):
        left, rest = n, int(room.sum())
        for s in range(shards):  # one draw a cell
            rest -= int(room[s])
            counts[i, s] = draw(rng, int(room[s]), rest, left, limit)
            left -= counts[i, s]
        room -= counts[i]
    return counts


def draw(rng: np.random.Generator, good: int, bad: int, n: int, limit: int = NUMPY_LIMIT) -> int:
    """A hypergeometric draw: how many of n rows, drawn without return from good + bad, are good."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < limit:
        return int(rng.hypergeometric(good, bad, n))
    return inverted(rng.random(), good, bad, n)


def inverted(u: float, good: int, bad: int, n: int) -> int:
    """The value of the hypergeometric law at u of its distribution function, at any size.

    The law's weights are taken relative to that of its mode, by the ratio of neighbours: one product for each value,
    so nothing large is subtracted. Values whose weight is lost in the sum are beyond the resolution of u.
    """
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    width = 64 + int(8 * (n * (good / (good + bad)) * (bad / (good + bad))) ** 0.5)

    def side(step: int) -> np.ndarray:
        """Weights of the values from the mode's neighbour on, upwards or downwards."""
        parts, last, at = [], 1.0, mode
        while last > 1e-25 and low <= at + step <= high:
            k = np.arange(at, max(low - 1, min(high + 1, at + step * width)), step, dtype=np.float64)
            k = k[: (high - at if step > 0 else at - low)]
            up = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)) if step > 0 else k * (bad - n + k) / ((good - k + 1) * (n - k + 1))
            part = last * np.cumprod(up)
            parts.append(part)
            last, at = float(part[-1]), at + step * len(part)
        return np.concatenate(parts) if parts else np.zeros(0)

    below, above = side(-1)[::-1], side(1)
    sums = np.cumsum(np.concatenate([below, [1.0], above]))
    return int(mode - len(below) + min(np.searchsorted(sums, u * sums[-1], side="right"), len(sums) - 1))


def shuffle_exact(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """rows with shard (int, from 0) and slot (long, its place in the shard, gapless from 0)."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() in OUT])
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    permuted = numbered.sortWithinPartitions(F.xxhash64(F.lit(seed), "_row"), "_row").withColumn("_at", F.monotonically_increasing_id()).drop("_row")
    permuted = stored(permuted, "permuted")
    block = F.shiftright("_at", ROW_BITS)
    sizes = sorted(permuted.groupBy(block.alias("b")).count().collect())
    n = sum(r[1] for r in sizes)
    ends = communication_matrix([r[1] for r in sizes], shards, seed).cumsum(axis=1)
    plan = rows.sparkSession.createDataFrame([(r[0], e.tolist()) for r, e in zip(sizes, ends)], "_b long, _ends array<long>")
    plan = F.broadcast(plan) if ends.nbytes <= BROADCAST_BYTES else plan

    sent = permuted.join(plan, block == F.col("_b")).withColumn("_local", F.col("_at").bitwiseAND(2**ROW_BITS - 1))
    sent = sent.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_local"))).cast("int"))
    # the shard's own permutation: a random part, then a random place in the part
    parts = int(max(1, min(MAX_PARTS, n // (shards * PART_ROWS) + 4)))
    sent = sent.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed + 2), "_at"), F.lit(parts)).cast("int")).drop("_b", "_ends", "_local")
    within = Window.partitionBy("shard", "_part").orderBy(F.xxhash64(F.lit(seed + 3), "_at"), "_at")
    held = sent.groupBy("shard", "_part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = small(stored(held.select(F.col("shard").alias("_s"), F.col("_part").alias("_p"), before.alias("_start")), "starts"))
    placed = sent.withColumn("_in", F.row_number().over(within) - 1)
    same = (F.col("shard") == F.col("_s")) & (F.col("_part") == F.col("_p"))
    return placed.join(starts, same).withColumn("slot", (F.col("_start") + F.col("_in")).cast("long")).drop("_s", "_p", "_part", "_in", "_start", "_at")

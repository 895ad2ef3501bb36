"""Stateful flows as Structured Streaming queries over a folder of events.

Each flow is a function of a streaming DataFrame; `drained` runs one over all
files that are there and returns what it wrote. `settled_rows` does so for flows
that wait for the watermark: a closing row at the end lets out what still waits.
The reference gives no watermark; ours is an hour of event time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.jobs import MOVES
from foliospark.storage import shared_dir

LATENESS = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of Parquet files."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if not _is_folder(spark, path) else "*.parquet").parquet(path if _is_folder(spark, path) else folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's result over all that is there: written to the shared folder, then read."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/foliospark-streams/{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
    else:  # a result that is replaced as a whole: the last batch stands
        write = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def ledger(stream: DataFrame, key: list[str], time: str | None = None) -> DataFrame:
    """Each artifact once, over all retries. With a time column the state is bounded by the watermark."""
    if time:
        return stream.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


#: Beyond all event times, and within what pandas holds: the row that closes a stream.
CLOSING = "2250-01-01 00:00:00"


def settled_rows(stream: DataFrame, flow: Callable[[DataFrame], DataFrame], time: str) -> tuple[DataFrame, int]:
    """What flow wrote by the end of the stream, in append mode, and how many rows came too late for it.

    The flow runs over all that is there; then one row without values but a time beyond all others moves the watermark,
    and what waited for it comes out. The flow must leave out rows whose keys are null.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/foliospark-streams/{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{at}/closing")
    out = flow(stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{at}/closing")))
    late = 0

    def run() -> int:
        query = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
        query.awaitTermination()
        return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

    late += run()
    empty = [F.to_timestamp(F.lit(CLOSING)).alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    spark.range(1).select(*empty).write.mode("append").parquet(f"{at}/closing")
    late += run()
    return spark.read.schema(out.schema).parquet(f"{at}/out"), late


def token_frames(stream: DataFrame, time: str, value: str, width: str = "1 hour") -> DataFrame:
    """(start, tokens, total) of tumbling frames of event time: a frame is written once, when the watermark has passed it, and its state goes."""
    framed = stream.withWatermark(time, LATENESS).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("tokens"), F.round(F.sum(value), 4).alias("total"))
    return framed.select(F.col("w.start").alias("start"), "tokens", "total")


def job_states(stream: DataFrame) -> DataFrame:
    """(item_id, seq, was, to, legal) of each move of a queue item, in the order of (ts, event_id) over the whole stream.

    Events wait in the state of their item until the watermark has passed them; a timer of the item's first waiting event
    lets them out, however they were dealt over micro-batches. An item's state is its last move and what waits.
    """

    def move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, seq, *waiting = state.get if state.exists else (None, 0, [], [], [])
        rows = list(zip(*map(list, waiting), strict=True))
        if not state.hasTimedOut:
            for part in batches:
                rows += zip(part["ts"].astype("datetime64[us]").astype("int64"), part["event_id"], part["state"], strict=True)
        mark = state.getCurrentWatermarkMs()
        rows.sort(key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= mark * 1000]
        rest = rows[len(ready) :]
        out = []
        for _, _, to in ready:
            seq += 1
            out.append((int(key[0]), seq, was, to, was is None or to in MOVES[was]))
            was = to
        state.update((was, seq, [int(r[0]) for r in rest], [int(r[1]) for r in rest], [r[2] for r in rest]))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000, mark) + 1)
        yield pd.DataFrame(out, columns=["item_id", "seq", "was", "to", "legal"]).astype({"item_id": "int64", "seq": "int32"})

    kept = "was string, seq int, at array<long>, ids array<long>, states array<string>"
    moved = stream.withWatermark("ts", LATENESS).groupBy("item_id").applyInPandasWithState(
        lambda key, batches, state: move(key, batches, state) if not pd.isna(key[0]) else iter(()), "item_id long, seq int, was string, `to` string, legal boolean", kept, "append", GroupStateTimeout.EventTimeTimeout
    )
    return moved


Flow = Callable[[SparkSession, str], DataFrame]

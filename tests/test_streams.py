"""Stateful flows over many micro-batches, with rows out of order and too late."""

import random
import uuid
from datetime import datetime, timedelta

import pytest

from foliospark.operators.jobs import MOVES
from foliospark.storage import shared_dir
from foliospark.streaming import flows as S

START = datetime(2024, 1, 1)
SCHEMA = "item_id long, ts timestamp, event_id long, state string, value double"


@pytest.fixture
def streamed(spark):
    """A stream of one micro-batch for each list of rows, in order."""

    def make(batches):
        at = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)

    return make


def events(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(6), START + timedelta(minutes=2 * i, seconds=rng.randrange(60)), 1000 + i, rng.choice(sorted(MOVES)), float(i % 7)) for i in range(n)]


def moves(rows):
    out, last = set(), {}
    for item, _, _, to, _ in sorted(rows, key=lambda r: r[1:3]):
        seq, was = last.get(item, (0, None))
        out.add((item, seq + 1, was, to, was is None or to in MOVES[was]))
        last[item] = seq + 1, to
    return out


def test_moves_in_order(streamed):
    """Rows that are dealt over micro-batches out of order, within the lateness, give the moves in order."""
    rows = events(240)
    rows += [(2, rows[5][1], 7, "queued", 0.0), (2, rows[5][1], 3, "running", 0.0)]  # ties in time go by event id
    order = sorted(rows, key=lambda r: r[1] + timedelta(minutes=random.Random(r[2]).randrange(50)))
    got, late = S.settled_rows(streamed([order[i : i + 61] for i in range(0, len(order), 61)]), S.job_states, "ts")
    assert {tuple(r) for r in got.collect()} == moves(rows) and got.count() == len(rows) and late == 0


def test_late_rows_are_counted(streamed):
    """A row behind the watermark is left out of moves and frames, and counted."""
    rows = events(200)
    late = [(1, START, 1, "queued", 100.0)]
    batches = [rows[:100], rows[100:150], late + rows[150:]]
    got, n = S.settled_rows(streamed(batches), S.job_states, "ts")
    assert {tuple(r) for r in got.collect()} == moves(rows) and n == 1
    framed, n = S.settled_rows(streamed(batches), lambda s: S.token_frames(s, "ts", "value"), "ts")
    want = {}
    for _, at, _, _, value in rows:
        k, total = want.get(at.replace(minute=0, second=0), (0, 0.0))
        want[at.replace(minute=0, second=0)] = k + 1, total + value
    assert {r.start: (r.tokens, r.total) for r in framed.collect()} == want and n == 1


def test_state_levels_off(spark, streamed):
    """With a time column the ledger forgets: its state doesn't grow with the stream."""
    rows = [(i, START + timedelta(minutes=i), i, "queued", 0.0) for i in range(1500)]
    stream = S.ledger(streamed([rows[i : i + 250] for i in range(0, 1500, 250)]), ["item_id"], "ts")
    at = f"{shared_dir(spark)}/levels-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert spark.read.parquet(f"{at}/out").count() == 1500 and max(sizes) <= 600

"""Queries of the streaming flows, drained over all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.pages import route_pages
from foliospark.plans.registry import register
from foliospark.sources.bridge import STATES, bridged, doc_lines
from foliospark.streaming import flows as S


@register("x1_stream_ledger", "select distinct user_id, event_type from events")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.ledger(S.event_stream(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]))


@register("x2_stream_job_states", bridged("""select item_id, seq, was, state as "to", was is null or (was || '>' || state) in ('queued>running', 'queued>cancelled', 'running>awaiting-input', 'running>paused', 'running>succeeded', 'running>failed', 'running>cancelled',
  'awaiting-input>running', 'awaiting-input>failed', 'awaiting-input>cancelled', 'paused>running', 'paused>cancelled', 'failed>queued') as legal
  from (select *, lag(state) over (partition by item_id order by seq) as was from job_events)"""))
def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES) + 1).cast("int"))
    events = S.event_stream(spark, sf_dir).select(F.col("user_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", state.alias("state"))
    return S.settled_rows(events, S.job_states, "ts")[0]


@register("x3_stream_token_frames", "select date_trunc('hour', ts) as start, count(*) as tokens, round(sum(value), 4) as total from events group by 1")
def stream_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "value")
    return S.settled_rows(events, lambda rows: S.token_frames(rows, "ts", "value"), "ts")[0].withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("x4_stream_page_verdicts", "select event_id, case when value <= 0.5 then 'blank' when value <= 1.5 then 'near' else 'content' end as verdict from events")
def stream_page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of pages as their measures arrive."""
    verdict = F.when(F.col("value") <= 0.5, "blank").when(F.col("value") <= 1.5, "near").otherwise("content")
    return S.drained(S.event_stream(spark, sf_dir).select("event_id", verdict.alias("verdict")))


@register("v3_route_scan_pages", bridged("""select doc_id, page, case when n < 32 then 'SCAN ' || doc_id || '/' || page end as text from (select doc_id, page, sum(length(line)) as n from doc_lines group by all)"""))
def route_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with under 32 characters go to the caller's function, here one that names the page; the others don't."""

    def read(scans: DataFrame) -> DataFrame:
        return scans.select("doc_id", "page", F.concat(F.lit("SCAN "), "doc_id", F.lit("/"), "page").alias("text"))

    pages = doc_lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.length("line")).alias("chars"))
    return route_pages(pages, read)

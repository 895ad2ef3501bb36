"""Queries of the log and job operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import jobs as J
from foliospark.plans.registry import register
from foliospark.sources.bridge import bridged, job_events
from foliospark.tables import table

MOVES = ", ".join(f"('{a}', '{b}')" for a, nexts in J.MOVES.items() for b in nexts)


@register("w13_illegal_transitions", bridged(f"""with e as (select item_id, seq, state, lag(state) over (partition by item_id order by seq) as was from job_events), m(a, b) as (values {MOVES})
select item_id, seq, was, state as "to" from e where was is not null and not exists (select 1 from m where a = was and b = state)"""))
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.illegal_transitions(job_events(spark, sf_dir))


@register("w14_warm_measurement", "select user_id, value as measured from (select *, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 2")
def warm_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.warm_measurement(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


STATUS = "case l_linestatus || l_returnflag when 'ON' then 'saved' when 'OA' then 'saved' when 'FA' then 'dispatched' when 'FN' then 'saved' else case when l_linenumber % 3 = 0 then 'failed' else 'saved' end end"


@register("a14_delivery_overall", f"""with s as (select l_orderkey, {STATUS} as status from lineitem), c as (select l_orderkey, sum((status in ('failed', 'skipped'))::int) as bad, sum((status = 'dispatched')::int) as sent, sum((status = 'saved')::int) as saved from s group by 1)
select l_orderkey, case when bad = 0 and sent = 0 then 'complete' when bad = 0 then 'dispatched' when saved > 0 then 'partial' else 'failed' end as overall from c""")
def delivery_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.delivery_overall(table(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(STATUS).alias("status")), "l_orderkey", "status")


@register("a15_retention_gate", "select source, sum(octet_length(encode(text)))::bigint as total, sum(octet_length(encode(text))) <= 100000 as ok from documents group by source")
def retention_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.octet_length("text"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(total.alias("total"), (total <= 100_000).alias("ok"))


@register("a17_throughput", "select event_type, user_id, round(sum(value) / (count(*) * 0.04), 6) as per_sec, round(min_by(value, event_id), 6) as first from events group by all")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value") / (F.count("*") * 0.04), 6).alias("per_sec"), F.round(F.min_by("value", "event_id"), 6).alias("first"))


SAMPLES = "samples as (select l_suppkey as k, (10 + 20 * (l_linenumber % 4))::int as quality, l_quantity * 1000 + (l_linenumber % 4) * 5000 as bytes from lineitem)"
POINTS = SAMPLES + ", mean as (select k, quality, avg(bytes) as mean from samples group by all), points as (select k, quality, greatest(mean, coalesce(lag(mean) over (partition by k order by quality), mean)) as bytes from mean)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rung = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (10 + 20 * rung).cast("int").alias("quality"), (F.col("l_quantity") * 1000 + rung * 5000).alias("bytes"))


@register("a13_rung_points", f"with {POINTS} select k, quality, round(bytes, 4) as bytes from points")
def rung_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rung_points(samples(spark, sf_dir), ["k"]).withColumn("bytes", F.round("bytes", 4))


@register("w16_pick_setting_under_budget", f"""with {POINTS}, b as (select *, 22000.0 + k * 150 as budget, lag(quality) over (partition by k order by quality) as lq, lag(bytes) over (partition by k order by quality) as lb from points),
hit as (select k, min(quality) as q from b where lq is not null and budget <= bytes group by k), seg as (select b.k, lq + (case when bytes = lb then 1.0 else (budget - lb) / (bytes - lb) end) * (quality - lq) as qat from b join hit on b.k = hit.k and quality = q),
e as (select k, max(budget) as budget, max_by(bytes, quality) as tb, max(quality) as tq, min_by(bytes, quality) as lowb from b group by k)
select e.k, round(case when budget >= tb then tq::double when budget < lowb then 22.0 else greatest(22.0, least(tq::double, qat)) end, 6)::double as quality, budget >= lowb as fits from e left join seg on e.k = seg.k""")
def pick_setting_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pick_setting_under_budget(J.rung_points(samples(spark, sf_dir), ["k"]), ["k"], 22_000.0 + F.col("k") * 150)


@register("w17_corrective_step", """with r as (select o_orderkey, (array[80, 50, 22])[o_orderkey % 3 + 1] as q, o_totalprice / 100000 as ratio from orders), l as (select *, list_filter([80, 50, 22], lambda x: x < q) as lower from r)
select o_orderkey, lower[least(case when ratio > 2.5 then len(lower) when ratio > 1.6 then least(2, len(lower)) else 1 end, len(lower))]::int as quality from l""")
def corrective_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.element_at(F.array(F.lit(80), F.lit(50), F.lit(22)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", J.corrective_step(now, F.col("o_totalprice") / 100_000, [80, 50, 22]).alias("quality"))


@register("w18_size_verdict", "with p as (select l_orderkey, min(l_extendedprice) as size from lineitem where l_linenumber <= 2 group by 1) select l_orderkey, case when size <= 20000 then 'met' when size > 50000 then 'refuse-bigger' else 'best-effort' end as verdict from p")
def size_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    passes = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("size"))
    return passes.select("l_orderkey", J.size_verdict(F.col("size"), F.lit(20_000.0), F.lit(50_000.0)).alias("verdict"))


@register("j18_undelivered", "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')")
def undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(ledger, "o_orderkey", "left_anti")


@register("j17_verify_manifest", "select doc_id, sha256(text) = case when doc_id % 10 = 0 then 'x' else sha256(text) end and length(text) = n_chars as ok from documents")
def verify_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents")
    manifest = files.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.sha2("text", 256)).alias("want"), F.col("n_chars").alias("size"))
    return files.join(manifest, "doc_id", "left").select("doc_id", ((F.sha2("text", 256) == F.col("want")) & (F.length("text") == F.col("size"))).alias("ok"))


@register("j21_resolve_tier", """with b as (select user_id, max_by(value, event_id) as rate from events where event_type = 'click' group by 1), u as (select distinct user_id from events)
select user_id, case when rate is null then case when user_id % 2 = 0 then 'strong' else 'cpu' end when rate >= 60 then 'strong' when rate >= 12 then 'weak' else 'cpu' end as tier, case when rate is null then 'estimate' else 'measured' end as origin from u left join b using (user_id)""")
def resolve_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rate = events.filter("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("rate"))
    guess = F.when(F.col("user_id") % 2 == 0, "strong").otherwise("cpu")
    tier = F.when(F.col("rate").isNull(), guess).when(F.col("rate") >= 60, "strong").when(F.col("rate") >= 12, "weak").otherwise("cpu")
    return events.select("user_id").distinct().join(rate, "user_id", "left").select("user_id", tier.alias("tier"), F.when(F.col("rate").isNull(), "estimate").otherwise("measured").alias("origin"))


FILES = """f as (select page_id, case page_id % 5 when 0 then 'a.heic' when 1 then 'b.pdf' when 2 then 'c.PNG' when 3 then 'd.txt' else 'e.pdf' end as name, length(html) as size, case when page_id % 5 = 1 then '255044462D' else left(hex(encode(html)), 10) end as head from pages)"""


@register("s4_intake_files", f"""with {FILES} select page_id, case when name like '%.heic' then 'refused' when size > 5000 then 'too-large' when name like '%.pdf' then case when head = '255044462D' then 'pdf' else 'not-pdf' end when regexp_matches(lower(name), '\\.(png|jpe?g)$') then 'image' else 'unsupported' end as verdict from f""")
def intake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.sources.files import verdict

    name = F.element_at(F.array(*map(F.lit, ["a.heic", "b.pdf", "c.PNG", "d.txt", "e.pdf"])), (F.col("page_id") % 5 + 1).cast("int"))
    head = F.when(F.col("page_id") % 5 == 1, F.lit("%PDF-").cast("binary")).otherwise(F.substring(F.col("html").cast("binary"), 1, 5))
    return table(spark, sf_dir, "pages").select("page_id", verdict(name, F.length("html"), head, 5000).alias("verdict"))


@register("a19_intake_report", f"""with {FILES} select name, count(*) as n, sum((size <= 5000)::int)::bigint as usable from f group by name""")
def intake_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ["a.heic", "b.pdf", "c.PNG", "d.txt", "e.pdf"])), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(name.alias("name"), F.length("html").alias("size")).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("size") <= 5000).alias("usable"))


@register("s6_intake_folder", """with f as (select source, doc_id, octet_length(encode(text)) as size from documents), t as (select source, sum(size) as total, sum((size = 0)::int) as empty from f group by 1)
select source, doc_id, size::int as size, total::bigint as total, total > 120000 as over_budget from f join t using (source) where size > 0""")
def intake_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("size"))
    totals = files.groupBy("source").agg(F.sum("size").alias("total"))
    return files.filter("size > 0").join(totals, "source").select("source", "doc_id", "size", "total", (F.col("total") > 120_000).alias("over_budget"))


@register("k6_sanitise_entry_name", r"""select page_id, case when trim(regexp_replace(regexp_replace(url, '[\\/]+', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g')) = '' then 'file' else left(trim(regexp_replace(regexp_replace(url, '[\\/]+', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g')), 255) end as name from pages""")
def sanitise_entry_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.functions.text import sanitise_entry_name as clean

    return table(spark, sf_dir, "pages").select("page_id", clean(F.col("url")).alias("name"))


@register("k5_resolve_output_names")
def resolve_output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.sources.files import resolve_names

    names = table(spark, sf_dir, "documents").select(F.col("source").alias("batch"), F.col("doc_id").alias("idx"), F.concat("lang", F.lit("-"), (F.col("doc_id") % 5).cast("string"), F.lit(".pdf")).alias("name"))
    return resolve_names(names)


@register("u9_rename_collisions")
def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.sources.files import resolve_names

    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("batch"), F.col("p_partkey").alias("idx"), F.regexp_replace("p_type", r"\s+", "_").alias("name"))
    return resolve_names(names, "#")

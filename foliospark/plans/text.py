"""Queries of the scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.plans.registry import register
from foliospark.sources.bridge import bridged, doc_lines
from foliospark.tables import table


@register("f3_find_matches", bridged(r"""
select doc_id, line_no, ((length(lower(line)) - length(replace(lower(line), 'the', ''))) / 3)::int as n_hits,
  (instr(lower(line), 'the') - 1)::int as first_at from doc_lines where contains(lower(line), 'the')"""))
def find_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).filter(F.lower("line").contains("the"))
    found = T.find_matches(F.col("line"), "the")
    return lines.select("doc_id", "line_no", T.count_matches(F.col("line"), F.lit("the")).alias("n_hits"), F.get(found, F.lit(0))["start"].alias("first_at"))


@register("f4_collapse_ws", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as clean from documents")
def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_ws(F.col("text")).alias("clean"))


@register("f5_escape_html", r"""select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped,
  md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) as decoded from pages""")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html(html)).alias("escaped"), F.md5(T.decode_entities(html)).alias("decoded"))


@register("f6_escape_pipe", bridged(r"select doc_id, line_no, replace(line, '|', '\|') as escaped from doc_lines where contains(line, '|')"))
def escape_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).filter(F.col("line").contains("|")).select("doc_id", "line_no", T.escape_pipe(F.col("line")).alias("escaped"))


@register("f7_safe_href", r"""select page_id, i::int as link_no, case when regexp_matches(href, '^(https?://|mailto:|#)', 'i') then href end as safe from (
  select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 as i from pages)""")
def safe_href(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link_no", "href"))
    return links.select("page_id", "link_no", T.safe_href(F.col("href")).alias("safe"))


@register("f8_math_safe", bridged(r"""
select doc_id, line_no, length(line) between 1 and 500 as safe, len(regexp_extract_all(line, '(\$\$[^$\n]+\$\$|\$[^\s$](?:[^$\n]*[^\s$])?\$)', 1))::int as n_formulas
from doc_lines where not contains(line, '{')"""))
def math_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).filter(~F.col("line").contains("{"))
    return lines.select("doc_id", "line_no", T.math_safe(F.col("line")).alias("safe"), F.size(T.math_segments(F.col("line"))).alias("n_formulas"))


@register("f9_inline_format", bridged(r"""select doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g'),
  '(^|[^0-9A-Za-z_])\*([^*\n]+)\*', '\1<em>\2</em>', 'g'), '`([^`]+)`', '<code>\1</code>', 'g') as html from doc_lines where contains(line, '*') or contains(line, '`')"""))
def inline_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = doc_lines(spark, sf_dir).filter(F.col("line").contains("*") | F.col("line").contains("`"))
    return lines.select("doc_id", "line_no", T.inline_format(F.col("line")).alias("html"))


@register("f10_classify_block", bridged(r"""
select doc_id, line_no, case when regexp_matches(trim(line), '^\|.+\|$') then 'table' when length(trim(line)) = 0 then 'blank'
  when regexp_matches(trim(line), '^#{1,6}\s+') then 'h' || least(length(regexp_extract(trim(line), '^(#{1,6})\s', 1)), 4)
  when regexp_matches(trim(line), '^[-*]\s+') then 'bullet' when regexp_matches(trim(line), '^\d+[.)]\s+') then 'ordered' else 'paragraph' end as kind,
  least(4, floor(length(replace(regexp_extract(line, '^([ \t]*)', 1), chr(9), '    ')) / 2))::int as level
from doc_lines"""))
def classify_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", T.classify_block(F.col("line")).alias("kind"), T.list_level(F.col("line")).alias("level"))


@register("f11_clean_inline", bridged(r"""
select doc_id, string_agg(clean, chr(10) order by line_no) as reading from (
  select doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(line, '\*\*([^*]+)\*\*', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '^\s*(#{1,6}|[-*]|\d+[.)])\s+', '')) as clean from doc_lines)
where clean != '' group by doc_id"""))
def clean_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.filter(F.transform(F.split("text", "\n"), T.clean_inline), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(shown, "\n").alias("reading")).filter("reading != ''")


@register("f14_try_number", r"""
with cells as (select c_custkey as id, 'acctbal' as col, c_acctbal::varchar as cell from customer union all select c_custkey, 'name', c_name from customer
  union all select o_orderkey, 'date', o_orderdate::varchar from orders union all select p_partkey, 'size', p_size::varchar from part),
t as (select *, replace(trim(cell), ',', '.') as n from cells)
select id, col, case when ok then try_cast(n as double) end as value, case when ok then length(regexp_replace(regexp_replace(n, '[-+.eE].*$', ''), '^0+', '')) > 15 end as risk
from (select *, regexp_matches(trim(cell), '^[-+]?(\d+([.,]\d+)?|\.\d+)([eE][-+]?\d+)?$') and not regexp_matches(n, '^[-+]?0\d') as ok from t)""")
def try_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = T.try_number(F.col("cell"))
    return typed_cells(spark, sf_dir).select("id", "col", got["value"].alias("value"), got["risk"].alias("risk"))


def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the business tables as text: id, col, cell."""
    def of(name: str, key: str, col: str, source: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.col(key).alias("id"), F.lit(col).alias("col"), F.col(source).cast("string").alias("cell"))

    parts = of("customer", "c_custkey", "acctbal", "c_acctbal"), of("customer", "c_custkey", "name", "c_name"), of("orders", "o_orderkey", "date", "o_orderdate"), of("part", "p_partkey", "size", "p_size")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("f15_try_iso_date", r"select o_orderkey, make_date(year(o_orderdate::date + interval 40 day)::int, 1, 1) as first_day, o_orderdate::date as d from orders")
def try_iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    later = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 40), "yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.try_iso_date(F.concat(later, F.lit("-01-01"))).alias("first_day"), T.try_iso_date(day).alias("d"))


@register("f16_format_date_vi", "select o_orderkey, strftime(o_orderdate::date, '%d/%m/%Y') as shown from orders")
def format_date_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_date_vi(F.col("o_orderdate").cast("date")).alias("shown"))


@register("f17_basename_sans_ext", r"select page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '\.[^.]+$', '') as base from pages")
def basename_sans_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.basename_sans_ext(F.col("url")).alias("base"))


@register("f18_render_template", bridged(r"""
select p.doc_id, page, 'Page ' || (page + 4)::varchar || '/' || n::varchar || ' of ' || source || ' on 01/02/2024 {x}' as label
from doc_pages p join (select doc_id, source, (len(string_split(text, chr(10))) + 7) // 8 as n from documents) d using (doc_id)"""))
def render_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.ceil(F.size(F.split("text", "\n")) / 8).cast("int").alias("n"))
    pages = docs.withColumn("page", F.explode(F.sequence(F.lit(1), "n")))
    label = T.render_template(F.lit("Page {n}/{total} of {filename} on {date} {x}"), F.col("page") + 5 - 1, F.col("n"), F.lit("01/02/2024"), F.concat(F.lit("in/"), "source", F.lit(".pdf")))
    return pages.select("doc_id", "page", label.alias("label"))


@register("f19_name_error", bridged(r"""
select doc_id, line_no, case when length(line) = 0 then 'empty' when line in ('.', '..') then 'reserved' when regexp_matches(line, '^([a-zA-Z]:|[/\\])') then 'absolute'
  when regexp_matches(line, '[/\\]') then 'separator' when regexp_matches(line, '[\x00-\x1f\x7f]') then 'control' when regexp_matches(line, '[<>:"|?*]') then 'invalid-char'
  when regexp_matches(regexp_replace(line, '\.[^.]*$', ''), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$', 'i') then 'reserved'
  when regexp_matches(line, '[. ]$') then 'trailing-dot-space' when length(line) > 240 then 'too-long' end as error from doc_lines"""))
def name_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", T.name_error(F.col("line")).alias("error"))


@register("f20_neutralise_formula", r"""
with cells as (select c_custkey as id, c_acctbal::varchar as cell from customer union all select c_custkey, c_name from customer union all select -s_suppkey, s_acctbal::varchar from supplier
  union all select -1000000 - doc_id, text from documents)
select id, case when cell[1] in ('=', '+', '-', '@', chr(9), chr(13), '＝', '＋', '－', '＠', '　') then '''' || cell else regexp_replace(cell, '[\x00-\x08\x0b-\x1f]', '', 'g') end as safe from cells""")
def neutralise_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.col("c_acctbal").cast("string"), "c_name")).alias("cell"))
    cells = cells.unionByName(table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_acctbal").cast("string").alias("cell")))
    cells = cells.unionByName(table(spark, sf_dir, "documents").select((F.lit(-1_000_000) - F.col("doc_id")).alias("id"), F.col("text").alias("cell")))
    return cells.select("id", T.neutralise_formula(F.col("cell")).alias("safe"))


@register("f21_quote_field", r"""select doc_id, md5(case when contains(text, '"') or contains(text, chr(10)) or contains(text, chr(13)) or contains(text, ',') then '"' || replace(text, '"', '""') || '"' else text end) as field from documents""")
def quote_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.quote_field(F.col("text"))).alias("field"))


@register("f22_sanitise_diagnostics", r"""select page_id, nullif(substring(trim(regexp_replace(regexp_replace('tool: warn ' || url || ' in /tmp/' || page_id || '.pdf', '^[^:]+: ', ''), '/tmp/[^ :)]+', '<tmp>', 'g')), 1, 160), '') as line from pages""")
def sanitise_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.concat(F.lit("tool: warn "), "url", F.lit(" in /tmp/"), F.col("page_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", T.sanitise_diagnostics(log).alias("line"))


@register("f23_json_option_gate", r"""select event_id, case when props is null or json_type(props) != 'OBJECT' then 'object' when length(props) > 50000 then 'size'
  when regexp_matches(props, '"(__proto__|constructor|prototype)"\s*:') then 'prototype'
  when len(list_filter(json_keys(props), lambda k: regexp_matches(k, 'password|secret|token|key material|privatekey|apikey|api_key', 'i'))) > 0 then 'secret' end as refusal from events""")
def json_option_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.json_option_gate(F.col("props")).alias("refusal"))


@register("f25_grey601", bridged(r"select doc_id, page, x, y, round(0.299::double * grey + 0.587::double * grey + 0.114::double * grey, 6) as luma from grid_pixels where y = 0"))
def grey601(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.sources.bridge import grid_pixels

    g = F.col("grey").cast("double")
    return grid_pixels(spark, sf_dir).filter("y = 0").select("doc_id", "page", "x", "y", F.round(T.compare_grey(g, g, g, F.lit(255.0)), 6).alias("luma"))


@register("f26_lang_code_ok", r"select doc_id, regexp_matches(lang || '_X1', '^[a-z]{2,3}(_[A-Za-z0-9]{1,8})?$') and regexp_matches(source, '^[a-z]{2,3}(_[A-Za-z0-9]{1,8})?$') as ok from documents")
def lang_code_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.lang_code_ok(F.concat("lang", F.lit("_X1+"), "source")).alias("ok"))


@register("f27_format_bytes", r"""
with b as (select doc_id, n_chars * n_chars as n from documents)
select doc_id, case when n < 1024 then n || ' B' else regexp_replace(printf('%.1f', case when n < 1048576 then n / 1024 when n < 1073741824 then n / 1048576 else n / 1073741824 end), '\.0$', '')
  || case when n < 1048576 then ' KB' when n < 1073741824 then ' MB' else ' GB' end end as shown from b""")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(T.format_bytes(F.col("n_chars") * F.col("n_chars")), F.lit(","), F.lit("")).alias("shown"))


@register("l3_search_rank", r"""
with q as (select c_custkey, c_name, c_mktsegment, strip_accents(lower(c_name)) as name, strip_accents(lower(c_mktsegment)) as descr from customer),
s as (select c_custkey, case when name = 'customer#000000001' then 100 when starts_with(name, 'customer#00000001') then 90 when contains(name, '00000001') then 70 when contains(descr, '00000001') then 25 else 0 end as score from q)
select c_custkey, score::int as score from s where score > 0 order by score desc, c_custkey limit 20""")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.operators.jobs import search_rank as rank

    docs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("descr"))
    return rank(docs, "c_custkey", [("=", "customer#000000001", 100), ("^", "customer#00000001", 90), ("~", "00000001", 70)], "00000001", 20)


@register("l7_natural_name_sort", r"""select page_id, row_number() over (order by a, b, c, page_id) as pos from (
  select page_id, lower(regexp_extract(url, '^(.*?)(\d+)', 1)) as a, try_cast(regexp_extract(url, '^(.*?)(\d+)', 2) as bigint) as b, lower(url) as c from pages)""")
def natural_name_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.operators.jobs import numbered

    split = table(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.regexp_extract("url", r"^(.*?)(\d+)", 1)).alias("a"), F.regexp_extract("url", r"^(.*?)(\d+)", 2).try_cast("bigint").alias("b"), F.lower("url").alias("c")
    )
    return numbered(split, ["a", "b", "c", "page_id"], "pos").select("page_id", "pos")


@register("l4_first_examples", r"""
with t as (select c_custkey, c_acctbal::varchar as cell, row_number() over (partition by c_nationkey order by c_custkey) as rn, c_nationkey from customer where c_acctbal < 0)
select c_nationkey, c_custkey, '''' || cell as example, rn::int as rn from t where rn <= 5""")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.operators.jobs import first_k

    cells = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("string").alias("cell")).withColumn("example", T.neutralise_formula(F.col("cell"))).filter("example != cell")
    return first_k(cells, ["c_nationkey"], ["c_custkey"], 5).select("c_nationkey", "c_custkey", "example", "rn")


@register("u7_distinct_in_order", bridged(r"select doc_id, line, min(line_no) as first_no from doc_lines where trim(line) != '' group by doc_id, line"))
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.operators.jobs import distinct_in_order as distinct

    return distinct(doc_lines(spark, sf_dir).filter("trim(line) != ''"), ["doc_id", "line"], "line_no").select("doc_id", "line", F.col("first_at").alias("first_no"))


@register("p18_parse_secrets", r"""
select doc_id, list_sort(list_distinct(list_filter(list_transform(string_split_regex(text, '[\n,;]+'), lambda s: trim(s)), lambda s: s != ''))) as secrets from documents""")
def parse_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", r"[\n,;]+"), lambda s: F.trim(s)), lambda s: s != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(parts)).alias("secrets"))


@register("f1_fold_text", bridged("select doc_id, line_no, lower(strip_accents(line)) as folded from doc_lines"))
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.functions.unicode import fold_text as fold

    return doc_lines(spark, sf_dir).select("doc_id", "line_no", fold(F.col("line")).alias("folded"))


@register("f2_nfkc", bridged("select doc_id, line_no, nfc_normalize(line) as normal from doc_lines"))
def nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.functions.unicode import nfkc as normal

    return doc_lines(spark, sf_dir).select("doc_id", "line_no", normal(F.col("line")).alias("normal"))

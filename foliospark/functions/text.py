"""Scalar functions on strings: Column in, Column out, all inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.common import let

#: What a formula starts with in spreadsheets, in ASCII and full width.
DANGEROUS = ["=", "+", "-", "@", "\t", "\r", "＝", "＋", "－", "＠", "　"]
#: Names that a file system reserves.
RESERVED_NAME = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
INVALID_CHARS = r'[<>:"|?*]'
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def swap(c: Column, *pairs: tuple[str, str]) -> Column:
    """Replacements one after another."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def count_matches(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences without regard to case; 0 for an empty needle."""
    hay, key = F.lower(text), F.lower(needle)
    return F.when(F.length(key) > 0, ((F.length(hay) - F.length(F.replace(hay, key, F.lit("")))) / F.length(key)).cast("int")).otherwise(0)


def find_matches(text: Column, needle: str) -> Column:
    """array<struct<start,end>> of non-overlapping occurrences in lower-cased text, leftmost first."""
    key = needle.lower()
    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at"))

    def step(acc: Column, part: Column) -> Column:
        at = acc["at"] + F.length(part)
        return F.struct(F.concat(acc["found"], F.array(at)).alias("found"), (at + len(key)).alias("at"))

    parts = F.split(F.lower(text), r"\Q" + key + r"\E")
    found = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step, lambda acc: acc["found"])
    return F.transform(found, lambda s: F.struct(s.alias("start"), (s + len(key)).alias("end")))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def escape_html(c: Column) -> Column:
    return swap(c, *ENTITIES)


def decode_entities(c: Column) -> Column:
    return swap(c, *[(e, ch) for ch, e in ENTITIES[1:]], ("&amp;", "&"))


def escape_pipe(c: Column) -> Column:
    return swap(c, ("|", "\\|"))


def unescape_pipe(c: Column) -> Column:
    return swap(c, ("\\|", "|"))


def split_cells(row: Column) -> Column:
    """Cells of a pipe row: split at pipes that no backslash stands before, trimmed, unescaped."""
    inner = F.substring(F.trim(row), F.lit(2), F.greatest(F.length(F.trim(row)) - 2, F.lit(0)))
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: unescape_pipe(F.trim(c)))


def is_pipe_row(line: Column) -> Column:
    return F.trim(line).rlike(r"^\|.+\|$")


def is_separator(cells: Column) -> Column:
    return F.forall(cells, lambda c: c.rlike(r"^:?-+:?$"))


def safe_href(c: Column) -> Column:
    """The link where its scheme may be shown, else null."""
    return F.when(c.rlike(r"(?i)^(https?://|mailto:|#)"), c)


def math_safe(c: Column) -> Column:
    """Between 1 and 500 characters with braces at most ten deep."""
    depths = F.aggregate(
        F.split(c, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")),
        lambda acc, ch: let(
            F.when(ch == "{", acc["depth"] + 1).when(ch == "}", F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"]),
            lambda d: F.struct(d.alias("depth"), F.greatest(acc["most"], d).alias("most")),
        ),
        lambda acc: acc["most"],
    )
    return (F.length(c) > 0) & (F.length(c) <= 500) & (depths <= 10)


def math_segments(c: Column) -> Column:
    """Formulas between $$ and $$, or between single $ without spaces at the inner edges."""
    return F.regexp_extract_all(c, F.lit(r"(\$\$[^$\n]+\$\$|\$[^\s$](?:[^$\n]*[^\s$])?\$)"), F.lit(1))


def inline_format(c: Column) -> Column:
    """Bold, italic and code of an escaped line as tags."""
    c = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"(^|\W)\*([^*\n]+)\*", "$1<em>$2</em>")
    c = F.regexp_replace(c, r"`([^`]+)`", "<code>$1</code>")
    return F.regexp_replace(c, r"\[([^\]]+)\]\(((?:(?i)https?://|mailto:|#)[^)\s]*)\)", '<a href="$2" rel="noopener noreferrer" target="_blank">$1</a>')


def classify_block(line: Column) -> Column:
    """Class of a line of markdown: table row, separator, heading, bullet, ordered, blank or paragraph."""
    t = F.trim(line)
    return (
        F.when(is_pipe_row(t) & is_separator(split_cells(t)), "separator")
        .when(is_pipe_row(t), "table")
        .when(F.length(t) == 0, "blank")
        .when(t.rlike(r"^#{1,6}\s+"), F.concat(F.lit("h"), F.least(F.length(F.regexp_extract(t, r"^(#{1,6})\s", 1)), F.lit(4)).cast("string")))
        .when(t.rlike(r"^[-*]\s+"), "bullet")
        .when(t.rlike(r"^\d+[.)]\s+"), "ordered")
        .otherwise("paragraph")
    )


def list_level(line: Column) -> Column:
    """Nesting of a list item: two spaces a level, a tab is four, four levels at most."""
    indent = F.length(F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))
    return F.least(F.lit(4), F.floor(indent / 2)).cast("int")


def clean_inline(c: Column) -> Column:
    """Markdown's inline marks taken out."""
    c = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "$1")
    c = F.regexp_replace(c, r"`([^`]+)`", "$1")
    return F.trim(F.regexp_replace(c, r"^\s*(#{1,6}|[-*]|\d+[.)])\s+", ""))


def try_number(c: Column) -> Column:
    """struct<value,risk>: a plain decimal number, or null; ids with leading zeros stay text."""
    t = F.replace(F.trim(c), F.lit(","), F.lit("."))
    ok = F.trim(c).rlike(r"^[-+]?(\d+([.,]\d+)?|\.\d+)([eE][-+]?\d+)?$") & ~t.rlike(r"^[-+]?0\d")
    digits = F.length(F.regexp_replace(F.regexp_replace(t, r"[-+.eE].*$", ""), r"^0+", ""))
    value = F.expr("1") * 0 + t.try_cast("double")
    return F.when(ok & value.isNotNull(), F.struct(value.alias("value"), (digits > 15).alias("risk")))


def try_iso_date(c: Column) -> Column:
    """A date of the form YYYY-MM-DD; days and months beyond their ends roll over."""
    part = lambda i: F.regexp_extract(F.trim(c), r"^(\d{4})-(\d{2})-(\d{2})$", i)
    first = F.make_date(part(1).try_cast("int"), F.lit(1), F.lit(1))
    month = F.add_months(first, part(2).try_cast("int") - 1)
    return F.when(part(1) != "", F.date_add(month, part(3).try_cast("int") - 1))


def format_date_vi(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def basename_sans_ext(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.coalesce(c, F.lit("")), r"[\\/]"), -1), r"\.[^.]+$", "")


def render_template(template: Column, n: Column, total: Column, date: Column, filename: Column) -> Column:
    """Known tokens filled in, others left."""
    for token, value in (("{n}", n.cast("string")), ("{total}", total.cast("string")), ("{date}", date), ("{filename}", basename_sans_ext(filename))):
        template = F.replace(template, F.lit(token), value)
    return template


def name_error(c: Column) -> Column:
    """The first rule that an output name breaks, or null."""
    stem = F.regexp_replace(c, r"\.[^.]*$", "")
    return (
        F.when(F.length(c) == 0, "empty")
        .when(c.isin(".", ".."), "reserved")
        .when(c.rlike(r"^([a-zA-Z]:|[/\\])"), "absolute")
        .when(c.rlike(r"[/\\]"), "separator")
        .when(c.rlike(r"[\x00-\x1f\x7f]"), "control")
        .when(c.rlike(INVALID_CHARS), "invalid-char")
        .when(stem.rlike(RESERVED_NAME), "reserved")
        .when(c.rlike(r"[. ]$"), "trailing-dot-space")
        .when(F.length(c) > 240, "too-long")
    )


def sanitise_entry_name(c: Column) -> Column:
    """Separators as spaces, no control characters, at most 255 bytes of ASCII names; `file` if nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\\/]+", " "), r"[\x00-\x1f\x7f-\x9f]", ""))
    base = F.when(F.length(clean) > 0, clean).otherwise("file")
    # the longest head that fits: heads grow in bytes, so the first that is too long ends the search
    fits = F.filter(F.sequence(F.least(F.length(base), F.lit(255)), F.greatest(F.least(F.length(base), F.lit(63)), F.lit(1)), F.lit(-1)), lambda n: F.octet_length(F.substring(base, F.lit(1), n)) <= 255)
    return F.when(F.octet_length(base) <= 255, base).otherwise(F.substring(base, F.lit(1), F.get(fits, F.lit(0))))


def neutralise_formula(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula; control characters go from the rest."""
    risky = F.substring(c, 1, 1).isin(*DANGEROUS)
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", ""))


def quote_field(c: Column, delimiter: str = ",", quote_all: bool = False) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    if quote_all:
        return quoted
    needs = c.contains('"') | c.contains("\n") | c.contains("\r") | c.contains(delimiter)
    return F.when(needs, quoted).otherwise(c)


def sanitise_diagnostics(c: Column) -> Column:
    """A log line without program name and temporary paths, 160 characters at most; null if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(c, r"^[^:]+: ", ""), r"/tmp/[^ :)]+", "<tmp>")
    return F.nullif(F.substring(F.trim(c), 1, 160), F.lit(""))


def json_option_gate(c: Column) -> Column:
    """Why an option bag is refused, or null."""
    keys = F.json_object_keys(c)
    return (
        F.when(keys.isNull(), "object")
        .when(F.length(c) > 50_000, "size")
        .when(c.rlike(r'"(__proto__|constructor|prototype)"\s*:'), "prototype")
        .when(F.exists(keys, lambda k: k.rlike(r"(?i)password|secret|token|key material|privatekey|apikey|api_key")), "secret")
    )


def lang_code_ok(c: Column) -> Column:
    return F.forall(F.split(c, r"\+"), lambda p: p.rlike(r"^[a-z]{2,3}(_[A-Za-z0-9]{1,8})?$"))


def format_bytes(c: Column) -> Column:
    """Bytes in steps of 1024 with one digit at most."""
    steps = F.when(c < 1024**2, F.struct((c / 1024).alias("v"), F.lit("KB").alias("u"))).when(c < 1024**3, F.struct((c / 1024**2).alias("v"), F.lit("MB").alias("u")))
    at = steps.otherwise(F.struct((c / 1024**3).alias("v"), F.lit("GB").alias("u")))
    shown = F.regexp_replace(F.format_number(at["v"], 1), r"\.0$", "")
    return F.when(c.isNull() | F.isnan(c.cast("double")) | (c < 0), "0 B").when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).otherwise(F.concat(shown, F.lit(" "), at["u"]))


def natural_key(c: Column) -> Column:
    """Sort key of names without regard to case, digits by value."""
    padded = F.regexp_replace(F.regexp_replace(F.lower(c), r"(\d+)", "000000000000$1"), r"0*(\d{12})(?!\d)", "$1")
    return padded


def compare_grey(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Rec.601 grey over white."""
    k = a / 255
    over = lambda v: v * k + 255 * (1 - k)
    return 0.299 * over(r) + 0.587 * over(g) + 0.114 * over(b)

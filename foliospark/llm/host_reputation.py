"""URL filter by empirical-Bayes host reputation.

Outcomes of labelled pages are counted by host. A host's rate of bad pages is
shrunk to that of its registered domain, the domain's to that of its public
suffix, the suffix's to the rate of all pages, each by a beta prior whose
strength is fitted to the spread of the rates at that level (method of
moments). A host is blocked when the lower bound of its posterior rate is above
max_bad: few labels never block a host. Rules go before the method.

Counts are partially aggregated before they are shuffled, so a host with a
third of all pages costs no more than another. The table of hosts is stored
once; its posteriors are broadcast to the pages where they are few, else Spark
joins both sides by host and splits the partition of a hot one.

Defined cases
  null url or no ://      empty host and path; judged by the rate of the empty host
  null label              not an outcome
  very long url           judged whole
  user, port, final dot   part of the host, not of its domain and suffix
  host that is a suffix   its own domain
  repeated labels         a page is bad if one of its labels is
  repeated pages, ties    each row is judged; each counts as an outcome of its host
  unlabelled host         its domain's, suffix's or the overall posterior
  empty tables            no rows, or every page allowed
  clashing columns        a column of the input with the name of an output column is replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import ascii_lower, small, stored

#: (rule, verdict): host and path prefix.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Second-level labels under which countries register names.
SECOND_LEVEL = ["ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch"]
#: Further suffixes under which anybody gets a name. The whole public list may be given in its place.
SUFFIXES = [
    "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io",
    "herokuapp.com", "id.au", "me.uk", "netlify.app", "pages.dev", "readthedocs.io", "vercel.app", "web.app", "workers.dev",
]
OUT = ["host", "path", "rule", "verdict", "domain", "suffix", "bad_rate", "bad_bound"]
#: The prior's strength lies between these, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@|:[0-9]*\z", ""), r"\.+\z", "")


def suffix_of(name: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The public suffix: the longest that is stated, else two labels as in co.uk, else the last label; empty for an address.

    suffixes are in the form of the public list: `io`, `*.ck` for all names below one, `!www.ck` for what isn't a suffix
    all the same. They become sets within the expression; no table of hosts is joined with them.
    """
    plain = [x for x in suffixes if x[0] not in "*!"]
    below, never = [x[2:] for x in suffixes if x[0] == "*"], [x[1:] for x in suffixes if x[0] == "!"]
    longest = max((x.count(".") + 1 for x in suffixes), default=1)
    two = rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})\z"
    found = F.when(name.rlike(two), F.regexp_extract(name, two, 1)).otherwise(F.regexp_extract(name, r"([^.]*)\z", 1))
    labels = F.size(F.split(name, r"\."))
    for n in range(1, longest + 1):
        tail, rest = F.substring_index(name, ".", -n), F.substring_index(name, ".", 1 - n)
        stated = tail.isin(*plain) | (rest.isin(*below) if n > 1 else F.lit(False))
        found = F.when((labels >= n) & stated, tail).otherwise(found)
    for n in range(2, longest + 1) if never else ():
        found = F.when((labels >= n) & F.substring_index(name, ".", -n).isin(*never), F.substring_index(name, ".", 1 - n)).otherwise(found)
    return F.when(name.rlike(r"^[0-9.:\[\]]+\z") | name.startswith("["), F.lit("")).otherwise(found)


def domain_of(name: Column, suffix: Column) -> Column:
    """The registered domain: one label more than the suffix; an address is its own."""
    parts, labels = F.split(name, r"\."), F.size(F.split(suffix, r"\.")) + 1
    return F.when(suffix == "", name).otherwise(F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    found, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        found, says = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(verdict)).otherwise(says)
    return found, says


def strength(units: DataFrame) -> DataFrame:
    """One row: the rate over all units and the strength of the beta prior their rates come from. units has n and bad."""
    rate = F.col("bad") / F.col("n")
    total = units.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * rate * rate).alias("sq"), F.count("*").alias("units"))
    p = F.col("bad") / F.col("n")
    spread = F.greatest(F.col("sq") / F.col("n") - p * p, F.lit(0.0))
    noise = p * (1 - p) * F.col("units") / F.col("n")
    fitted = F.when(spread > noise, (p * (1 - p) - spread) / (spread - noise)).otherwise(F.lit(STRONGEST))
    return total.select(F.coalesce(p, F.lit(0.0)).alias("rate"), F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.coalesce(fitted, F.lit(STRONGEST)))).alias("m"))


def reputations(hosts: DataFrame, z: float) -> DataFrame:
    """(_host, bad_rate, bad_bound) for each host, from (host, domain, suffix, n, bad)."""
    count = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes, domains = hosts.groupBy("suffix").agg(*count), hosts.groupBy("suffix", "domain").agg(*count)
    seen = F.col("n") > 0
    top = strength(suffixes.filter(seen)).select(F.col("rate").alias("r0"), F.col("m").alias("m0"))
    mid = strength(domains.filter(seen)).select(F.col("m").alias("m1"))
    low = strength(hosts.filter(seen)).select(F.col("m").alias("m2"))
    one = top.crossJoin(mid).crossJoin(low)  # three single rows
    suffixes = suffixes.crossJoin(F.broadcast(one)).withColumn("rs", (F.col("bad") + F.col("m0") * F.col("r0")) / (F.col("n") + F.col("m0")))
    domains = domains.join(suffixes.select("suffix", "rs", "m1", "m2"), "suffix").withColumn("rd", (F.col("bad") + F.col("m1") * F.col("rs")) / (F.col("n") + F.col("m1")))
    a = F.col("bad") + F.col("m2") * F.col("rd")
    size = F.col("n") + F.col("m2")
    mean = a / size
    bound = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (size + 1)))
    return hosts.join(domains.select("domain", "suffix", "rd", "m2"), ["domain", "suffix"]).select(
        F.col("host").alias("_host"), F.round(mean, 6).alias("bad_rate"), F.round(bound, 6).alias("bad_bound")
    )


def host_reputation(
    pages: DataFrame, labels: DataFrame, url: str = "url", page: str = "page_id", label_id: str = "doc_id", bad: str = "toxic",
    rules: list[tuple[str, str]] = RULES, max_bad: float = 0.5, z: float = 1.645, suffixes: list[str] = SUFFIXES,
) -> DataFrame:
    """pages with the columns OUT; a page is filtered when its verdict is block."""
    pages = pages.drop(*[c for c in pages.columns if c.lower() in OUT])
    split = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    split = split.withColumn("suffix", suffix_of(name_of(F.col("host")), suffixes))
    split = split.withColumn("domain", domain_of(name_of(F.col("host")), F.col("suffix")))

    outcome = labels.filter(F.col(bad).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max((F.col(bad) > 0).cast("long")).alias("_bad"))
    seen = split.select(F.col(page).alias("_page"), "host", "domain", "suffix").join(outcome, F.col("_page") == F.col("_id"), "left")
    hosts = seen.groupBy("host", "domain", "suffix").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    hosts = stored(hosts, "hosts")  # six aggregates read it
    known = small(stored(reputations(hosts, z), "reputations"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = split.join(known, F.col("host") == F.col("_host"), "left").drop("_host")
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(says, F.when(F.col("bad_bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))))

"""URL filters by empirical-Bayes host reputation, with explicit rules before it.

Page outcomes (bad or not) are counted per host, registered domain and suffix; where none are given, each page's own
signs decide: names in its url, and in its html a large share of junk signs, of shouted words, of repeated paragraphs or
of links. So the pages of one host may differ, and shrinking says what a host's few pages are worth. A suffix's rate is shrunk to the
rate of all pages, a domain's to its suffix's, a host's to its domain's; the strength of each beta prior comes from the
spread between the groups of its level (method of moments). A host is blocked if the lower bound of its posterior rate
is above the threshold. An explicit rule (host and path prefix) decides before that; the longest rule that fits wins.

Defined results: null url or one without ``://`` has empty host and path, fits no rule and is allowed unless the
reputation of the empty host says otherwise; ports and user names stay part of the host, but a port is no part of its
domain; null html has no sign; repeated rows are judged one by one; a null outcome isn't counted; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path prefix); a short list that the caller writes, compiled into one expression.
RULES = [
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
]
#: Names between dots, slashes and hyphens of a url that stand for a bad page.
SEED_NAMES = ["adult", "bets", "casino", "escort", "gamble", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx"]
#: Suffixes of several labels under which domains are registered; the caller may give the whole list. Any other is one label.
SUFFIXES = [
    "ac.jp", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg",
    "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ltd.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk", "pref.tokyo.jp",
]
#: Shares from which a sign makes a page bad: junk signs, shouted words and links by words, repeated by all paragraphs.
JUNK, SHOUTED, LINKS, REPEATED = 0.2, 0.2, 0.5, 0.5
Z, THRESHOLD = 1.645, 0.5
LEAST_STRENGTH, MOST_STRENGTH = 0.5, 1000.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_labels(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """How many labels the host's suffix has; the longest suffix that fits counts."""
    found = F.lit(1)
    for n in sorted({x.count(".") + 1 for x in suffixes}):
        found = F.when(F.substring_index(host, ".", -n).isin(*[x for x in suffixes if x.count(".") + 1 == n]), n).otherwise(found)
    return found


def _without_port(host: Column) -> Column:
    return F.regexp_replace(host, r":\d*$", "")


def domain_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The suffix and the label before it; a host of fewer labels is its own domain."""
    bare = _without_port(host)
    return F.array_join(_last(bare, suffix_labels(bare, suffixes) + 1), ".")


def suffix_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    bare = _without_port(host)
    return F.array_join(_last(bare, suffix_labels(bare, suffixes)), ".")


def _last(host: Column, n: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.slice(labels, F.greatest(F.size(labels) - n, F.lit(0)) + 1, n)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits as (length, rule, verdict), else null."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")

    def one(verdict: str, rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        return F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    found = [one(*r) for r in rules]
    return F.greatest(*found) if len(found) > 1 else found[0]


def page_outcomes(url: Column, html: Column, names: list[str] = SEED_NAMES) -> Column:
    """1 for a bad page by its own signs, else 0."""
    named = F.regexp_like(F.lower(url), F.lit(rf"[./-]({'|'.join(names)})([./-]|$)"))
    said = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    words = F.greatest(F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1))
    junk = F.regexp_count(said, F.lit(r"[%#*$]{3}|(&amp;){3}")) / words
    shouted = F.regexp_count(said, F.lit("!!")) / words
    links = F.regexp_count(html, F.lit(r"<a[\s>]")) / words
    parts = F.regexp_extract_all(html, F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    repeated = 1 - F.size(F.array_distinct(parts)) / F.greatest(F.size(parts), F.lit(1))
    bad = (junk >= JUNK) | (shouted >= SHOUTED) | (links >= LINKS) | ((F.size(parts) > 0) & (repeated >= REPEATED))
    return (F.coalesce(named, F.lit(False)) | F.coalesce(bad, F.lit(False))).cast("int")


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the beta prior's strength for groups (n, bad), and their common rate."""
    sums = groups.agg(F.sum("n").alias("N"), F.sum("bad").alias("B"), F.count(F.lit(1)).alias("G"), F.sum(F.col("n") * F.col("n")).alias("Q"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("R"))
    rate = F.coalesce(F.col("B") / F.col("N"), F.lit(0.0))
    noise = rate * (1 - rate)
    spread = F.col("R") - F.col("N") * rate * rate - noise * (F.col("G") - 1)
    most = noise * (F.col("N") - F.col("Q") / F.col("N") - (F.col("G") - 1))
    rho = spread / most
    strength = F.when((most > 0) & (rho > 0), F.least(F.greatest(1 / rho - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))).otherwise(MOST_STRENGTH)
    return sums.select(rate.alias("rate"), strength.alias("strength"))


def reputations(outcomes: DataFrame, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """outcomes (host, bad) -> one row per host: host, domain, n, mean, lower, blocked.

    Pages are counted per host before any join (pre-aggregated, so a hot host costs one row per task); the levels above
    are sums over hosts. The priors are single rows.
    """
    bad = F.when(F.col("bad") > 0, 1).otherwise(0)
    hosts = outcomes.filter("bad IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(bad).cast("double").alias("bad"))
    hosts = hosts.select("*", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    # Priors are single rows, so their broadcasts are; the key is a constant.
    one = F.lit(1).alias("one")
    prior = {name: _strength(groups).select(one, F.col("rate").alias(f"{name}_rate"), F.col("strength").alias(f"{name}_k")) for name, groups in (("s", suffixes), ("d", domains), ("h", hosts))}
    priors = prior["s"].join(F.broadcast(prior["d"]), "one").join(F.broadcast(prior["h"]), "one")

    def shrunk(above: str, k: str) -> Column:
        return (F.col("bad") + F.col(k) * F.col(above)) / (F.col("n") + F.col(k))

    suffixes = suffixes.select("*", one).join(F.broadcast(priors), "one")
    suffixes = suffixes.select("suffix", shrunk("s_rate", "s_k").alias("s_mean"), "d_k", "h_k")
    domains = domains.join(suffixes, "suffix").select("domain", shrunk("s_mean", "d_k").alias("d_mean"), "h_k")
    hosts = hosts.join(domains, "domain").withColumn("mean", shrunk("d_mean", "h_k"))
    lower = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("h_k") + 1))
    return hosts.select("host", "domain", "n", "mean", lower.alias("lower"), (lower > threshold).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every page. outcomes (host, bad); without them, the pages' own signs are."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if outcomes is None:
        outcomes = pages.select(host_of(url).alias("host"), page_outcomes(url, F.col(html_col).cast("string")).alias("bad"))
    # Two keys: the reputations lie by host, so both sides are exchanged and a hot host's pages can be split.
    known = reputations(outcomes).select("host", "domain", "blocked")
    met = rows.withColumn("domain", domain_of(F.col("host"))).join(known, ["host", "domain"], "left")
    fits = fitting_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("blocked"), "block").otherwise("allow")
    return met.select("page_id", "host", "path", fits.alias("fits"), learnt.alias("learnt")).select(
        "page_id", "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", "learnt").alias("verdict")
    )

"""URL filters: empirical-Bayes host reputation behind explicit host/path rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A registry's label before a country's, as in co.uk or com.mx, makes a suffix of two labels under which names are registered.
COUNTRY_SUFFIX = r"^(ac|co|com|edu|gob|go|gov|gouv|govt|id|mil|ne|net|nom|or|org|sch)[.][a-z][a-z]$"
#: Sites under which everybody has a name of their own; more can be passed.
SHARED_SITES = ("github.io", "blogspot.com", "wordpress.com")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Bound:
    """Block where the posterior's lower bound on the bad share, mean - z sd, exceeds `limit`."""

    z: float = 1.645
    limit: float = 0.25
    least_strength: float = 2.0
    most_strength: float = 200.0


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def domain_parts(host: Column, shared: tuple[str, ...] = SHARED_SITES) -> tuple[Column, Column]:
    """(registered domain, suffix): the last labels of the host. A suffix has one label, or two by COUNTRY_SUFFIX or `shared`."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    long = two.rlike(COUNTRY_SUFFIX) | two.isin(*shared)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(F.element_at(labels, -1))


def _strength(level: DataFrame, bound: Bound) -> float:
    """Beta-binomial prior strength of a level, by the method of moments over its units with labels: one row of sums."""
    p, sx, sn, k = F.col("_p"), F.col("_sx"), F.col("_sn"), F.col("_k")
    s = level.where("n > 0").agg(
        F.sum("bad").cast("double").alias("_sx"),
        F.sum("n").cast("double").alias("_sn"),
        F.count(F.lit(1)).cast("double").alias("_k"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("_sq"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("_snn"),
    )
    s = s.withColumn("_p", sx / sn)
    between = (F.col("_sq") - sn * p * p - (k - 1) * p * (1 - p)) / F.nullif(sn - F.col("_snn") / sn, F.lit(0.0))
    strength = p * (1 - p) / F.when(between > 0, between) - 1
    return s.select(F.least(F.greatest(F.coalesce(strength, F.lit(bound.most_strength)), F.lit(bound.least_strength)), F.lit(bound.most_strength))).first()[0]


def host_reputation(pages: DataFrame, outcomes: DataFrame, bound: Bound = Bound(), shared: tuple[str, ...] = SHARED_SITES) -> DataFrame:
    """host, n, bad, mean, lower: posterior of each host's bad share.

    pages (page_id, host), outcomes (page_id, bad 0/1 or null, then unused). A
    suffix is shrunk to the overall share, a registered domain to its suffix, a
    host to its domain; each level's prior strength comes from the spread of its
    units. Without labels a tenth counts as bad. Counts over all pages, combined
    before the shuffle; hosts and domains are counted once and written, and what
    the driver gets is one row of sums a level.
    """
    o = outcomes.where(F.col("bad").isin(0, 1) & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = pages.join(o, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = domain_parts(F.col("host"), shared)
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = materialize(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 10)).first()[0]
    ks, kd, kh = (_strength(level, bound) for level in (suffixes, domains, hosts))
    shrunk = lambda mean, k: (F.col("bad") + k * mean) / (F.col("n") + k)
    s = suffixes.select("suffix", shrunk(F.lit(overall), ks).alias("_ms"))
    d = domains.join(s, "suffix").select("domain", shrunk(F.col("_ms"), kd).alias("_md"))
    m = F.col("n") + kh
    mean = (F.col("bad") + kh * F.col("_md")) / m
    return hosts.join(d, "domain").select("host", "n", "bad", mean.alias("mean"), (mean - bound.z * F.sqrt(mean * (1 - mean) / (m + 1))).alias("lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], bound: Bound = Bound()) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, lower for each page.

    A rule's verdict wins; else the host is blocked where its posterior bound says
    so. Null or schemeless urls share the empty host. Rows are kept one for one
    (repeated rows too); a null page_id has no outcome; extra columns are ignored.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    reputation = host_reputation(p, outcomes, bound).select(F.col("host").alias("_host"), "mean", "lower")
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > bound.limit, "block").otherwise("allow")
    return p.join(reputation, F.col("host") == F.col("_host"), "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mean", "lower"
    )

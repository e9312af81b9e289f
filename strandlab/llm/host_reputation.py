"""URL filter: rules first, then an empirical-Bayes reputation of the host.

Pages with a known outcome (1 good, 0 bad) are counted per host.  Rates are shrunk from the suffix to the registered
domain to the host: each level's posterior mean is the prior mean of the next, and the strength of a level's prior is
estimated from how much its groups differ (beta-binomial moments).  A host is blocked when even the upper posterior
bound of its good rate is below the wanted rate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.shared import LOWER, UPPER, lookup
from strandlab.session import cut

PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
#: Wanted good rate, standard deviations of the bound, bounds of a prior's strength (as many pages).
GOOD, BOUND, WEAKEST, STRONGEST = 0.5, 1.0, 1.0, 10_000.0


@dataclass(frozen=True)
class Rule:
    """``host/path-prefix`` and its verdict; fits the host, its subdomains and paths that start with the prefix."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (pattern, verdict) of the longest rule that fits, null if none does; of equally long ones block wins."""
    out = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block", r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """What follows the last dot, without a port."""
    return F.substring_index(F.regexp_replace(host, ":[0-9]*$", ""), ".", -1)


def domain_of(host: Column) -> Column:
    """The last two labels, without a port: the registered domain under a one-label suffix."""
    return F.substring_index(F.regexp_replace(host, ":[0-9]*$", ""), ".", -2)


def prior_strength(groups: DataFrame) -> float:
    """Pages that the prior of these groups (tried, good) is worth, by moments of the beta-binomial."""
    p = F.sum("good") / F.sum("tried")
    base = groups.filter("tried > 0").agg(F.count("*").alias("k"), F.sum("tried").alias("n"), F.sum(F.col("tried") * F.col("tried")).alias("n2"), p.alias("p"), F.sum(F.col("good") * F.col("good") / F.col("tried")).alias("g2"), F.sum("good").alias("g")).first()
    if not base["k"] or base["k"] < 2 or not 0 < base["p"] < 1:
        return STRONGEST
    spread = (base["g2"] - base["g"] * base["p"]) / (base["p"] * (1 - base["p"])) - (base["k"] - 1)
    room = base["n"] - base["n2"] / base["n"] - (base["k"] - 1)
    share = spread / room if room > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / share - 1)) if share > 0 else STRONGEST


def host_reputation(outcomes: DataFrame, good: float = GOOD, bound: float = BOUND) -> DataFrame:
    """(host, pages, rate, upper, allowed) of every host of ``outcomes`` (host, outcome 1, 0 or null if unknown).

    Without any known outcome the rate is ``good`` everywhere.  An empty host is a host like any other.
    """
    hosts = cut(outcomes.groupBy("host").agg(F.count("*").alias("pages"), F.count("outcome").alias("tried"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("good")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    up = lambda table, key, *more: cut(table.groupBy(key, *more).agg(F.count("*").alias("below"), F.sum("tried").alias("tried"), F.sum("good").alias("good")))
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    total = suffixes.agg(F.sum("tried"), F.sum("good")).first()
    mean = total[1] / total[0] if total[0] else good
    s, d, h = (prior_strength(t) for t in (suffixes, domains, hosts))
    shrunk = lambda prior, weight: (F.col("good") + weight * prior) / (F.col("tried") + weight)
    suffixes = cut(suffixes.select("suffix", F.col("below").alias("weight"), shrunk(F.lit(mean), s).alias("prior")))
    domains = cut(lookup(domains, suffixes, "suffix", "weight").select("domain", F.col("below").alias("weight"), shrunk(F.col("prior"), d).alias("prior")))
    rated = lookup(hosts.drop("suffix"), domains, "domain", "weight").withColumn("rate", shrunk(F.col("prior"), h)).withColumn("n", F.col("tried") + h)
    rated = rated.withColumn("upper", F.col("rate") + bound * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + 1)))
    return rated.select("host", "pages", "rate", "upper", (F.round("upper", 9) >= good).alias("allowed"))


def judge_urls(pages: DataFrame, rules: list[Rule], good: float = GOOD, bound: float = BOUND) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate) of every page (page_id, url).

    A rule's verdict is the outcome of the pages it fits; the others get the verdict of their host.  A null url or one
    without ``://`` has an empty host and path.  Repeated rows each get their row; an empty table gives no row; other
    columns are not read.  ``rate`` is null where a rule decides.
    """
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    judged = cut(parsed.withColumn("match", matching_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("match.pattern").alias("rule"), F.col("match.verdict").alias("said")))
    outcome = F.when(F.col("said").isNotNull(), (F.col("said") == "allow").cast("int"))
    hosts = cut(host_reputation(judged.select("host", outcome.alias("outcome")), good, bound))
    ruled = judged.filter(F.col("rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("said").alias("verdict"), F.lit(None).cast("double").alias("rate"))
    others = lookup(judged.filter(F.col("rule").isNull()), hosts, "host", "pages")
    return ruled.unionByName(others.select("page_id", "host", "path", "rule", F.when(F.col("allowed"), "allow").otherwise("block").alias("verdict"), F.round("rate", 9).alias("rate")))

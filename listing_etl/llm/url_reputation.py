"""URL filter by empirical-Bayes host reputation, in SQL expressions only.

Labelled page outcomes (good or bad) are shrunk along suffix, registered domain and host: a
suffix's rate of bad pages has the beta prior of the whole table, a domain's that of its
suffix, a host's that of its domain; the mean of a prior is the posterior mean one level up,
its strength (in pages) is estimated at each level from how much the rates of its groups
differ (method of moments). A url is blocked if its host's posterior lower bound (mean less
``Z`` standard deviations) of the rate of bad pages is above ``BLOCK_RATE``: a few bad pages of a host that little is
known of do not block it. Hosts without labelled pages have their domain's posterior, or
their suffix's, or that of the table.

Rules (host, path prefix, verdict) go first: a rule fits its host and all subdomains if the
url's path starts with its path; the longest rule wins (host, then path).

All levels are sums of pages per host, so a host with a third of all pages is one row after
the map side; reputations join the pages by host, which Spark splits where they are skewed.

Edge cases: null urls and urls without ``://`` have an empty host and path and are judged
with the prior of all pages; pages without a labelled outcome are judged but teach nothing;
without any outcome everything is allowed; repeated rows are judged alike, outcomes of
repeated rows count as often; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import staged

Z = 1.645
BLOCK_RATE = 0.5
#: Bounds of a prior's strength in pages.
STRENGTH = (1.0, 1000.0)
#: Suffixes of more than one label (fixed values; a parameter).
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _names(host: Column, long_suffixes: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(F.regexp_extract(host, r"^([^:]*)", 1), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    two = F.size(labels) >= 3
    long_ = two & last(2).isin(*long_suffixes) if long_suffixes else F.lit(False)
    # an address has no registered domain: it is one name at every level
    address = host.rlike(r"^[0-9]+(\.[0-9]+){3}(:[0-9]+)?$")
    whole = lambda c: F.when(address, F.array_join(labels, ".")).otherwise(c)
    return whole(F.when(long_, last(3)).otherwise(last(2))), whole(F.when(long_, last(2)).otherwise(last(1)))


def _strength(rate: Column) -> Column:
    """Prior strength of groups (n, bad, and the rate expected of them) by moments: with N pages
    in m groups, the excess of the squared deviations over binomial noise is N/(s+1)-like."""
    noise = F.sum(rate * (1 - rate) * F.col("n"))
    spread = F.sum((F.col("bad") - F.col("n") * rate) ** 2)
    pairs = F.sum(F.col("n") * (F.col("n") - 1.0) * rate * (1 - rate))
    share = F.when((pairs > 0) & (spread > noise), (spread - noise) / pairs).otherwise(F.lit(0.0))
    low, high = STRENGTH
    return F.least(F.greatest(F.when(share > 0, 1 / share - 1).otherwise(F.lit(high)), F.lit(low)), F.lit(high))


def _shrunk(with_prior: DataFrame) -> DataFrame:
    """Groups (n, bad) with the beta posterior (a, b) under the prior (pa, pb) of the level above."""
    with_prior = with_prior.withColumn("rate", F.col("pa") / (F.col("pa") + F.col("pb")))
    s = F.lit(with_prior.agg(_strength(F.col("rate"))).first()[0])
    return (with_prior.withColumn("a", s * F.col("rate") + F.col("bad"))
            .withColumn("b", s * (1 - F.col("rate")) + F.col("n") - F.col("bad")))


def reputations(outcomes: DataFrame, url: str = "url", bad: str = "bad", long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """Posteriors (``a``, ``b``) by ``level`` (host, domain, suffix, all) and ``name`` of labelled
    outcomes (``bad`` 0 or 1; null rows are left out)."""
    rows = outcomes.where(F.col(bad).isin(0, 1)).select(host_of(F.col(url)).alias("host"), F.col(bad).cast("double").alias("bad"))
    hosts = rows.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = _names(F.col("host"), long_suffixes)
    hosts = staged(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    pa, pb = bad + 0.5, n - bad + 0.5
    up = lambda df, name: df.select(name, F.col("a").alias("pa"), F.col("b").alias("pb"))
    suffixes = suffixes.withColumn("pa", F.lit(pa)).withColumn("pb", F.lit(pb))
    suffixes = staged(_shrunk(suffixes).select("suffix", "a", "b"), "suffixes")
    domains = staged(_shrunk(domains.join(up(suffixes, "suffix"), "suffix")).select("domain", "a", "b"), "domains")
    host = _shrunk(hosts.join(up(domains, "domain"), "domain"))
    level = lambda df, name, kind: df.select(F.lit(kind).alias("level"), F.col(name).alias("name"), "a", "b")
    known = hosts.sparkSession.createDataFrame([("all", "", pa, pb)] if n else [], "level string, name string, a double, b double")
    return level(host, "host", "host").union(level(domains, "domain", "domain")).union(level(suffixes, "suffix", "suffix")).union(known)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]))):       # the longest is tried first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, posteriors: DataFrame, rules: Sequence[tuple[str, str, str]] = (), key: str = "page_id", url: str = "url",
          block_rate: float = BLOCK_RATE, z: float = Z, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, and the posterior bound of the rate of bad
    pages (``bound``; null without outcomes) of every row. The number of rules is bounded (they are
    part of the expression); reputations join by host."""
    a, b = F.col("a"), F.col("b")
    bounds = posteriors.select("level", "name", (a / (a + b) - z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))).alias("bound"))
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = rows.select("host").distinct()
    domain, suffix = _names(F.col("host"), long_suffixes)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    for kind, name in (("host", "host"), ("domain", "domain"), ("suffix", "suffix")):
        hosts = hosts.join(bounds.where(F.col("level") == kind).select(F.col("name").alias(name), F.col("bound").alias(f"by_{kind}")), name, "left")
    whole = F.lit(bounds.where(F.col("level") == "all").agg(F.max("bound")).first()[0]).cast("double")
    hosts = staged(hosts.select(F.col("host").alias("name"), F.coalesce("by_host", "by_domain", "by_suffix", whole).alias("bound")), "bounds")
    joined = rows.join(hosts, rows["host"] == hosts["name"], "left")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > block_rate, "block").otherwise("allow")
    return joined.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")

"""URL filter: rules first, then the reputation of a host, shrunk through its domain and suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.llm.common import LOWER, UPPER, drop_stage, join_small, unused, write_stage

# Suffixes of two labels under which names are registered.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where there is none or it has no ``://``."""
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def suffix_of(host: Column, double: Sequence[str] = DOUBLE_SUFFIXES) -> Column:
    """The suffix under which names are registered: the last label, or the last two where they are in ``double``."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(double)), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, double: Sequence[str] = DOUBLE_SUFFIXES) -> Column:
    """The suffix and the label before it; a host without one is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(double)), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path, verdict) that fits, and its verdict; null where none does."""
    if len(rules) > 1000:  # they become one expression
        raise ValueError("at most 1000 rules")
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame) -> DataFrame:
    """One row m_: how many outcomes the prior of the level counts for, fitted to its groups (k, n, prior).

    Of a beta-binomial count, (k - n p)^2 is expected to be n p (1 - p) (1 + (n - 1) r) with r = 1 / (m + 1):
    r is found from the sums of both sides over all groups and kept between 0.001 and 0.9. Where no group has two outcomes it is 1/3.
    """
    k, n, p = F.col("k"), F.col("n"), F.col("prior")
    sums = groups.agg(F.sum(F.pow(k - n * p, 2) - n * p * (1 - p)).alias("a"), F.sum(n * (n - 1) * p * (1 - p)).alias("b"))
    r = F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.coalesce(F.try_divide("a", "b"), F.lit(1 / 3))))
    return sums.select((1 / r - 1).alias("m_"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """groups with alpha and beta, the posterior of their rate under the prior of their level, and rate, its mean."""
    out = groups.crossJoin(F.broadcast(_strength(groups)))  # one row
    alpha, beta = F.col("k") + F.col("m_") * F.col("prior"), F.col("n") - F.col("k") + F.col("m_") * (1 - F.col("prior"))
    return out.withColumn("alpha", alpha).withColumn("beta", beta).withColumn("rate", F.col("alpha") / (F.col("alpha") + F.col("beta"))).drop("m_")


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(host, k, n, rate, bound): the bad-outcome rate of each host and its lower posterior bound.

    ``outcomes``: host, bad (boolean; null where a page isn't labelled). k of n labelled pages are bad. The rate of
    a suffix is shrunk towards that of all pages, a domain's towards its suffix's, a host's towards its
    domain's, each by a beta-binomial prior as strong as the groups of the level are alike. bound is ``z`` standard deviations of the posterior
    below its mean. A host without outcomes has its domain's prior. One row a host is all that leaves the first aggregation.
    """
    count = lambda c: F.count(F.when(c, 1))
    hosts = write_stage(outcomes.groupBy("host").agg(count(F.col("bad")).alias("k"), F.count("bad").alias("n")).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = write_stage(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    base = domains.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("prior"))
    suffixes = write_stage(_shrunk(suffixes.crossJoin(F.broadcast(base))), "suffixes")  # base is one row
    domains_ = write_stage(_shrunk(join_small(domains, suffixes.select("suffix", F.col("rate").alias("prior")), ["suffix"])), "domain-rates")
    out = _shrunk(join_small(hosts, domains_.select("domain", F.col("rate").alias("prior")), ["domain"]))
    a, b = F.col("alpha"), F.col("beta")
    bound = F.col("rate") - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    found = write_stage(out.select("host", "k", "n", "rate", bound.alias("bound")), "host-rates")
    for x in (hosts, domains, suffixes, domains_):
        drop_stage(x)
    return found


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = (), limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """Add host, path, rule, verdict (``allow`` or ``block``), n_labelled and bad_bound to ``pages`` (url, bad and others).

    The longest rule (host, path, verdict) that fits a page decides: its host is the page's or a domain above it, its path
    begins the page's. Other pages are blocked where the lower posterior bound of their host's rate of
    bad outcomes (``host_reputation``) is above ``limit``; so a host needs evidence against it, of its own or of its domain.

    Null url or one without ``://``: host and path empty, which is a host like any other. bad null: not labelled. Repeated rows
    count each time. Empty table: no rows. Of the columns that are added, those of ``pages`` are replaced.
    """
    host, path = url_parts(F.col("url"))
    added = ("host", "path", "rule", "verdict", "n_labelled", "bad_bound")
    mine = pages.select(*[c for c in pages.columns if c.lower() not in added], host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = unused(mine, "h_")
    known = host_reputation(mine.select("host", "bad"), z).select(F.col("host").alias(own), F.col("n").alias("n_labelled"), F.round("bound", 9).alias("bad_bound"))
    out = join_small(mine, known, F.col("host") == F.col(own), "left").drop(own).withColumn("rule", name).withColumn("verdict", verdict)
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("bad_bound") > limit, "block").otherwise("allow")))

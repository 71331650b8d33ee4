"""URL filter by empirical-Bayes host reputation, in DataFrame expressions only.

Pages whose outcome is known (good 1, bad 0) vote on their host. Each level of the name tree is shrunk
towards the level above: the suffix towards the overall share, the registered domain towards its suffix,
the host towards its domain. The strength of each beta prior is estimated from the spread of the shares at
that level (method of moments on the sums of n and n * share ** 2). A url without a rule is allowed if the
lower bound of its host's posterior, mean - z * sd, reaches the threshold.

A suffix is the host's last label, a registered domain its last two labels, or three where the last label
but one is a short generic one under a two-letter suffix (``co.uk``). Null urls and urls without ``://``
have empty host and path; an empty host is a host like any other. Repeated rows each count. Columns but page_id and url are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
THRESHOLD, Z, LEAST, MOST = 0.5, 1.0, 2.0, 1000.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple) -> Column:
    h, p, _ = rule
    return ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (host and path), and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0])):
        name = F.when(_fits(host, path, r), F.lit(r[0] + r[1])).otherwise(name)
        verdict = F.when(_fits(host, path, r), F.lit(r[2])).otherwise(verdict)
    return name, verdict


def domain_of(host: Column) -> Column:
    n = F.when(host.rlike(r"(?:^|\.)(?:co|com|org|net|ac|gov|edu)\.[a-z]{2}$"), F.lit(-3)).otherwise(F.lit(-2))
    return F.when(n == -3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _shrink(level: DataFrame, key: str, parent: DataFrame, parent_key: str | None) -> DataFrame:
    """level(key, parent_key, n, good) with its posterior a, b, from one prior strength and the parent's mean."""
    if parent_key is None:
        up = level.crossJoin(F.broadcast(parent))  # one row: the overall share
    else:
        up = level.join(common.sized(parent.select(F.col(parent_key).alias("_p"), "mean"), 96), F.col(parent_key) == F.col("_p")).drop("_p")
    share, m = F.col("good") / F.col("n"), F.col("mean")
    # Var(share) = m (1 - m) (1 / n + (1 - 1 / n) / (s + 1)) for a prior of strength s
    sums = up.where("n > 0").agg(F.sum(F.col("n") * (share - m) * (share - m)).alias("q"), F.sum(m * (1 - m)).alias("v1"), F.sum((F.col("n") - 1) * m * (1 - m)).alias("v2"))
    rho = (F.coalesce("q", F.lit(0.0)) - F.coalesce("v1", F.lit(0.0))) / F.col("v2")
    strength = F.when((F.col("v2") > 0) & (rho > 0), F.least(F.lit(MOST), F.greatest(F.lit(LEAST), 1 / rho - 1))).otherwise(F.lit(MOST))
    up = up.crossJoin(F.broadcast(sums.select(strength.alias("s"))))  # one row
    a, b = F.col("s") * m + F.col("good"), F.col("s") * (1 - m) + F.col("n") - F.col("good")
    return up.select(key, *([parent_key] if parent_key else []), "n", "good", a.alias("a"), b.alias("b"), (a / (a + b)).alias("mean"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes(host, good 0, 1 or null): a row a host, with the posterior's mean and sd. All hosts of outcomes get one.

    The counts are combined before the shuffle, so a host with a third of all pages is a row a task.
    """
    per = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    # each level is counted once: pages are read for the hosts alone
    hosts = common.save(per.select("host", domain_of(F.col("host")).alias("domain"), "n", "good"), "hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("suffix", F.substring_index("domain", ".", -1))
    domains = common.save(domains, "domains")
    suffixes = common.save(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "suffixes")
    root = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean"))
    s = common.save(_shrink(suffixes, "suffix", root, None), "suffix-posteriors")
    d = common.save(_shrink(domains, "domain", s, "suffix"), "domain-posteriors")
    h = _shrink(hosts, "host", d, "domain")
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return h.select("host", "mean", sd.alias("sd"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """A row a page: page_id, host, path, rule, verdict, lower. The rules' own verdicts are the labelled outcomes."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = match(F.col("host"), F.col("path"), rules)
    seen = seen.select("*", name.alias("rule"), verdict.alias("ruled"))
    good = F.when(F.col("ruled") == "allow", 1).when(F.col("ruled") == "block", 0)
    rep = common.save(reputation(seen.select("host", good.alias("good"))).withColumnRenamed("host", "_h"), "reputation")
    out = seen.join(common.sized(rep, 160), F.col("host") == F.col("_h"))
    lower = F.round(F.col("mean") - z * F.col("sd"), 9)
    own = F.when(lower >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), lower.alias("lower"))

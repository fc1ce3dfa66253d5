"""URL filters: explicit rules, and empirical-Bayes host reputations, with DataFrame functions only.

Labelled page outcomes are counted per host.  A suffix's rate of bad pages is shrunk towards the overall rate, a
registered domain's towards its suffix's, and a host's towards its domain's: each level is a beta-binomial whose prior
has the mean of the level above and a strength estimated by moments from all counts of that level.  A page is blocked
if even the lower bound of its host's posterior is above what is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.decontaminate import LOWER, UPPER

#: The contract's rules: verdict, then host and path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Public suffixes of two labels that are known unless the caller gives a table; other suffixes are the last label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: Blocked: lower bound (mean less BOUND deviations) of the posterior rate of bad pages above MAX_BAD.
MAX_BAD, BOUND = 0.25, 1.0
#: A level whose counts show no spread, or too few to tell, gets this share of the variance between its members.
LEAST_RHO, MOST_RHO = 0.001, 0.5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def _domain_and_suffix(host: Column, suffixes: Sequence[str]) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:[0-9]*)?\.?$", "")
    last_two = F.substring_index(bare, ".", -2)
    two = last_two.isin(*suffixes)
    number = bare.rlike(r"^[0-9.]+$|^\[")
    domain = F.when(number, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(last_two)
    suffix = F.when(number, F.lit("")).when(two, last_two).otherwise(F.substring_index(bare, ".", -1))
    return domain, suffix


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, else null.  A rule fits its host and all subdomains, by the path's start."""
    fits: list[tuple[Column, str]] = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits.append(((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest))
    chain = [x[1] for x in sorted(rules, key=lambda r: (-len(r[1]), r[1]))]
    return reduce(lambda out, at: F.when(fits[at], F.lit(chain[at])).otherwise(out), reversed(range(len(chain))), F.lit(None).cast("string"))


def _strength(counts: DataFrame, above: str) -> float:
    """Strength of the prior of members with counts n, bad under groups ``above``: by moments, over all members."""
    totals = counts.groupBy(above).agg(F.sum("n").alias("tn"), F.sum("bad").alias("tb"))
    p = F.col("tb") / F.col("tn")
    weight = (1 - F.col("n") / F.col("tn")) * p * (1 - p)
    seen = (
        counts.where("n > 0").join(totals.where("tn > 0"), above)
        .agg(F.sum(F.col("n") * (F.col("bad") / F.col("n") - p) ** 2), F.sum(weight), F.sum(weight * (F.col("n") - 1)))
        .first()
    )
    spread, apart, room = (float(x or 0) for x in seen)
    rho = min(MOST_RHO, max(LEAST_RHO, (spread - apart) / room)) if room > 1e-9 else MOST_RHO
    return round(1 / rho - 1, 6)


def host_reputations(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = TWO_LABELS) -> DataFrame:
    """``host, n, bad, mean, low`` for every host of ``pages`` (page_id, host): its labelled pages and bad ones, and the
    posterior mean and lower bound of its rate of bad pages.  ``outcomes`` has page_id and bad (0 or 1)."""
    from docloom.sources.tables import cut_lineage

    outcome = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    domain, suffix = _domain_and_suffix(F.col("host"), suffixes)
    hosts = (
        pages.join(outcome, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", domain).withColumn("suffix", suffix).withColumn("every", F.lit(1))
    )
    hosts = cut_lineage(hosts)
    domains = cut_lineage(hosts.groupBy("domain", "suffix", "every").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = cut_lineage(domains.groupBy("suffix", "every").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    overall = (bad + 0.5) / (n + 1) if n else 0.5
    m = {level: _strength(counts, above) for level, counts, above in (("suffix", suffixes, "every"), ("domain", domains, "suffix"), ("host", hosts, "domain"))}

    def mean(prior: Column, level: str) -> Column:
        return (F.col("bad") + m[level] * prior) / (F.col("n") + m[level])

    of_suffix = suffixes.select("suffix", mean(F.lit(overall), "suffix").alias("of_suffix"))
    of_domain = domains.join(of_suffix, "suffix").select("domain", mean(F.col("of_suffix"), "domain").alias("of_domain"))
    total = F.col("n") + m["host"]
    out = hosts.join(of_domain, "domain").withColumn("mean", mean(F.col("of_domain"), "host"))
    return out.select("host", "n", "bad", "mean", (F.col("mean") - BOUND * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))).alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD, suffixes: Sequence[str] = TWO_LABELS) -> DataFrame:
    """``page_id, host, path, rule, verdict, low`` of every row of ``pages`` (page_id, url).

    The verdict is that of the longest fitting rule, else ``block`` if the host's lower bound is above ``max_bad``,
    else ``allow``.  A null URL or one without ``://`` has an empty host and path, and is judged as the empty host.
    Of repeated outcomes of a page the bad one counts; null ones don't; without outcomes no page is bad enough.
    ``suffixes`` are the public suffixes of two labels.  Repeated pages give equal rows, other columns are ignored, an empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    low = host_reputations(parts, outcomes, suffixes).select("host", "low")
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])
    out = parts.join(low, "host", "left").withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    by_host = F.when(F.col("low") > max_bad, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.try_element_at(verdicts, F.col("rule"))).otherwise(by_host).alias("verdict"), "low")

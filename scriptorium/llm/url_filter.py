"""URL filter: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix.  Each
level's posterior mean is the prior mean of the level below; how strongly it
pulls (the precision of the beta prior) is estimated at each level from how much
more its groups scatter than binomial draws would.  A host is blocked if even
the upper credible bound of its good share stays below ``least_good``.  Only
group counts are shuffled, pre-aggregated; page bodies are never read.

A host's suffix is its last label, or its last two where the last is a country's
(two letters) and the one before it a registry's (SECOND_LEVEL); its registered
domain is the suffix and the label before it.  An IPv4 address is a domain of its
own under one suffix for all addresses.

Defined results: a null url, or one without '://', has an empty host and path;
it fits no rule and has the prior of its (empty) suffix.  Very long urls are read
whole.  Labels that are null are no outcome.  Repeated rows count each.  Of rules
of equal length the one that comes last in alphabetical order wins; a bound equal
to ``least_good`` is allowed.  Without any label the good share is taken as 1, so
nothing is blocked by reputation.  An empty table gives an empty table; of other
columns only ``id_col`` is returned, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.scratch import stored

from .columns import small

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEVELS = ("suffix", "domain", "host")
#: Labels under a country's suffix that registries sell names below.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "mil", "ne", "net", "nom", "or", "org", "sch")
_ADDRESS = r"^\d{1,3}(\.\d{1,3}){3}(:\d+)?$"
LEAST_PRECISION, MOST_PRECISION = 2.0, 1000.0


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(_rest(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def _two_labels(host: Column) -> Column:
    """Whether the suffix is two labels, as in 'co.uk'."""
    return host.rlike(rf"(?:^|\.)(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")


def suffix_of(host: Column) -> Column:
    return F.when(host.rlike(_ADDRESS), F.lit("(address)")).when(_two_labels(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(host.rlike(_ADDRESS), host).when(_two_labels(host), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _precision(rows: DataFrame) -> float:
    """How strongly a level's prior pulls: from rho in sum n (k/n - m)^2 = sum m (1 - m) (1 + (n - 1) rho)."""
    spread = rows.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("s"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("e"),
        F.sum(F.col("m") * (1 - F.col("m")) * (F.col("n") - 1)).alias("d"),
    ).first()
    if not spread["d"] or spread["d"] < 1e-12:
        return MOST_PRECISION
    rho = max((spread["s"] - spread["e"]) / spread["d"], 1e-9)
    return round(min(max(1 / rho - 1, LEAST_PRECISION), MOST_PRECISION), 6)


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """(level, name, n, k, mean, bound) for every suffix, domain and host of ``outcomes`` (host, good 0/1).

    n outcomes, k of them good; mean is the posterior mean of the good share,
    bound its upper credible bound (mean + z standard deviations).
    """
    hosts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    hosts = stored(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"), "host_counts")
    overall = hosts.agg((F.sum("k") / F.sum("n")).alias("m")).first()["m"]
    posterior, above = None, F.lit(None).cast("string")
    for level in LEVELS:
        rows = hosts.groupBy(F.col(level).alias("name"), above.alias("above")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if posterior is None:
            rows = rows.withColumn("m", F.lit(overall))
        else:
            upper = posterior.where(F.col("level") == LEVELS[LEVELS.index(level) - 1])
            rows = rows.join(upper.select(F.col("name").alias("above"), F.col("mean").alias("m")), "above")
        rows = stored(rows, f"{level}_counts")
        w = _precision(rows)
        a, b = w * F.col("m") + F.col("k"), w * (1 - F.col("m")) + F.col("n") - F.col("k")
        rows = rows.withColumns({"mean": a / (a + b), "sd": F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))})
        rows = rows.select(F.lit(level).alias("level"), "name", "n", "k", "mean", (F.col("mean") + z * F.col("sd")).alias("bound"))
        posterior = stored(rows if posterior is None else posterior.unionByName(rows), "posterior")
        above = F.col(level)
    return posterior


def judge(pages: DataFrame, outcomes: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, least_good: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, good_bound) per page; ``outcomes`` is (url, good 0/1) of labelled pages."""
    known = reputation(outcomes.select(host_of(F.col("url")).alias("host"), F.col("good").cast("long").alias("good")).where("good is not null"))
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({"fit": rule_of(F.col("host"), F.col("path"), rules), "domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for level in LEVELS:
        at = known.where(F.col("level") == level).select(F.col("name").alias(level), F.col("bound").alias(f"{level}_bound"))
        rows = rows.join(small(at), level, "left")
    bound = F.coalesce("host_bound", "domain_bound", "suffix_bound", F.lit(1.0))
    verdict = F.coalesce("fit.verdict", F.when(bound < least_good, "block").otherwise("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.round(bound, 4).alias("good_bound"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, good): a page is labelled through the document whose number ends its path; good means quality 1 and not toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html|/)?$", 1)
    numbered = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    good = F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).otherwise(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"))
    return numbered.where("doc_id is not null").join(labels.select("doc_id", good.alias("good")), "doc_id").select("url", "good")

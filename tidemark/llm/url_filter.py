"""URL filters: longest matching rule first, else an empirical-Bayes reputation of the host.

Reputation: labelled page outcomes (bad or not) are counted per host, registered domain and suffix. A suffix's rate of
bad pages is shrunk towards the overall rate, a domain's towards its suffix, a host's towards its domain, each by a
beta-binomial prior whose strength is estimated from how much the rates at that level differ (method of moments). A
host is blocked when the lower posterior bound of its rate, mean minus ``z`` standard deviations, is over ``limit``.
Hosts without outcomes have their domain's rate with the prior's strength, so they are judged like their siblings;
without outcomes of the domain either, its suffix's rate stands for it, and without any of the suffix the overall rate.
For levels, a port is no part of a host, and a registered domain is the label before the suffix: the last label, or the
last two where they are in ``SUFFIXES`` (common public suffixes of two labels; others are taken as of one label).

Edge cases: a null url or one without ``://`` has an empty host and path, which no rule fits; its reputation is that of
the empty host, which is never blocked; repeated rows are judged row by row; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules, textstats
from .common import bounded_batches, stored

#: Rules up to so many are sent to every task; more are joined like any table.
BROADCAST_RULES = 10_000
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels under which names are registered: per country, its second labels.
SUFFIXES = frozenset(
    f"{second}.{top}"
    for top, seconds in {
        "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt iwi kiwi maori mil net org school",
        "za": "ac co gov net org web", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go ne or pe re", "br": "art blog com eco edu gov mil net org", "in": "ac co edu firm gen gov ind mil net nic org res",
        "cn": "ac com edu gov mil net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per", "my": "com edu gov mil name net org",
        "mx": "com edu gob net org", "ar": "com edu gob int mil net org tur", "tr": "av bel com dr edu gen gov k12 mil name net org tv web", "il": "ac co gov idf k12 muni net org",
        "th": "ac co go in mi net or", "id": "ac biz co desa go mil my net or sch web", "vn": "ac biz com edu gov health info int name net org pro", "ua": "com edu gov in net org", "pl": "com edu gov info net org waw",
    }.items()
    for second in seconds.split()
)


@dataclass(frozen=True)
class Reputation:
    limit: float = 0.5
    z: float = 1.645
    least: float = 0.5
    most: float = 500.0


def parts(url):
    """host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), A_Z, a_z), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """[(verdict, "host/path")] to rule_host, rule_path, rule, rule_verdict."""
    rows = [(r.split("/", 1)[0].lower(), "/" + r.split("/", 1)[1] if "/" in r else "", r, v) for v, r in rules]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, rule_verdict string")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Of each distinct (host, path) that a rule fits: host, path, rule, rule_verdict of the longest, ties to the smaller rule."""
    told = rules.agg(F.count("*").alias("n"), F.max(F.size(F.split("rule_host", "\\."))).alias("labels")).first()
    if told["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    # No rule fits more labels than the longest has, however many a host has.
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, (told["labels"] or 1) + 1)]))
    found = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = F.min(F.struct(-F.length("rule"), "rule", "rule_verdict")).alias("b")
    return found.groupBy("host", "path").agg(best).select("host", "path", "b.rule", "b.rule_verdict")


def outcomes(pages: DataFrame) -> DataFrame:
    """host, bad: pages labelled by whether what they show passes the quality rules."""
    shown = F.regexp_replace(F.regexp_replace(F.col("html"), "(?s)<(script|style|title)\\b.*?</\\1>|<!--.*?-->", " "), "<[^>]*>|&[a-z]+;", " ")
    m = textstats.stats(shown.cast("binary")).alias("m")
    rows = bounded_batches(pages).where(F.col("html").isNotNull()).select(parts(F.col("url"))[0].alias("host"), m).select("host", "m.*").select("host", F.expr(quality_rules.BITS).alias("failures"))
    return rows.select("host", (quality_rules.POLICY.rejects(F.col("failures"))).cast("int").alias("bad"))


def levels(host):
    """domain and suffix of a host column."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    listed = two.isin(*sorted(SUFFIXES))
    return F.when(listed, F.substring_index(name, ".", -3)).otherwise(two), F.when(listed, two).otherwise(F.substring_index(name, ".", -1))


def rates(labelled: DataFrame, how: Reputation = Reputation()) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """hosts (host, n, bad, domain, suffix), domains (domain, domain_rate), suffixes (suffix, suffix_rate), the overall rate, and the strength of a host's prior.

    Only the strengths of three levels (a few numbers) reach the driver.
    """
    hosts = labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = levels(F.col("host"))
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    def strength(level: DataFrame) -> tuple[float, float]:
        p = F.col("bad") / F.col("n")
        r = level.agg(F.sum("n").alias("m"), F.sum("bad").alias("b"), F.count("*").alias("k"), F.sum(F.col("n") * p * p).alias("q")).first()
        if not r["m"]:
            return 0.5, how.most
        mean = (r["b"] + 0.5) / (r["m"] + 1.0)
        spread = float(r["q"]) / r["m"] - (r["b"] / r["m"]) ** 2 - mean * (1 - mean) * r["k"] / r["m"]
        return mean, min(how.most, max(how.least, mean * (1 - mean) / spread - 1)) if spread > 0 else how.most

    mean, s_suffix = strength(suffixes)
    (_, s_domain), (_, s_host) = strength(domains), strength(hosts)
    shrunk = lambda prior, s: (F.col("bad") + prior * s) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", shrunk(F.lit(mean), s_suffix).alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("suffix_rate"), s_domain).alias("domain_rate"))
    return hosts, domains, suffixes, mean, s_host


def bounded(hosts: DataFrame, prior, s, how: Reputation) -> DataFrame:
    """host, n, bad, rate, bound: the posterior under a prior rate of strength s."""
    out = hosts.select("host", "n", "bad", (F.col("bad") + prior * s).alias("a"), (F.col("n") - F.col("bad") + (1 - prior) * s).alias("b"))
    rate = F.col("a") / (F.col("a") + F.col("b"))
    bound = rate - how.z * F.sqrt(rate * (1 - rate) / (F.col("a") + F.col("b") + 1))
    return out.select("host", "n", "bad", rate.alias("rate"), bound.alias("bound"))


def reputations(labelled: DataFrame, how: Reputation = Reputation(), others: DataFrame | None = None) -> DataFrame:
    """host, n, bad, rate, bound: of hosts with outcomes, and with n 0 of those hosts of ``others`` that have none."""
    hosts, domains, suffixes, mean, s_host = rates(labelled, how)
    if others is not None:
        domain, suffix = levels(F.col("host"))
        new = others.select("host").distinct().join(hosts, "host", "left_anti")
        zero = F.lit(0).cast("long")
        hosts = hosts.unionByName(new.select("host", zero.alias("n"), zero.alias("bad"), domain.alias("domain"), suffix.alias("suffix")))
    prior = F.coalesce("domain_rate", "suffix_rate", F.lit(mean))
    return bounded(hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left"), prior, s_host, how)


def judged(pages: DataFrame, rules: DataFrame, labelled: DataFrame, how: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of pages."""
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bad = reputations(labelled, how, urls).select("host", "bound")
    out = urls.join(matched(urls, rules), ["host", "path"], "left").join(bad, "host", "left")
    blocked = F.coalesce(F.col("bound") > how.limit, F.lit(False)) & (F.col("host") != "")
    verdict = F.coalesce("rule_verdict", F.when(blocked, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound")

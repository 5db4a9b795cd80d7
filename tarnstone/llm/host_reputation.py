"""Empirical-Bayes host reputation for URL filtering, in DataFrame operations only.

Labelled page outcomes are counted by host, registered domain and suffix. Each level is a beta-binomial whose prior mean
is the posterior mean of the level above; the prior's strength is estimated by moments from the spread of the groups. A host is
blocked if a posterior bound of its share of good pages lies under the least share that is wanted: the upper bound blocks
hosts that are surely bad, the lower one all that are not surely good. Hosts without labels take the bound of their
domain, then of their suffix. Rules given by hand come first.

Pages are counted by host before anything is joined, so levels and rules are settled once a host; frequent hosts
reach the pages by a broadcast of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, lookup, settled

#: Suffixes of more than one label below which domains are registered; a table of them is a parameter.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")
#: Labels that a suffix may have, and rows of a suffix or rule table that may be broadcast.
MOST_LABELS, MOST_SENT = 5, 50_000
LEAST_GOOD, Z = 0.5, 1.64
#: Bounds of the intra-class correlation, and so of the prior's strength (1 / rho - 1).
LEAST_RHO, MOST_RHO = 0.005, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_table(spark: SparkSession, suffixes=LONG_SUFFIXES) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, suffixes))).alias("suffix"))


def _sent(table: DataFrame) -> DataFrame:
    """A table given by hand, broadcast if it is small enough."""
    table = settled(table)
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def with_levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """`hosts` (one row a host) with its registered domain and suffix: the longest suffix in the table, else the last label."""
    suffixes = suffix_table(hosts.sparkSession) if suffixes is None else suffixes
    tried = hosts.select("host", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(MOST_LABELS)))).alias("labels"))
    tried = tried.withColumn("suffix", F.expr("substring_index(host, '.', -labels)")).join(_sent(suffixes.select("suffix").distinct()), "suffix")
    known = tried.groupBy("host").agg(F.max("labels").alias("labels"))
    whole = hosts.join(known, "host", "left").withColumn("labels", F.coalesce("labels", F.lit(1)))
    return whole.withColumns({"domain": F.expr("substring_index(host, '.', -labels - 1)"), "suffix": F.expr("substring_index(host, '.', -labels)")}).drop("labels")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Moment estimate of the prior's strength; one row reaches the driver."""
    var = mean * (1 - mean)
    off = F.col("good") - F.col("n") * mean
    row = groups.select(F.sum(off * off / var).alias("s"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs")).first()
    rho = (row["s"] - row["n"]) / row["pairs"] if row["pairs"] else MOST_RHO
    return round(1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1, 6)


def reputations(outcomes: DataFrame, z: float = Z, suffixes: DataFrame | None = None, side: int = 1) -> dict[str, DataFrame]:
    """Frames by level (`host`, `domain`, `suffix`) with columns key, n, good, mean, strength, bound (above the mean, or below it if `side` is -1).

    `outcomes` has columns host and good (0 or 1); rows with a null in either count for nothing.
    """
    told = outcomes.where(F.col("host").isNotNull() & F.col("good").isNotNull())
    own = settled(with_levels(settled(told.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))), suffixes))
    total = own.select(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    overall = (total["good"] + 1) / (total["n"] + 2)
    parent, out = None, {}
    for level, up in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        groups = own.groupBy(level, *([up] if up else [])).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        if parent is None:
            groups = groups.withColumn("prior", F.lit(overall))
        else:
            sizes = groups.groupBy(up).agg(F.count("*").alias("size"))
            groups = lookup(groups, sizes.join(parent.select(F.col("key").alias(up), F.col("mean").alias("prior")), up), up, "size")
        groups = settled(groups.select(level, "n", "good", "prior"))
        strength = _strength(groups, F.col("prior"))
        posterior = (F.col("good") + F.col("prior") * strength) / (F.col("n") + strength)
        spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength + 1))
        bound = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("mean") + side * z * spread))
        parent = out[level] = groups.select(F.col(level).alias("key"), "n", "good", posterior.alias("mean"), F.lit(strength).alias("strength")).withColumn("bound", bound)
    return out


def rules_of(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host and `fits`, the rules (length, length of the host, block, action, rule, path) whose host is this one or a parent of it.

    Rules are (action, rule) with a host and a path in the rule; hosts that none fits are left out.
    """
    rows = []
    for action, rule in dict.fromkeys(rules):
        parent, slash, path = rule.partition("/")
        rows.append(F.struct(*(F.lit(v).alias(n) for n, v in (("parent", parent), ("path", slash + path), ("action", action), ("rule", rule)))))
    table = hosts.sparkSession.range(1).select(F.inline(F.array(*rows)))
    tried = hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("labels"))
    tried = tried.select("host", F.expr("substring_index(host, '.', -labels)").alias("parent")).join(_sent(table), "parent")
    order = F.struct(F.length("rule").alias("length"), F.length("parent").alias("own"), (F.col("action") == "block").alias("block"), "action", "rule", "path")
    return tried.groupBy("host").agg(F.collect_list(order).alias("fits"))


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: list[tuple[str, str]] = (),
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    least_good: float = LEAST_GOOD,
    z: float = Z,
    suffixes: DataFrame | None = None,
    bound: str = "upper",
) -> DataFrame:
    """Judge every page: the columns `keep`, host, path, rule, verdict, and bound (the posterior bound that decided).

    `rules` are (action, rule), a rule being a host and a path; a rule fits its host and all subdomains if the path starts
    with the rule's, the longest rule wins, of equal ones the one that blocks. `suffixes` is a table of the suffixes (column
    suffix) of more than one label below which domains are registered. A null URL or one without `://` has an empty host and
    path; its reputation is that of the empty host. Rows are judged one by one, repeated ones alike; URLs may be of any
    length; an empty table gives an empty result. With no outcomes, only rules block. Only `keep` and the URL are
    read, so other columns may have any names; a column of `keep` named like one of the result's own gives way to it.
    """
    keep = tuple(c for c in dict.fromkeys(keep) if c not in ("host", "path", "rule", "verdict", "bound"))
    seen = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    hosts = settled(with_levels(settled(seen.groupBy("host").agg(F.count("*").alias("pages"))), suffixes))
    levels = reputations(outcomes, z, suffixes, 1 if bound == "upper" else -1)
    judged = hosts
    for level in ("host", "domain", "suffix"):
        judged = judged.join(levels[level].select(F.col("key").alias(level), F.col("bound").alias(f"by_{level}")), level, "left")
    judged = judged.select("host", "pages", F.coalesce("by_host", "by_domain", "by_suffix", F.lit(1.0)).alias("bound"))
    judged = judged.join(rules_of(hosts, list(rules)), "host", "left") if rules else judged.withColumn("fits", F.lit(None).cast("array<struct<length:int,own:int,block:boolean,action:string,rule:string,path:string>>"))
    found, size, fits = free("found", keep), free("pages", keep), free("fits", keep)
    judged = judged.withColumnsRenamed({"pages": size, "fits": fits})
    best = F.array_max(F.filter(fits, lambda r: F.col("path").startswith(r["path"])))
    named = lookup(seen, judged, "host", size).withColumn(found, best)
    verdict = F.coalesce(F.col(f"`{found}`.action"), F.when(F.col("bound") < least_good, "block").otherwise("allow"))
    return named.select(*keep, "host", "path", F.col(f"`{found}`.rule").alias("rule"), verdict.alias("verdict"), F.round("bound", 6).alias("bound"))

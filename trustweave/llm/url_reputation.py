"""URL rules, and host reputation by empirical Bayes for urls that no rule fits.

Labelled page outcomes (bad or not) are summed by host, and each level's rate is shrunk
to the level above through a beta-binomial prior: suffix to all pages, registered domain
to its suffix, host to its domain. A level's prior strength is estimated from all its
groups by moments: with parent rates m and counts n the spread exceeds the binomial one
by the intra-group correlation. A host is blocked if the lower posterior bound of its bad
rate passes a threshold, so few labels never block.

Plan: pages meet their labels once, and are summed by host with partial sums before the
shuffle, so a host with a third of all pages is one partial row per task. The host table
goes back to the pages by a join that AQE splits or broadcasts by size.

The bound is that of a normal approximation to the posterior. Where it is near the threshold
of one half it exceeds the beta quantile by up to 0.02 with a weight of prior and labels of 11,
0.01 with 30 and 0.002 with 100; for rates near zero it may fall below zero, which blocks
nothing.

Defined cases: a null url, or one without ``://``, has an empty host and path; it is no host of
its own, its labels count for all pages only, and it is judged by all pages' rate; unlabelled hosts take their domain's posterior; a label with a
null outcome, or for no page, counts nothing; a page labelled twice counts each label;
without any label every rate is one half and nothing is blocked. Equal rules: the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trustweave.llm.batches import name
from trustweave.llm.staging import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which domains are registered; a parameter.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.nz", "co.za")
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
STRENGTH = (1.0, 1000.0)
#: (verdict, host and path prefix); rules are configuration, compiled into the plan.
Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones are asked first
        at, _, below = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below if "/" in text else "")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def domain_columns(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix; an address of numbers is its own domain without a suffix."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*\z", "")
    two, three = F.regexp_extract(bare, r"[^.]+\.[^.]+\z", 0), F.regexp_extract(bare, r"[^.]+\.[^.]+\.[^.]+\z", 0)
    long = two.isin(*TWO_LABEL_SUFFIXES)
    number = bare.rlike(r"\A[0-9.]+\z")
    last = F.regexp_extract(bare, r"[^.]*\z", 0)
    suffix = F.when(number, "").when(long, two).otherwise(last)
    domain = F.when(number, bare).when(long & (three != ""), three).when(two != "", two).otherwise(bare)
    return domain, suffix


def _strength(groups: DataFrame) -> float:
    """Prior strength of a level from its groups (x bad of n, parent rate m)."""
    spread = F.col("m") * (1 - F.col("m"))
    r = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("m"), F.lit(2.0))).alias("s"),
        F.sum(spread).alias("e"), F.sum(spread * (F.col("n") - 1)).alias("d"),
    ).first()
    if not r["d"] or r["s"] <= r["e"]:
        return STRENGTH[1]
    return min(max(r["d"] / (r["s"] - r["e"]) - 1, STRENGTH[0]), STRENGTH[1])


def _posterior(groups: DataFrame, rate: str) -> tuple[DataFrame, float]:
    strength = _strength(groups)
    return groups.withColumn(rate, (F.col("m") * strength + F.col("x")) / (strength + F.col("n"))), strength


def reputation(pages: DataFrame, outcomes: DataFrame, *, z: float = 1.645) -> DataFrame:
    """One row per host of ``pages`` (page_id, host): labels n and x (bad), posterior ``rate``
    and lower ``bound``. ``outcomes``: page_id, bad."""
    labels = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").select("page_id", F.col("bad").cast("int").alias("bad"))
    sums = pages.join(labels, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("x"), F.count("bad").cast("double").alias("n"),
    )
    domain, suffix = domain_columns(F.col("host"))
    hosts = staged(sums.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    whole = hosts.agg(F.sum("x").alias("x"), F.sum("n").alias("n")).first()
    # an empty host groups nothing: no labels of its own, no neighbours (a slash is in no host)
    none = F.col("host") == ""
    hosts = hosts.withColumns({
        **{c: F.when(none, 0.0).otherwise(F.col(c)) for c in ("x", "n")}, **{c: F.when(none, "/").otherwise(F.col(c)) for c in ("domain", "suffix")},
    })
    mean = ((whole["x"] or 0.0) + 0.5) / ((whole["n"] or 0.0) + 1.0)

    add = [F.sum("x").alias("x"), F.sum("n").alias("n")]
    suffixes, _ = _posterior(hosts.groupBy("suffix").agg(*add).withColumn("m", F.lit(mean)), "rate")
    above = suffixes.select("suffix", F.col("rate").alias("m"))
    domains, _ = _posterior(hosts.groupBy("suffix", "domain").agg(*add).join(above, "suffix"), "rate")
    above = staged(domains.select("suffix", "domain", F.col("rate").alias("m")), "domains")
    judged, strength = _posterior(hosts.join(above, ["suffix", "domain"]), "rate")
    width = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (strength + F.col("n") + 1))
    return judged.select("host", "n", "x", "rate", (F.col("rate") - z * width).alias("bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url", threshold: float = 0.5, z: float = 1.645,
) -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule, verdict, bound."""
    address = name(url).cast("string")
    parts = pages.select(name(page_id).alias("page_id"), address.alias("url"), host_of(address).alias("host"), path_of(address).alias("path"))
    known = reputation(parts.select("page_id", "host"), outcomes, z=z).select("host", "bound")
    rule, says = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return parts.join(known, "host", "left").select("page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(says, own).alias("verdict"), "bound")

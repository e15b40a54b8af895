"""The state of a crawl as tables."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from tessera.functions import urls as U

MOST_WEIGHT = (1 << 24) - 1
#: Domains that are never taken for link farms.
NO_FARMS = ("wikipedia.org", "wiktionary.org", "wikimedia.org", "wikiquote.org", "wikiversity.org", "wikimediafoundation.org", "wikinews.org")


def without_self_links(edges: DataFrame) -> DataFrame:
    """edges(src, dst) that lead elsewhere."""
    return edges.where(~F.col("src").eqNullSafe(F.col("dst")))


def common_domains(edges: DataFrame, threshold: int = 200) -> DataFrame:
    """Per page of edges(src, dst), how many links share its company domain; -1 for a link farm.

    A farm has links to more than half of ``threshold`` other hosts of its domain whose first
    label has more than three letters, or more than ``threshold`` links to one of them. Links are
    counted by host first, so that a page of many links is no single group.
    """
    own, other = U.company_domain(F.col("src")), U.host_name(F.col("dst"))
    rows = edges.withColumns({"_same": U.company_domain(F.col("dst")) == own, "_host": other})
    far = F.col("_same") & (F.col("_host") != U.host_name(F.col("src"))) & (F.length(F.element_at(F.split("_host", r"\."), 1)) > 3)
    by_host = rows.groupBy("src", "_host").agg(F.count_if("_same").alias("n"), F.count_if(far).alias("m"))
    out = by_host.groupBy("src").agg(F.sum("n").alias("common"), F.count_if(F.col("m") > 0).alias("hosts"), F.max("m").alias("most"))
    farm = ((F.col("hosts") > threshold / 2) | (F.col("most") > threshold)) & ~own.isin(*NO_FARMS)
    return out.select("src", F.when(farm, -1).otherwise(F.col("common")).alias("common"))


def spread_weight(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """(url, weight) that the pages of weights(src, w) pass to the targets of edges(src, dst).

    Of n links, each one within the page's company domain gets floor(w / 2n), the others share the rest equally.
    """
    same = U.company_domain(F.col("dst")) == U.company_domain(F.col("src"))
    counts = edges.groupBy("src").agg(F.count("*").alias("n"), F.count_if(same).alias("c")).join(weights, "src")
    common = F.floor(F.col("w") / (2 * F.col("n")))
    counts = counts.select("src", common.alias("near"), F.floor((F.col("w") - common * F.col("c")) / F.greatest(F.col("n") - F.col("c"), F.lit(1))).alias("far"))
    each = edges.join(counts, "src").select(F.col("dst").alias("url"), F.when(same, F.col("near")).otherwise(F.col("far")).alias("w"))
    return each.groupBy("url").agg(F.least(F.sum("w"), F.lit(MOST_WEIGHT)).alias("weight"))


def merge_queue(queue: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
    """queue(url, weight, depth) with found urls of the same columns: what was seen goes, weights of a url add up, its least depth stands."""
    both = queue.select("url", "weight", "depth").unionByName(found.select("url", "weight", "depth"))
    merged = both.groupBy("url").agg(F.least(F.sum("weight"), F.lit(MOST_WEIGHT)).alias("weight"), F.min("depth").alias("depth"))
    return merged.join(seen.select("url"), "url", "left_anti")


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct urls that were not seen."""
    return urls.select("url").distinct().join(seen.select("url"), "url", "left_anti")


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url) with ``allowed`` by rules(host, kind 'allow' or 'disallow', pattern); hosts without rules allow all.

    Patterns are regular expressions of ``urls.path_rule_regex``; a host's rules are few and
    gathered into its row before the join.
    """
    by_host = rules.groupBy("host").agg(F.collect_list(F.struct("kind", "pattern")).alias("rules"))
    rows = urls.withColumn("host", U.host_name(F.col("url"))).join(by_host, "host", "left")
    target = U.path(F.col("url"))
    any_of = lambda kind: F.coalesce(F.exists("rules", lambda r: (r["kind"] == kind) & F.rlike(target, r["pattern"])), F.lit(False))
    return rows.withColumn("allowed", any_of("allow") | ~any_of("disallow")).drop("rules", "host")


def host_filter(results: DataFrame, blocked: DataFrame) -> DataFrame:
    """results(url) whose host is not in blocked(host)."""
    return results.withColumn("_h", U.host_name(F.col("url"))).join(blocked.select(F.col("host").alias("_h")).distinct(), "_h", "left_anti").drop("_h")


def domain_cull(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """P25: urls of the company domain itself (or its www host), or whose domain isn't in domains(domain)."""
    rows = urls.withColumn("_d", U.company_domain(F.col("url"))).join(domains.select(F.col("domain").alias("_d"), F.lit(True).alias("_known")).distinct(), "_d", "left")
    return rows.where(U.host_name(F.col("url")).isin(F.col("_d"), F.concat(F.lit("www."), "_d")) | F.col("_known").isNull()).drop("_d", "_known")


def ready(queue: DataFrame, waiting: DataFrame, most: int) -> DataFrame:
    """The heaviest url of each host that is not waiting, the ``most`` heaviest of these."""
    rows = queue.withColumn("host", U.host_name(F.col("url"))).join(waiting.select("host"), "host", "left_anti")
    best = rows.groupBy("host").agg(F.max_by("url", F.struct("weight", "url")).alias("url"), F.max("weight").alias("weight"))
    return best.orderBy(F.desc("weight"), "url").limit(most)


def stale(urls: DataFrame, cached: DataFrame, now: int) -> DataFrame:
    """Urls to fetch again: without an entry in cached(url, expires), or with one that has run out."""
    return urls.join(cached.where(F.col("expires") >= now).select("url"), "url", "left_anti")


def canonical_edges(pages: DataFrame, least: int = 3) -> DataFrame:
    """(url, canonical) of pages(url, html) whose rel=canonical link differs by more than ``least`` edits."""
    found = F.regexp_extract("html", r'<link[^>]*rel="canonical"[^>]*href="([^"]+)"', 1)
    return pages.select("url", found.alias("canonical")).where((F.col("canonical") != "") & (F.levenshtein("url", "canonical") > least))


@F.pandas_udf(K.DoubleType())
def information(text: pd.Series) -> pd.Series:
    """Words of a link text times its compressed share, at most 1."""
    out = []
    for t in text.fillna(""):
        raw = t.encode()
        out.append(float(pd.Series([t]).str.split(r"[\s\-_~]+", regex=True).str.len()[0]) * min((len(zlib.compress(raw)) + 1) / (len(raw) + 1), 1.0))
    return pd.Series(out)


def prune_links(links: DataFrame, most: int) -> DataFrame:
    """The ``most`` links(page, dst, text) of each page that tell most; ties by target."""
    told = links.groupBy("page", "dst").agg(F.sum(information("text")).alias("told"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("told"), "dst"))
    return told.withColumn("rank", rank).where(F.col("rank") <= most)


def merge_statuses(rows: DataFrame, channel: str, at: str, counts: Sequence[str], highs: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Per channel counts are summed, ``highs`` are greatest, and ``texts`` are those of the latest row."""
    return rows.groupBy(channel).agg(
        *[F.sum(c).alias(c) for c in counts], *[F.max(c).alias(c) for c in highs], *[F.max_by(c, F.struct(at, c)).alias(c) for c in texts]
    )


def stalled(rows: DataFrame, channel: str, flag: Column) -> DataFrame:
    """Channels all of whose machines are stalled."""
    return rows.groupBy(channel).agg(F.bool_and(flag).alias("stalled"))


def remap(docs: DataFrame, moves: DataFrame, key: str, value: str) -> DataFrame:
    """K3: ``value`` of the rows that moves(key, new) names; others keep theirs."""
    return docs.join(moves.select(key, "new"), key, "left").withColumn(value, F.coalesce("new", value)).drop("new")


def crawl_lists(*lists: DataFrame) -> DataFrame:
    """U-9: the union of lists by column name; what a list doesn't have is null."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out

"""URL filters: longest-match rules, then trust and distrust propagated over the graph of hosts.

Rules hold for a host and its subdomains where the url's path starts with theirs; the longest wins (host, then path). Hosts
without a rule are judged by their neighbourhood: personalised PageRank from trusted hosts runs along links, and distrust
runs from blocked hosts against them (who links to a bad host is bad). Edges are the hyperlinks between hosts, and with ``parents`` a link from a
subdomain to its parent domain, if that is a host of the table or a link's target; a link counts by its share of the host's links. A host without
out-links returns its mass to the seeds, which scales all ranks of a kind alike; they are given on the scale where one seed's restart is 1. Rounds
go on until the ranks still to come are below TOLERANCE of the restart. A host is blocked if its distrust exceeds its trust by more than MARGIN.

Nulls and edges: a null url or one without "://" has an empty host and path and is allowed unless a rule fits; a null html has no links;
repeated rows count their links again; without seeds of a kind its ranks are 0. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed values: (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, MARGIN = 0.85, 1e-3, 0.5
STRIDE = 4  # rounds between two stored ones
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>#?]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules are a fixed list given by the caller."""
    rule = verdict = F.lit(None).cast("string")
    for kind, own, prefix in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        rule, verdict = F.when(fits, own + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, parents: bool = False) -> DataFrame:
    """(src, dst, links) between different hosts; pages shrink to counts per pair before they are shuffled."""
    host, _ = host_path(F.col("url"))
    linked = pages.select(host.alias("src"), F.explode(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda u: host_path(u)[0])).alias("dst"))
    links = linked.filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("links"))
    if not parents:
        return links
    hosts = pages.select(host.alias("h")).distinct().unionByName(links.select(F.col("dst").alias("h"))).distinct().filter("h != ''")
    up = hosts.select(F.col("h").alias("src"), F.regexp_replace("h", r"^[^.]+\.", "").alias("dst")).filter("src != dst").join(hosts.select(F.col("h").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1).cast("long").alias("links"))
    return links.unionByName(up).groupBy("src", "dst").agg(F.sum("links").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, kind, rank): both rankings in one run. seeds: (host, kind, share); trust flows along edges, distrust against them."""
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "links").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "links"))
    totals = ways.groupBy("kind", "host").agg(F.sum("links").alias("all"))
    ways = stored(ways.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("all")).alias("w")), "ways")
    start = stored(seeds.select("kind", "host", "share"), "seeds")
    if ways.isEmpty():
        return start.select("host", "kind", F.col("share").alias("rank"))
    moved, ranks = start.withColumnRenamed("share", "rank"), start.withColumnRenamed("share", "rank")
    # What moves in a round is damping times what moved before, at most: the sum of all rounds to come is known from the last.
    while True:
        for _ in range(STRIDE):
            moved = moved.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("rank") * F.col("w") * damping).alias("rank"))
            ranks = ranks.unionByName(moved)
        moved = stored(moved, "moved")
        ranks = stored(ranks.groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
        left = moved.groupBy("kind").agg(F.sum("rank").alias("m")).agg(F.max("m")).first()[0] or 0.0
        if left * damping / (1 - damping) <= tolerance:
            return ranks.select("host", "kind", "rank")


def judge(pages: DataFrame, rules=RULES, margin: float = MARGIN, parents: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages."""
    host, path = host_path(F.col("url"))
    # A host is a seed by what the rules say of the pages seen under it: all pages of a host weigh as one.
    seen = pages.select(host.alias("host"), path.alias("path"))
    seen = seen.withColumn("verdict", rule_for(F.col("host"), F.col("path"), rules)[1]).filter("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block"))
    weights = stored(seen.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("allow") / F.col("n")).alias("w")), F.struct(F.lit("distrust").alias("kind"), (F.col("block") / F.col("n")).alias("w")))).alias("s")).select("host", "s.kind", "s.w").filter("w > 0"), "weights")
    sums = weights.groupBy("kind").agg(F.sum("w").alias("all"))
    seeds = weights.join(F.broadcast(sums), "kind").select("host", "kind", (F.col("w") / F.col("all")).alias("share"))
    ranks = propagate(host_edges(pages, parents), seeds).join(F.broadcast(sums), "kind")
    # In units of one seed, so that the threshold doesn't depend on the number of hosts.
    hosts = ranks.groupBy(F.col("host").alias("_host")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("rank") * F.col("all")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_v")).join(hosts, F.col("host") == F.col("_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(distrust - trust > margin, "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))

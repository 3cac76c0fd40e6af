"""Filters on addresses: rules on host and path, and trust spread over the graph of host links.

Where no rule speaks, a host is judged by two personalised page ranks over the host edges: trust
flows from hosts whose pages are allowed along the links, distrust flows from hosts whose pages are
blocked against them (who links to a blocked host is suspect). Each is divided by the rank that flows
the same way from all pages, so a score is the share of a host's rank that is allowed or blocked: it lies
in 0..1 and does not depend on the size of the table. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import free_name, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a score that flows on along the links.
FLOW = 0.85
#: Ranks are spread until no host's rank grows by more than this share of it in a round, or until
#: MOST_ROUNDS, when 0.85^100, a ten-millionth of the mass, is unspread.
TOLERANCE = 1e-6
MOST_ROUNDS = 100
#: Rounds between two written tables of ranks, each with a look at the growth.
WRITE_EVERY = 4
#: A host is blocked if its share of distrust is LEAST or more, and over RATIO times its share of trust.
LEAST = 0.5
RATIO = 1.0
#: Digits of a share, so that the order of sums is no matter.
DIGITS = 5
_LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """Name of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, rule.name).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    said = F.lit(None).cast("string")
    for r in rules:
        said = F.when(rule == r.name, r.verdict).otherwise(said)
    return said


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target, links): links between differing hosts, counted."""
    links = F.regexp_extract_all(F.col(html), F.lit(_LINK), 1)
    full = F.transform(links, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    return (
        pages.select(host_of(F.col(url)).alias("source"), F.explode(full).alias("link"))
        .select("source", host_of(F.col("link")).alias("target"))
        .where((F.col("source") != "") & (F.col("target") != "") & (F.col("source") != F.col("target")))
        .groupBy("source", "target").agg(F.count("*").alias("links"))
    )


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, share): what part of a host's page rank comes from the marked pages.

    ``seeds`` (host, marked, pages) sends its marked and its other pages along ``edges`` (source, target,
    share). Both ranks are sums over the walks of each length; a round adds those one link longer, from
    what the last round brought, and both flow in one join.
    """
    start = [F.col(c).cast("double") for c in ("marked", "pages")]
    ranks = seeds.select("host", start[0].alias("marked"), start[1].alias("pages"),
                         start[0].alias("new_marked"), start[1].alias("new_pages"))
    if not (edges.isEmpty() or seeds.where(F.col("marked") > 0).isEmpty()):
        for i in range(1, MOST_ROUNDS + 1):
            fresh = ranks.where(F.col("new_pages") > 0).select(
                F.col("host").alias("source"), "new_marked", "new_pages")
            came = [(FLOW * F.col(c) * F.col("share")) for c in ("new_marked", "new_pages")]
            moved = edges.join(fresh, "source").select(
                F.col("target").alias("host"), came[0].alias("marked"), came[1].alias("pages"),
                came[0].alias("new_marked"), came[1].alias("new_pages"))
            stays = ranks.select("host", "marked", "pages", F.lit(0.0).alias("new_marked"), F.lit(0.0).alias("new_pages"))
            ranks = stays.unionByName(moved).groupBy("host").agg(
                *[F.sum(c).alias(c) for c in ("marked", "pages", "new_marked", "new_pages")])
            if i % WRITE_EVERY == 0:
                ranks = store(ranks, "host-ranks")
                if (ranks.agg(F.max(F.col("new_pages") / F.col("pages"))).first()[0] or 0.0) <= TOLERANCE:
                    break
    return ranks.where(F.col("pages") > 0).select(
        "host", F.round(F.col("marked") / F.col("pages"), DIGITS).alias("share"))


def host_scores(edges: DataFrame, votes: DataFrame) -> DataFrame:
    """(host, trust, distrust), both shares, from edges and ``votes`` (host, allowed, blocked, pages)."""
    edges = store(edges, "host-edges")
    votes = store(votes, "host-votes")

    def score(marked: str, source: str, target: str) -> DataFrame:
        out = edges.groupBy(source).agg(F.sum("links").alias("all"))
        shares = store(edges.join(out, source).select(
            F.col(source).alias("source"), F.col(target).alias("target"),
            (F.col("links") / F.col("all")).alias("share")), "host-shares")
        return spread(shares, votes.select("host", F.col(marked).alias("marked"), "pages"))

    trust = score("allowed", "source", "target").withColumnRenamed("share", "trust")
    distrust = score("blocked", "target", "source").withColumnRenamed("share", "distrust")
    return trust.join(distrust, "host", "full").fillna(0.0)


def judged(
    pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url", html: str = "html"
) -> DataFrame:
    """``pages`` with host, path, rule and verdict, under free names.

    A null url, or one without ``://``, has an empty host and path; no rule fits it and it is
    allowed. A null html has no links. Copying every row leaves all verdicts. Hosts that neither trust nor distrust reaches are allowed. Repeated
    rows are judged alike and stay. An empty table gives an empty result. The host table meets the
    pages in a left join, in which adaptive execution splits the rows of a frequent host.
    """
    host, path, rule, verdict, key = (
        free_name(pages, c) for c in ("host", "path", "rule", "verdict", "_judged_host"))
    rows = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))}).withColumn(
        rule, rule_for(F.col(host), F.col(path), rules))
    said = verdict_of(F.col(rule), rules)
    votes = rows.where(F.col(host) != "").groupBy(F.col(host).alias("host")).agg(
        F.count_if(said == "allow").alias("allowed"), F.count_if(said == "block").alias("blocked"),
        F.count("*").alias("pages"))
    bad = (F.col("distrust") >= LEAST) & (F.col("distrust") > RATIO * F.col("trust"))
    blocked = host_scores(host_edges(pages, url, html), votes).where(bad).select(F.col("host").alias(key))
    return rows.join(blocked, F.col(host) == F.col(key), "left").select(
        *pages.columns, host, path, rule,
        F.coalesce(said, F.when(F.col(key).isNotNull(), "block").otherwise("allow")).alias(verdict))

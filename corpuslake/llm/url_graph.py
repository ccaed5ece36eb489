"""URL filters (2): allow and block rules, and link-graph propagation for the hosts that rules leave open.

A rule is a host and a path prefix; it fits a url of that host or a subdomain whose path starts
so, and of several the longest decides.

Hosts are judged by two personalised PageRanks over host edges (links between pages of
two hosts, weighted by their number). Trust starts at the hosts of allowed pages and follows links;
distrust starts at the hosts of blocked pages and follows links backwards, as who links
to bad hosts is suspect. Each round keeps ``DAMPING`` of what flows and adds the rest from the seeds;
what a host without edges would pass on is left out. Masses only grow from round to round, and what moves shrinks by
``DAMPING`` at least; rounds go on until all that could still arrive is at most ``TOLERANCE`` of the mass (more than ``ROUNDS``
raise an error). A host is blocked if its distrust
is over ``ratio`` times its trust. Hosts that neither reaches stay allowed.

Links: ``href`` values with ``//`` go to the named host; all others stay on the page's own host and make no edge.

Edges are summed before anything is joined, so a page or host with many links is one row a pair. The
rounds run over tables written to the shared folder; the edges are read, not made, again.

Cases: a null url, or one without ``://``, has empty host and path; it fits no rule and takes no part in
the graph: allowed. A null html has no links. Rows with equal or null ids are judged one by one. Without
rules all pages are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import materialise

#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DAMPING, RATIO = 0.85, 1.0
#: Share of all mass that may still move when the rounds end, and rounds after which an error is raised.
TOLERANCE, ROUNDS = 1e-6, 200
#: Rounds that are planned together; their result is written and measured.
TOGETHER = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?is)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Rules are given by the caller and few."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [
        F.when(
            ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for h, p, verdict in longest_first
    ]
    return F.coalesce(*fits)


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight) from columns ``host`` and ``html``; links within a host are left out."""
    links = pages.where(F.col("host") != "").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("target"))
    target = F.translate("target", UPPER, LOWER)
    return (
        links.select(F.col("host").alias("source"), target.alias("target"))
        .where("source <> target")
        .groupBy("source", "target")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def spread(
    edges: DataFrame, seeds: DataFrame, start: str, end: str, tolerance: float = TOLERANCE, damping: float = DAMPING, rounds: int = ROUNDS
) -> DataFrame:
    """(host, mass) of personalised PageRank along edges from column ``start`` to ``end``, to within ``tolerance`` of the mass.

    seeds: (host, seed), adding up to 1. Edges: with ``weight``. Not settled after ``rounds``, it raises an error.
    """
    out = edges.groupBy(start).agg(F.sum("weight").alias("total"))
    shares = materialise(edges.join(out, start).select(F.col(start).alias("host"), F.col(end).alias("to"), (F.col("weight") / F.col("total")).alias("share")), "shares")
    base = materialise(seeds.select("host", (F.col("seed") * (1 - damping)).alias("mass")), "base")
    if shares.isEmpty():
        return base
    mass, before = base, base.agg(F.sum("mass")).first()[0] or 0.0
    left = damping**TOGETHER / (1 - damping**TOGETHER)  # what may still come, to what came in the last TOGETHER rounds
    for _ in range(0, rounds, TOGETHER):
        now = mass
        for _ in range(TOGETHER):
            flow = now.join(shares, "host").select(F.col("to").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
            now = flow.union(base).groupBy("host").agg(F.sum("mass").alias("mass"))
        mass = materialise(now, "mass")
        total = mass.agg(F.sum("mass")).first()[0] or 0.0
        if (total - before) * left <= tolerance:
            return mass
        before = total
    raise RuntimeError(f"the masses did not settle to {tolerance} in {rounds} rounds")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    tolerance: float = TOLERANCE,
    damping: float = DAMPING,
    ratio: float = RATIO,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust), a row per page. pages: id, url, html."""
    named = pages.select(F.col(id_col).alias("id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = named.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    counts = materialise(
        ruled.where("host <> ''")
        .groupBy("host")
        .agg(*(F.count(F.when(F.col("fit.verdict") == v, 1)).cast("double").alias(v) for v in ("allow", "block"))),
        "hosts",
    )
    edges = materialise(host_edges(named), "edges")
    masses = []
    for verdict, (start, end), name in (("allow", ("source", "target"), "trust"), ("block", ("target", "source"), "distrust")):
        total = counts.agg(F.sum(verdict)).first()[0] or 1.0
        seeds = counts.where(F.col(verdict) > 0).select("host", (F.col(verdict) / total).alias("seed"))
        masses.append(spread(edges, seeds, start, end, tolerance, damping).select("host", F.col("mass").alias(name)))
    hosts = masses[0].join(masses[1], "host", "full")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    by_method = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return ruled.drop("html").join(hosts, "host", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", by_method).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )

"""URL verdicts: rules where one fits, else trust and distrust propagated over the host graph.

The host is what follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; the
path goes on up to `?`, `#` or the end. A rule fits its host and all subdomains if the path starts
with the rule's path; the longest rule wins, a block before an allow of the same length.

Hosts are vertices. Edges are links in the pages' html to another host, weighted by their number,
and, with weight `family`, a host and its nearest parent domain that has pages itself, both ways.
Trust is the personalised PageRank that starts at the pages allowed by rules; distrust is the same
on reversed edges, from the pages blocked by rules: who links to a blocked host is suspect. Both
add up to one over all hosts. Rounds go on until the change over all hosts is under `enough`. A host whose distrust is over `margin` times its trust is blocked,
for all pages that no rule fits.

Defined results: a null url, or one without `://`, has an empty host and path and is allowed
unless a rule fits; a null html has no links; hosts without any mass are allowed; without seeds
or edges there is nothing to propagate; repeated rows are judged one by one; an empty table gives
an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, store


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    margin: float = 2.0
    family: float = 1.0
    rounds: int | None = None  # a fixed number, for comparisons; else until the change is under `enough`
    enough: float = 1e-6


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def rules_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, `host/path`) pairs as a table: verdict, rule, rule_host, rule_path."""
    rows = spark.createDataFrame(list(rules), "verdict string, rule string")
    cut = F.instr("rule", "/")
    return rows.select("verdict", "rule", F.substring("rule", F.lit(1), cut - 1).alias("rule_host"),
                       F.substring("rule", cut, F.length("rule")).alias("rule_path"))


def _applicable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those of the host and its parents, the winning order first."""
    named = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host"))
    order = F.struct((-F.length("rule")).alias("l"), (F.col("verdict") == "allow").alias("a"), "rule", "rule_path", "verdict")
    return named.join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_set(order)).alias("rules"))


def _fitting(host_rules: Column, path: Column) -> Column:
    return F.get(F.filter(host_rules, lambda r: F.startswith(path, r["rule_path"])), F.lit(0))


def host_edges(pages: DataFrame, hosts: DataFrame, family: float) -> DataFrame:
    """src, dst, weight for different hosts; `pages` has host and html."""
    targets = F.regexp_extract_all("html", F.lit("(?i)(?:href|src)\\s*=\\s*[\"']?(?:https?:)?//([^/?#\"'\\s>]+)"), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode_outer(targets).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("dst is not null and src <> dst")
    edges = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    parents = hosts.select("host", F.posexplode(_suffixes(F.col("host"))).alias("up", "parent")).where("up > 0")
    nearest = parents.join(hosts.select(F.col("host").alias("parent")), "parent").groupBy("host").agg(
        F.min_by("parent", "up").alias("parent"))
    weight = F.lit(float(family))
    both = nearest.select(F.col("host").alias("src"), F.col("parent").alias("dst"), weight.alias("weight")).unionByName(
        nearest.select(F.col("parent").alias("src"), F.col("host").alias("dst"), weight.alias("weight")))
    return edges.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, rule: Propagation = Propagation()) -> DataFrame:
    """host, trust, distrust. `seeds` has host, allowed and blocked (page counts) for every host with
    pages; hosts that only occur in edges join in. Every round is stored."""
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).head()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    share = lambda c, n: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(n or 1))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out")).withColumnRenamed("src", "host")
    into = edges.groupBy("dst").agg(F.sum("weight").alias("into")).withColumnRenamed("dst", "host")
    start = seeds.join(ends, "host", "full").join(out, "host", "left").join(into, "host", "left").select(
        "host", share("allowed", total["a"]).alias("st"), share("blocked", total["b"]).alias("sb"), "out", "into")
    state = store(start.withColumns({"trust": F.col("st"), "distrust": F.col("sb")}), "hosts")
    edges = store(edges, "edges")
    d = rule.damping
    # a round shrinks the change by the damping at least, so the end is certain
    for _ in itertools.count() if rule.rounds is None else range(rule.rounds):
        lost = state.agg(F.sum(F.when(F.col("out").isNull(), F.col("trust"))).alias("t"),
                         F.sum(F.when(F.col("into").isNull(), F.col("distrust"))).alias("b")).head()
        source = state.select(F.col("host").alias("src"), (F.col("trust") / F.col("out")).alias("each"))
        target = state.select(F.col("host").alias("dst"), (F.col("distrust") / F.col("into")).alias("each"))
        gained = edges.join(source, "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("weight") * F.col("each")).alias("t"))
        blamed = edges.join(target, "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("weight") * F.col("each")).alias("b"))
        moved = state.join(gained, "host", "left").join(blamed, "host", "left")
        trust = (1 - d + d * F.lit(lost["t"] or 0.0)) * F.col("st") + d * F.coalesce("t", F.lit(0.0))
        distrust = (1 - d + d * F.lit(lost["b"] or 0.0)) * F.col("sb") + d * F.coalesce("b", F.lit(0.0))
        state = store(moved.select("host", "st", "sb", "out", "into", trust.alias("trust"), distrust.alias("distrust"),
                                   (F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))).alias("change")), "hosts")
        if (state.agg(F.sum("change")).head()[0] or 0.0) < rule.enough:
            break
        state = state.drop("change")
    return state.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules: DataFrame, rule: Propagation = Propagation()) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, host, path, rule, verdict."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    parts = parts.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    places = store(parts.select("page_id", "host", "path"), "urls")
    hosts = places.select("host").distinct()
    applicable = store(_applicable(hosts, rules), "host_rules")
    ruled = places.join(applicable, "host", "left").withColumn("fit", _fitting(F.col("rules"), F.col("path")))
    seeds = ruled.groupBy("host").agg(F.count_if(F.col("fit.verdict") == "allow").alias("allowed"),
                                      F.count_if(F.col("fit.verdict") == "block").alias("blocked"))
    edges = store(host_edges(parts.select("host", "html"), hosts, rule.family), "host_edges")
    standing = propagate(store(seeds, "seeds"), edges, rule)
    blocked = standing.where(F.col("distrust") > rule.margin * F.col("trust")).select("host", F.lit(True).alias("suspect"))
    known = hosts.join(applicable, "host", "left").join(blocked, "host", "left")
    judged = places.join(known, "host").withColumn("fit", _fitting(F.col("rules"), F.col("path")))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("suspect"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))

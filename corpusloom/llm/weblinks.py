"""URL filter: rules for hosts and paths, and trust that spreads over the host graph.

Pages under a rule have its verdict. All others are judged by their host:
personalised PageRank carries trust from hosts with allowed pages along links,
and distrust from hosts with blocked pages against them (who links to a bad host
is suspect). Hosts are linked by the absolute links of their pages, and a host
with its parent domain, more weakly, both ways.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.session import staged

# Letters that are folded, and the rules of the registered query.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING = 0.85
ROUNDS = 12  # of propagate() and of the twin, unless told to go on
STAGE_EVERY = 4
TOLERANCE = 1e-6  # change of a host's mass over STAGE_EVERY rounds, as a part of it, at which ranks are final
PARENT_WEIGHT = 0.1
BLOCK_RATIO = 2.0  # a host is blocked if its distrust exceeds this many times its trust


@dataclass(frozen=True)
class Rule:
    """A verdict for ``pattern``: a host, a slash, and the start of a path."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def _behind(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_behind(url), r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of ``pattern`` and ``verdict``, or null.

    Rules of equal length go by the longer host, then by the pattern. The list
    of rules is part of the plan and so stays short; each row tests all of them.
    """
    fits = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), len(r.host), r.pattern)):
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        named = F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))
        fits = F.when(inside & F.startswith(path, F.lit(rule.path)), named).otherwise(fits)
    return fits


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, weight)``: pages of host src that link to host dst, other than itself."""
    linked = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("target")
    found = pages.where("host != '' AND html IS NOT NULL").select(F.col("host").alias("src"), linked)
    bare = F.regexp_replace(F.regexp_replace("target", r"^[^@]*@", ""), r":\d*$", "")
    found = found.select("src", F.translate(bare, UPPER, LOWER).alias("dst")).where("dst != '' AND src != dst")
    return found.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """A host and its parent domain, both ways, up to the last but one label."""
    parts = F.split("host", r"\.")
    above = F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2)))
    suffix = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    steps = F.filter(F.transform(above, lambda n: F.struct(suffix(n).alias("src"), suffix(n - 1).alias("dst"))), lambda s: F.contains(s["dst"], F.lit(".")))
    up = hosts.where(F.size(parts) > 2).select(F.explode(steps).alias("s")).select("s.src", "s.dst").distinct()
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.withColumn("weight", F.lit(PARENT_WEIGHT))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(kind, host, mass)``: personalised PageRank for each kind of seed.

    ``edges`` (src, dst, weight) are followed forward by ``trust`` and backward by
    ``distrust``; ``seeds`` (kind, host, mass) are scaled to one per kind. What
    flows into a host is added up before the shuffle, so a host with very many
    links is no group in one task. Every few rounds the ranks are written to
    shared storage, so that a lost executor costs these rounds only. Without a
    number of ``rounds`` they go on until no host is new and no host's mass
    changes by more than ``TOLERANCE`` of itself, however far it is from a seed.
    """
    totals = seeds.groupBy("kind").agg(F.sum("mass").alias("total"))
    scaled = seeds.join(F.broadcast(totals), "kind")  # two rows
    scaled = staged(scaled.select("kind", "host", (F.col("mass") / F.col("total")).alias("seed")), "seeds")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    shares = both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    shares = staged(shares, "host-links")
    ranks = scaled.select("kind", "host", F.col("seed").alias("mass"))
    earlier, turn = ranks, 0
    while rounds is None or turn < rounds:
        turn += 1
        flows = shares.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"])
        moved = flows.select("kind", F.col("dst").alias("host"), (damping * F.col("mass") * F.col("share")).alias("mass"))
        kept = scaled.select("kind", "host", ((1 - damping) * F.col("seed")).alias("mass"))
        flowing = moved.unionByName(kept)
        if rounds is None and turn % STAGE_EVERY == 0:
            flowing = flowing.withColumn("old", F.lit(0.0)).unionByName(earlier.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("old")))
            compared = staged(flowing.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), "ranks")
            ranks = earlier = compared.drop("old")
            if compared.where(F.abs(F.col("mass") - F.col("old")) > TOLERANCE * F.col("mass")).isEmpty():
                break
            continue
        ranks = flowing.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
        if turn % STAGE_EVERY == 0 or turn == rounds:
            ranks = staged(ranks, "ranks")
    return ranks


def host_verdicts(pages: DataFrame, ratio: float = BLOCK_RATIO) -> DataFrame:
    """``(judged_host, trust, distrust, host_verdict)`` of every host that trust or distrust reaches.

    ``pages`` has host, html and ``fit`` (the rule struct). A host is blocked if
    its distrust exceeds ``ratio`` times its trust.
    """
    ruled = pages.where("fit IS NOT NULL AND host != ''")
    kind = F.when(F.col("fit.verdict") == "allow", "trust").otherwise("distrust")
    seeds = ruled.groupBy(kind.alias("kind"), "host").agg(F.count("*").cast("double").alias("mass"))
    hosts = pages.where("host != ''").select("host").distinct()
    edges = host_edges(pages).unionByName(parent_edges(hosts))
    edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    mass = propagate(edges, seeds, rounds=None).groupBy("host")
    by_kind = mass.agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    verdict = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return by_kind.select(F.col("host").alias("judged_host"), "trust", "distrust", verdict.alias("host_verdict"))


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, ratio: float = BLOCK_RATIO) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed, as is a host that neither trust nor distrust reaches.
    Repeated rows are judged alike and weigh as often as they occur; null html
    has no links; an empty table stays empty.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    fitted = base.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    hosts = host_verdicts(fitted, ratio)
    found = fitted.drop("html").join(hosts, F.col("host") == F.col("judged_host"), "left")
    verdict = F.coalesce("fit.verdict", "host_verdict", F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("fit.pattern").alias("rule"), verdict.alias("verdict"))

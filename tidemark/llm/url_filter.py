"""URL rules, and trust carried along links between hosts for what no rule decides.

Hosts whose pages the rules mostly allow are trusted seeds; hosts whose pages they mostly block are
blocked seeds. Personalised PageRank carries trust from the trusted seeds along host links; the same
walk on reversed links carries distrust from the blocked seeds to the hosts that link to them. A host
is blocked when its distrust reaches a threshold and exceeds its trust. All steps are DataFrame
operations; each round of the walk is one join and one pre-aggregated sum, cut by checkpoint().

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is
allowed; null html has no links; links to the page's own host and repeated links of a page to one
host count once or not at all; hosts that no walk reaches have trust and distrust 0 and are allowed.
Repeated rows are judged alike and count as pages each. An empty table gives no rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, set_checkpoint_dir

#: Host of an absolute or protocol-relative link of an anchor.
LINK_HOST = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: So many scored hosts (some 100 bytes each) are sent to every task.
BROADCAST_HOSTS = 200_000


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, then a path prefix that opens with a slash."""

    text: str
    allow: bool

    def fits(self, host: Column, path: Column) -> Column:
        name, slash, rest = self.text.partition("/")
        whole = F.concat(F.lit("."), host)
        return whole.endswith("." + name) & path.startswith(slash + rest)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judged_by_rules(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path and the longest rule that fits (of equal length: a blocking one, then by text)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", host.alias("host"), path.alias("path")
    )
    rule = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), not r.allow, r.text)):  # the last that fits stands
        rule = F.when(r.fits(F.col("host"), F.col("path")), r.text).otherwise(rule)
    return rows.withColumn("rule", rule)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst and the number of pages of src with a link to dst, for different hosts."""
    host, _ = host_and_path(F.col("url"))
    found = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("html")), F.lit(LINK_HOST), 1))
    rows = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pairs = rows.select(host.alias("src"), F.explode(found).alias("dst"))
    return pairs.filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("pages"))


def host_seeds(judged: DataFrame, rules: list[Rule]) -> DataFrame:
    """host, trusted and blocked (1.0 or 0.0): what the rules say of more than half of its pages."""
    allowed = F.col("rule").isin([r.text for r in rules if r.allow])
    blocked = F.col("rule").isin([r.text for r in rules if not r.allow])
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return judged.filter("host <> ''").groupBy("host").agg(
        (share(allowed) > 0.5).cast("double").alias("trusted"), (share(blocked) > 0.5).cast("double").alias("blocked")
    )


def propagate(links: DataFrame, seeds: DataFrame, damping: float, rounds: int, tolerance: float = 1e-9) -> DataFrame:
    """host, trust and distrust after at most ``rounds`` rounds, or fewer once no score moves by ``tolerance``."""
    set_checkpoint_dir(links.sparkSession)
    links = links.checkpoint()
    start = seeds.select(
        "host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "seed")
    ).filter("seed > 0")
    start = start.select("kind", "host", ((1 - damping) * F.col("seed")).alias("score")).checkpoint()
    scores = start
    if not links.isEmpty():
        steps = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("next"), "pages").union(
            links.select(F.lit("distrust"), "dst", "src", "pages")
        )
        total = steps.groupBy("kind", "host").agg(F.sum("pages").alias("total"))
        steps = steps.join(total, ["kind", "host"]).select(
            "kind", "host", "next", (damping * F.col("pages") / F.col("total")).alias("share")
        ).checkpoint()
        for _ in range(rounds):
            sent = scores.join(steps, ["kind", "host"]).select("kind", F.col("next").alias("host"), (F.col("score") * F.col("share")).alias("score"))
            after = start.union(sent).groupBy("kind", "host").agg(F.sum("score").alias("score")).checkpoint()
            moved = after.join(scores.withColumnRenamed("score", "before"), ["kind", "host"], "left").agg(
                F.max(F.abs(F.col("score") - F.coalesce("before", F.lit(0.0))))
            )
            scores = after
            if (moved.first()[0] or 0.0) < tolerance:
                break
    kind = lambda name: F.sum(F.when(F.col("kind") == name, F.col("score")).otherwise(0.0)).alias(name)
    return scores.groupBy("host").agg(kind("trust"), kind("distrust"))


def filter_urls(
    pages: DataFrame, rules: list[Rule], damping: float = 0.85, rounds: int = 30, threshold: float = 0.02
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every page."""
    judged = judged_by_rules(pages, rules)
    scores = propagate(host_links(pages), host_seeds(judged, rules), damping, rounds).checkpoint()
    if scores.count() <= BROADCAST_HOSTS:
        scores = F.broadcast(scores)  # else a shuffle by host, whose hot partitions Spark splits
    by_rule = F.when(F.col("rule").isin([r.text for r in rules if r.allow]), "allow").when(F.col("rule").isNotNull(), "block")
    by_walk = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, by_walk).alias("verdict"), *zero
    )

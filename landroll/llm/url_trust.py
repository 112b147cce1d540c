"""URL filter: prefix rules first, then trust and distrust propagated over the host link graph.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest fitting rule
decides. Hosts of pages that rules allow are trusted seeds, those of blocked pages distrusted seeds, each weighted by its share of
such pages. Personalised PageRank carries trust along links between hosts; distrust runs against the
links, from a blocked host to those that link to it. Rounds go on until no host is newly reached
and no host's trust or distrust changes by more than a small share of itself. A page without a rule is blocked when its host's distrust
exceeds its trust by the threshold's odds. Column expressions, joins and sums only.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is allowed; null html
has no links; links within a host and relative links are no edges; equal rows give equal rows and count as pages
of their own; no pages give no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import saved

#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
TOLERANCE = 1e-6  # largest change of a rank in the last round, as a share of that rank
THRESHOLD = 0.5  # blocked above this share of distrust
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_and_path(pages: DataFrame, url_col: str) -> DataFrame:
    """The table with columns __host and __path."""
    rows = pages.withColumn("__url", F.coalesce(url_col, F.lit("")))
    rest = F.expr("CASE WHEN instr(__url, '://') > 0 THEN substring(__url, instr(__url, '://') + 3) ELSE '' END")
    rows = rows.withColumn("__rest", rest).withColumn("__raw", F.regexp_extract("__rest", "^[^/?#]*", 0))
    rows = rows.withColumn("__path", F.regexp_extract(F.expr("substring(__rest, length(__raw) + 1)"), "^[^?#]*", 0))
    return rows.withColumn("__host", F.translate("__raw", UPPER, LOWER)).drop("__url", "__rest", "__raw")


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null when none does; equal rules: the first."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (source, target, links) between different hosts, counted before they are shuffled."""
    rows = host_and_path(pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")), "u")
    rows = rows.where("__host <> ''").select(F.col("__host").alias("source"), F.explode(F.regexp_extract_all("h", F.lit(LINK), F.lit(1))).alias("t"))
    rows = rows.select("source", F.translate("t", UPPER, LOWER).alias("target")).where("source <> target")
    return rows.groupBy("source", "target").agg(F.count("*").alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Seeds (host, trust, distrust) to ranks (host, trust, distrust) after the given rounds, or else once they stand.

    Once no rank changes by more than a share of itself, none does in any later round, and the rank moved falls by the damping.
    """
    links = saved(links, "host-links")
    sent = links.groupBy("source").agg(F.sum("links").alias("total"))
    got = links.groupBy("target").agg(F.sum("links").alias("total"))
    forward = links.join(sent, "source").select(F.lit(True).alias("good"), F.col("source").alias("from"), F.col("target").alias("to"), (F.col("links") / F.col("total")).alias("share"))
    backward = links.join(got, "target").select(F.lit(False).alias("good"), F.col("target").alias("from"), F.col("source").alias("to"), (F.col("links") / F.col("total")).alias("share"))
    edges = saved(forward.union(backward), "host-edges")
    start = seeds.select(F.lit(True).alias("good"), "host", F.col("trust").alias("x")).union(seeds.select(F.lit(False), "host", "distrust"))
    start = saved(start.where("x > 0").withColumn("x", F.col("x") * (1 - damping)), "seeds")
    ranks, done = start, 0
    while rounds is None or done < rounds:
        moved = edges.join(ranks, (edges["good"] == ranks["good"]) & (edges["from"] == ranks["host"]))
        moved = moved.select(edges["good"], F.col("to").alias("host"), (F.col("x") * F.col("share") * damping).alias("x"))
        added = start.union(moved).withColumn("last", F.lit(0.0)).union(ranks.select("good", "host", F.lit(0.0), "x"))
        ranks = saved(added.groupBy("good", "host").agg(F.sum("x").alias("x"), F.sum("last").alias("last")), "ranks")
        done += 1
        if rounds is None and not ranks.agg(F.max(F.abs(F.col("x") - F.col("last")) > tolerance * F.col("x"))).first()[0]:
            break
    pick = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("x"))), F.lit(0.0))
    return ranks.groupBy("host").agg(pick(True).alias("trust"), pick(False).alias("distrust"))


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: Sequence[tuple[str, str, str]] = RULES,
    rounds: int | None = None, damping: float = DAMPING, threshold: float = THRESHOLD,
) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust and distrust of its host."""
    rows = host_and_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")), "u")
    rows = rows.withColumn("__rule", fitting_rule(F.col("__host"), F.col("__path"), rules))
    rows = rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), "__rule.rule", F.col("__rule.verdict").alias("ruled"))
    counts = rows.where("ruled IS NOT NULL").groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    counts = saved(counts, "seeded")
    totals = counts.agg(F.sum("good"), F.sum("bad")).first()
    share = lambda c, n: F.col(c) / F.lit(float(n or 1))
    seeds = counts.select("host", share("good", totals[0]).alias("trust"), share("bad", totals[1]).alias("distrust"))
    ranks = saved(propagate(host_links(pages, url_col, html_col), seeds, rounds, damping), "host-ranks")
    out = rows.join(ranks, "host", "left")
    doubtful = F.col("distrust") > F.lit(threshold) * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce("ruled", F.when(doubtful, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

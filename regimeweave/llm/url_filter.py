"""URL verdicts: fixed rules first, then trust and distrust spread over the graph of host links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimeweave.llm.common import ascii_lower, stage

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.85
#: Rounds end when all moves of one together are this part of an even share of the scores.
TOLERANCE = 1e-3
#: A host is blocked if distrust is this share of both scores, and this many times an even share of all distrust.
SHARE, FLOOR = 0.5, 0.1
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host, the rules that fit it or a domain above it, longest first.

    Hosts meet rules in an equi-join on their suffixes, so any number of rules is fine.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    split = rules.select(
        "rule",
        F.col("verdict").alias("rule_verdict"),
        F.substring_index("rule", "/", 1).alias("_suffix"),
        F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"),
    )
    pairs = hosts.select("host", F.explode(suffixes).alias("_suffix")).join(split, "_suffix")
    entry = F.struct((-F.char_length("rule")).alias("order"), "rule", "rule_path", "rule_verdict")
    return pairs.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("rules"))


def host_links(pages: DataFrame) -> DataFrame:
    """Distinct edges between different hosts, with the number of links."""
    host, _ = host_and_path(F.col("url"))
    target = F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    return (
        pages.select(host.alias("src"), target.alias("dst"))
        .withColumn("dst", ascii_lower(F.col("dst")))
        .where("src != dst and src != '' and dst != ''")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def spread(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: ``nodes`` (host, seed), ``edges`` (src, dst, share); returns (host, score).

    Score of hosts without an outgoing edge returns to the seeds. Each round is one join of the
    edges with the scores and one partial aggregate, written to shared storage; it stops when
    the moves of all scores sum to at most ``tolerance`` even shares (1 / hosts). A round shrinks that sum by
    ``damping`` at least, so rounds grow with the logarithm of the hosts, and no score is further
    than ``tolerance * damping / (1 - damping)`` even shares from its limit.
    """
    scores = nodes.withColumn("score", F.col("seed"))
    least = tolerance / max(1, nodes.count())
    while True:
        sent = edges.join(scores.select(F.col("host").alias("src"), "score"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("_in"))
        received = scores.join(sent, "host", "left").withColumn("_in", F.coalesce("_in", F.lit(0.0)))
        received = stage(received)
        total = received.agg(F.coalesce(F.sum("_in"), F.lit(0.0)).alias("_sent"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("_all"))
        back = (1 - damping) + damping * (F.col("_all") - F.col("_sent"))
        new = F.col("seed") * back + damping * F.col("_in")
        scores = stage(received.crossJoin(F.broadcast(total)).select("host", "seed", new.alias("score"), F.abs(new - F.col("score")).alias("_moved")))
        moved = scores.agg(F.sum("_moved")).first()[0]
        scores = scores.drop("_moved")
        if not moved or moved <= least:
            return scores.select("host", "score")


def judge(pages: DataFrame, rules: DataFrame, damping: float = DAMPING, share: float = SHARE, floor: float = FLOOR) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every row of ``pages``.

    ``rules`` (rule, verdict) look like ``host/path``; the longest that fits the host (or a domain above
    it) and the start of the path decides, and gives its text. Other pages take their host's
    verdict: trust flows along links from hosts with an allow rule, distrust against them from
    hosts blocked as a whole (a block rule of path ``/``); a host is blocked when distrust is
    more than ``share`` of both and over ``floor`` even shares, else allowed. A null url or one without
    ``://`` has the empty host, which no rule fits; it is allowed. Null html has no links; rows that repeat an id are judged
    one by one.

    Links are counted per pair of hosts before anything else, so a host with a third of all
    pages is one node; pages meet hosts in one join, which adaptive execution splits on a hot host.
    """
    host, path = host_and_path(F.col("url"))
    located = pages.select("page_id", host.alias("host"), path.alias("path"))
    edges = stage(host_links(pages))
    hosts = located.select("host").where("host != ''").union(edges.select("src")).union(edges.select("dst")).distinct()
    fitted = stage(hosts.join(host_rules(hosts, rules), "host", "left"))

    trusted = F.exists("rules", lambda r: r["rule_verdict"] == "allow")
    blocked = F.exists("rules", lambda r: (r["rule_verdict"] == "block") & (r["rule_path"] == "/"))
    marks = fitted.select("host", F.coalesce(blocked, F.lit(False)).alias("bad"), F.coalesce(trusted, F.lit(False)).alias("good"))
    marks = marks.withColumn("good", F.col("good") & ~F.col("bad"))
    counts = marks.agg(F.greatest(F.count_if("good"), F.lit(1)).alias("n_good"), F.greatest(F.count_if("bad"), F.lit(1)).alias("n_bad"), F.greatest(F.count("*"), F.lit(1)).alias("n"))
    seeds = stage(
        marks.crossJoin(F.broadcast(counts)).select(
            "host", (F.col("good").cast("double") / F.col("n_good")).alias("good"), (F.col("bad").cast("double") / F.col("n_bad")).alias("bad"), "n"
        )
    )
    out = edges.groupBy("src").agg(F.sum("links").alias("_all"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("_all"))
    forward = stage(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("_all")).alias("share")))
    backward = stage(edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("links") / F.col("_all")).alias("share")))
    trust = spread(seeds.select("host", F.col("good").alias("seed")), forward, damping).withColumnRenamed("score", "trust")
    distrust = spread(seeds.select("host", F.col("bad").alias("seed")), backward, damping).withColumnRenamed("score", "distrust")
    bad = (F.col("distrust") > share * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") * F.col("n") > floor)
    verdicts = (
        fitted.join(seeds.select("host", "n"), "host")
        .join(trust, "host")
        .join(distrust, "host")
        .select("host", "rules", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("_verdict"))
    )
    fit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return located.join(stage(verdicts), "host", "left").withColumn("_fit", fit).select(
        "page_id",
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.rule_verdict"), F.col("_verdict"), F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def rule_table(spark, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The given rules as a table made of literals."""
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules])
    return spark.range(1).select(F.inline(rows))

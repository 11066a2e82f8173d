"""URL rules, and host trust by propagation over the link graph.

A rule is a host with a path prefix, and fits that host and its subdomains; the longest fitting rule decides. For urls
that no rule fits, the host decides, by personalised PageRank over host-to-host links: trust flows along links from hosts of which
rules allow more pages than they block (weighted by the difference of the shares), distrust against links from hosts most of whose pages
are blocked (weighted by that share).
A host is blocked if its share of distrust, as a multiple of the mean over hosts, reaches ``THRESHOLD`` and is above its trust.

Nodes are all hosts of pages and of absolute links; edges are counted by host pair before they move, and each step is a join and
a sum of one row per edge. Steps are written to the shared folder, so lineage stays short.

Cases: a null url, or one without ``://``, has empty host and path; no rule fits it and it is allowed. Repeated rows get
equal results; null html has no links; without links or seeds scores stay at the seeds' (or zero); an empty table gives an
empty result; other columns pass, but those named like a result (host, path, rule, verdict, trust, distrust) give way to it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.workspace import Workspace


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Share of a host's pages that rules must block to make it a seed of distrust.
SEED_SHARE = 0.5
DAMPING = 0.85
STEPS = 20
TOLERANCE = 1e-4
THRESHOLD = 1.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, letters, letters.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds to rows of distinct hosts the rules of each host and its parents: array of (size, rule, path, verdict), longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    one = F.struct(F.length(F.concat("rule_host", "path")).alias("size"), F.concat("rule_host", "path").alias("rule"), "path", "verdict")
    found = hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    fits = found.groupBy("host").agg(F.sort_array(F.collect_set(one), asc=False).alias("rules"))
    return hosts.join(fits, "host", "left")


def host_links(pages: DataFrame) -> DataFrame:
    """Links (src, dst, n) between different hosts, from absolute links in ``html``; src is the page's ``host``."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    target = pages.select(F.col("host").alias("src"), F.explode(links).alias("url"))
    target = target.select("src", host_of(F.concat(F.lit("x:"), F.regexp_replace("url", "^(?i:https?:)?", ""))).alias("dst"))
    return target.where("src != dst AND src != '' AND dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, work: Workspace, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """Rows (kind, host, score): personalised PageRank from seeds (kind, host, weight) along links (kind, src, dst, w), where the
    weights of a source sum to 1. What hosts without links hold flows back to the seeds."""
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("score"))
    start = work.keep(start, "start")
    score = start
    for step in range(steps):
        sent = score.withColumnRenamed("host", "src").join(links, ["kind", "src"]).groupBy("kind", "dst").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        sent = sent.select("kind", F.col("dst").alias("host"), (damping * F.col("got")).alias("score"))
        flown = sent.groupBy("kind").agg(F.sum("score").alias("flown"))
        back = start.join(flown, "kind", "left").select("kind", "host", (F.col("score") * (1 - F.coalesce("flown", F.lit(0.0)))).alias("score"))
        following = work.keep(sent.unionByName(back).groupBy("kind", "host").agg(F.sum("score").alias("score")), f"step{step}")
        other = score.withColumnRenamed("score", "was")
        moved = following.join(other, ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))))).first()[0] or 0.0
        if step > 1:
            work.drop(f"step{step - 1}")
        score = following
        if moved < TOLERANCE:
            break
    return score


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust (multiples of the mean over hosts)."""
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, rule_host string, path string")
    results = ("host", "path", "rule", "verdict", "trust", "distrust")
    rest = [c for c in pages.columns if c not in results]
    pages = pages.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_page"), "url", "html")
    parsed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    counted = work.keep(parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    ruled = work.keep(rules_of_hosts(counted.select("host"), rules), "rules")

    def first_fit(path: Column) -> Column:
        return F.get(F.filter("rules", lambda r: path.startswith(r.path)), F.lit(0))

    decided = parsed.select("host", "path").join(ruled, "host").select("host", first_fit(F.col("path"))["verdict"].alias("verdict"))
    shares = decided.groupBy("host").agg(
        (F.count_if(F.col("verdict") == "allow") / F.count(F.lit(1))).alias("allowed"), (F.count_if(F.col("verdict") == "block") / F.count(F.lit(1))).alias("blocked")
    )
    kinds = F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("allowed") - F.col("blocked")).alias("weight")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("weight")))).alias("s")
    seeds = shares.where("host != ''").select("host", kinds).select("s.kind", "host", "s.weight").where(F.col("weight") > F.when(F.col("kind") == "trust", 0.0).otherwise(SEED_SHARE))
    links = work.keep(host_links(parsed.select("host", "html")), "links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    weighed = work.keep(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")), "weights")
    score = propagate(seeds, weighed, work)
    wide = score.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("trust", "distrust")))
    nodes = counted.select("host").union(links.select("dst")).distinct().count()
    hosts = ruled.join(wide, "host", "left")
    scaled = {k: F.coalesce(F.col(k), F.lit(0.0)) * nodes for k in ("trust", "distrust")}
    hosts = work.keep(hosts.select("host", "rules", *(v.alias(k) for k, v in scaled.items())), "scored")
    work.drop_but("scored")
    fit = first_fit(F.col("path"))
    own = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    joined = parsed.join(hosts, "host").withColumn("_fit", fit)
    return joined.select("_page.*", "host", "path", F.col("_fit")["rule"].alias("rule"), F.coalesce(F.col("_fit")["verdict"], own).alias("verdict"), "trust", "distrust")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")

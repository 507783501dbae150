"""URL filters (operator 9): host and path rules, and trust spread over host links; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the contract.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class SpreadParams:
    """Damping and rounds of both walks, and the distrust at which a host is blocked.

    A host all of whose pages are blocked by rule starts with 1; ``threshold`` is a share of that.
    Hosts with more than one in ``large_hosts`` of all pages, so fewer than that many, get their
    scores by a broadcast; all others by a shuffle.
    """

    damping: float = 0.85
    rounds: int = 10
    threshold: float = 0.5
    large_hosts: int = 1000


def host_of(url: Column) -> Column:
    """After the first ``://``, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)" + HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)" + PATH, 1), F.lit(""))


def _suffixes(host: Column, labels: list[int]) -> Column:
    """The ends of the host with as many labels as ``labels`` names, or all of a shorter host."""
    ends = F.array(*[F.substring_index(host, ".", -n) for n in labels]) if labels else F.array().cast("array<string>")
    return F.array_distinct(ends)


def matched(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (row, host, path, ..) with rule and rule_verdict of the longest rule that fits, or nulls.

    Each page asks for the rules of those ends of its host that have as many labels as some
    rule's host (these numbers come to the driver), so a host of any length asks as often as a
    short one. A fitting rule is a row of the join, and the longest is kept by a maximum that
    combines before the shuffle.
    """
    labels = sorted(r.n for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("n")).where("rule_host <> ''").distinct().collect())
    asked = rows.where("host <> ''").select("row", "path", F.explode(_suffixes(F.col("host"), labels)).alias("rule_host"))
    fits = asked.join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("row").agg(F.max(F.struct(F.length(name).alias("n"), name.alias("rule"), F.col("verdict").alias("rule_verdict"))).alias("best"))
    return rows.join(best.select("row", "best.rule", "best.rule_verdict"), "row", "left")


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts, counted in the tasks first."""
    links = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    links = links.select("source", host_of(full).alias("target")).where("source <> '' and target <> '' and source <> target")
    return links.groupBy("source", "target").agg(F.count("*").alias("n"))


def spread(links: DataFrame, seeds: DataFrame, params: SpreadParams) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank.

    ``seeds`` has host, trust and distrust to start from. Trust follows links, distrust
    follows them backwards: who links to a distrusted host is distrusted. Both walks go
    through one join per round; what reaches a host without links leaves the walk. Shares
    of a host are summed in the tasks before the shuffle, and AQE splits hosts with many
    links.
    """
    forward = links.select(F.lit("t").alias("walk"), "source", "target", "n")
    edges = forward.union(links.select(F.lit("d"), F.col("target"), F.col("source"), "n"))
    total = edges.groupBy("walk", "source").agg(F.sum("n").alias("total"))
    edges = edges.join(total, ["walk", "source"]).select("walk", "source", "target", (F.col("n") / F.col("total")).alias("share"))
    edges = stage(edges, "host-edges")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("walk"), F.col("trust").alias("score")), F.struct(F.lit("d").alias("walk"), F.col("distrust").alias("score")))).alias("s"))
    start = stage(start.select("s.walk", "host", "s.score").where("score > 0"), "seeds")
    scores = start
    for i in range(params.rounds):
        reached = scores.withColumnRenamed("host", "source").join(edges, ["walk", "source"])
        moved = reached.select("walk", F.col("target").alias("host"), (F.col("score") * F.col("share") * params.damping).alias("score"))
        base = start.select("walk", "host", (F.col("score") * (1 - params.damping)).alias("score"))
        scores = base.union(moved).groupBy("walk", "host").agg(F.sum("score").alias("score"))
        if i % 4 == 3:
            scores = stage(scores, "scores")
    of = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(of("t").alias("trust"), of("d").alias("distrust"))


def _scored(rows: DataFrame, scores: DataFrame, sizes: DataFrame, params: SpreadParams) -> DataFrame:
    """``rows`` with their host's trust and distrust, or nulls; pages of a large host stay where they are."""
    large = sizes.where(F.col("pages") * params.large_hosts > rows.count()).select("host")
    large = F.broadcast(stage(large.join(scores, "host", "left"), "large-hosts"))
    others = rows.join(large.select("host"), "host", "left_anti").join(scores, "host", "left")
    return rows.join(large, "host").unionByName(others)


def judged(pages: DataFrame, rules: DataFrame, params: SpreadParams = SpreadParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, one row for each page.

    A rule's verdict stands. Of rules that fit equally long, that with the greater verdict
    stands. Without one, a page is blocked if its host's distrust is at least the threshold and
    more than its trust. A host's start is the share of its pages that rules allow or block.
    Null urls have an empty host and path and are allowed; null html has no links; urls may be
    of any length; repeated rows are judged each for itself; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "page-rows")
    rows = stage(matched(rows, rules), "ruled")
    share = lambda verdict: F.avg(F.when(F.col("rule_verdict") == verdict, 1.0).otherwise(0.0))
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"), share("allow").alias("trust"), share("block").alias("distrust"))
    hosts = stage(hosts, "hosts")
    scores = stage(spread(host_links(pages), hosts.where("host <> ''"), params), "host-scores")
    rows = _scored(rows, scores, hosts, params)
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bound = params.threshold * (1 - params.damping)
    own = F.when((distrust >= bound) & (distrust > trust), "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, verdict string")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judged(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def oracle(params: SpreadParams = SpreadParams()) -> str:
    """DuckDB SQL of ``op9_url_filters``: the rounds are spelt out one after the other."""
    d = f"{params.damping}::DOUBLE"
    host = "translate(coalesce(regexp_extract({}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    pattern = HREF.replace("'", "''")
    rounds = "".join(
        f"""s{i + 1} AS (SELECT walk, host, sum(score) AS score FROM (
  SELECT walk, host, score * (1 - {d}) AS score FROM s0 UNION ALL
  SELECT e.walk, e.target, s.score * e.share * {d} FROM s{i} s JOIN e ON s.walk = e.walk AND s.host = e.source) GROUP BY walk, host),
"""
        for i in range(params.rounds)
    )
    return f"""
WITH rules(rh, rp, v) AS (VALUES {rules}),
p AS (SELECT row_number() OVER () AS id, page_id, html, {host.format("url")} AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
ruled AS (SELECT p.id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN rules
  ON (p.host = rh OR p.host LIKE '%.' || rh) AND starts_with(p.path, rp) GROUP BY p.id),
f AS (SELECT p.*, r.rule, r.v FROM p LEFT JOIN ruled r USING (id)),
l AS (SELECT host AS source, unnest(regexp_extract_all(html, '{pattern}', 1)) AS link FROM p),
lh AS (SELECT source, {host.format("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS target FROM l),
h AS (SELECT source, target, count(*) AS n FROM lh WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2),
e0 AS (SELECT 't' AS walk, source, target, n FROM h UNION ALL SELECT 'd', target, source, n FROM h),
e AS (SELECT walk, source, target, n / sum(n) OVER (PARTITION BY walk, source) AS share FROM e0),
seeds AS (SELECT host, avg(CASE WHEN v = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN v = 'block' THEN 1.0 ELSE 0.0 END) AS distrust
  FROM f WHERE host <> '' GROUP BY host),
s0 AS (SELECT 't' AS walk, host, trust AS score FROM seeds WHERE trust > 0 UNION ALL SELECT 'd', host, distrust FROM seeds WHERE distrust > 0),
{rounds}last AS (SELECT host, sum(CASE WHEN walk = 't' THEN score ELSE 0 END) AS trust, sum(CASE WHEN walk = 'd' THEN score ELSE 0 END) AS distrust
  FROM s{params.rounds} GROUP BY host)
SELECT page_id, f.host, path, rule, coalesce(v, CASE WHEN coalesce(distrust, 0) >= {params.threshold} * (1 - {d}) AND distrust > coalesce(trust, 0)
  THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN last ON f.host = last.host
"""

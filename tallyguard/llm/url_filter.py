"""URL filter: path rules first; where no rule fits, trust and distrust spread over the host graph decide.

Trust is a personalised PageRank from hosts with allowed pages, along links. Distrust is the reverse: from hosts with blocked
pages it runs against the links, to those who link there. Both are bounded per host by one, so the threshold means the
same in a small graph and in a large one. The threshold is set on what a full seed passes on in one step: a host is blocked
when its distrust reaches half of that (half of its links go to blocked hosts, or more of them to hosts that link there) and is
above its trust. Links inside one host carry nothing. Everything is grouping and joining:
one edge row per pair of hosts with the number of links, partial counts before each shuffle, a fixed number of rounds.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed (no host speaks
against it); null html has no links; repeated rows count as further pages of their host and each gets its verdict; equally
long rules cannot both fit, as they differ in host and are then suffixes of one another; extra columns are ignored; an empty
table gives an empty result; a null page id is carried through; a very long url or page is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.llm.common import LOWER, UPPER, ascii_lower, staged

# fixed values: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, ROUNDS = 0.85, 8
SHARE, SLACK = 0.5, 1e-9  # the part of a full seed's one step that blocks; sums in another order differ by less than the slack
CUTOFF = SHARE * DAMPING * (1 - DAMPING) - SLACK
HOST, PATH = "://([^/?#]*)", "://[^/?#]*([^?#]*)"
# the host of an absolute link, in either case, or of one that starts with //
TARGET = r"""[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?(?:[hH][tT][tT][pP][sS]?:)?//([^/?#"'>\x20\x09-\x0D]*)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(name + start)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share): the share of a host's links to other hosts that go to one host."""
    c = F.col
    links = pages.select(c("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(TARGET), 1)).alias("dst")).select("src", ascii_lower(c("dst")).alias("dst"))
    pairs = links.filter((c("src") != c("dst")) & (c("src") != "") & (c("dst") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    totals = pairs.groupBy("src").agg(F.sum("n").alias("total"))
    return pairs.join(totals, "src").select("src", "dst", (c("n") / c("total")).alias("share"))


def host_scores(pages: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust), both from 0 to 1. ``pages`` has host, html and verdict (null without a rule)."""
    c = F.col
    seeds = pages.filter(c("host") != "").groupBy("host").agg(
        F.avg(F.when(c("verdict") == "allow", 1.0).otherwise(0.0)).alias("good"), F.avg(F.when(c("verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    edges = staged(host_edges(pages))
    hosts = seeds.unionByName(edges.select(c("dst").alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))).groupBy("host").agg(
        F.max("good").alias("good"), F.max("bad").alias("bad"))
    scores = staged(hosts.withColumns({"trust": (1 - DAMPING) * c("good"), "distrust": (1 - DAMPING) * c("bad")}))
    if edges.isEmpty():
        return scores
    for _ in range(rounds):
        trust = edges.join(scores.select(c("host").alias("src"), "trust"), "src").select(c("dst").alias("host"), (c("trust") * c("share")).alias("t"), F.lit(0.0).alias("d"))
        distrust = edges.join(scores.select(c("host").alias("dst"), "distrust"), "dst").select(c("src").alias("host"), F.lit(0.0).alias("t"), (c("distrust") * c("share")).alias("d"))
        moved = trust.unionByName(distrust).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        scores = staged(scores.join(moved, "host", "left").select(
            "host", "good", "bad",
            F.least(F.lit(1.0), (1 - DAMPING) * c("good") + DAMPING * F.coalesce("t", F.lit(0.0))).alias("trust"),
            F.least(F.lit(1.0), (1 - DAMPING) * c("bad") + DAMPING * F.coalesce("d", F.lit(0.0))).alias("distrust")))
    return scores


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    c = F.col
    base = pages.select(pages[page_id].alias(page_id), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"), pages[html].alias("html"))
    rule, verdict = rule_of(c("host"), c("path"))
    ruled = base.withColumns({"rule": rule, "verdict": verdict})
    blocked = host_scores(ruled, rounds).filter((c("distrust") >= CUTOFF) & (c("distrust") > c("trust") + SLACK)).select("host", F.lit(True).alias("bad_host"))
    return ruled.drop("html").join(blocked, "host", "left").select(
        page_id, "host", "path", "rule", F.coalesce("verdict", F.when(c("bad_host"), "block").otherwise("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(rounds: int = ROUNDS) -> str:
    def pick(of: int) -> str:
        out = "NULL"
        for kind, name, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
            value = (name + start, kind)[of]
            out = f"CASE WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') THEN '{value}' ELSE {out} END"
        return out

    target = TARGET.replace("'", "''")
    steps = "".join(f"""
s{i} AS (SELECT host, good, bad, least(1.0, {1 - DAMPING!r} * good + {DAMPING} * coalesce((SELECT sum(p.trust * share) FROM e JOIN s{i - 1} p ON p.host = src WHERE dst = h.host), 0)) AS trust,
  least(1.0, {1 - DAMPING!r} * bad + {DAMPING} * coalesce((SELECT sum(p.distrust * share) FROM e JOIN s{i - 1} p ON p.host = dst WHERE src = h.host), 0)) AS distrust FROM s0 h),""" for i in range(1, rounds + 1))
    return f"""
WITH b AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '{HOST}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PATH}', 1), '') AS path FROM pages),
r AS (SELECT *, {pick(0)} AS rule, {pick(1)} AS verdict FROM b),
x AS (SELECT host AS src, unnest(regexp_extract_all(html, '{target}', 1)) AS target FROM b),
y AS (SELECT src, translate(target, '{UPPER}', '{LOWER}') AS dst FROM x),
p AS (SELECT src, dst, count(*) AS n FROM y WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM p),
h AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM r WHERE host <> '' GROUP BY host
  UNION ALL SELECT DISTINCT dst, 0.0, 0.0 FROM e WHERE dst NOT IN (SELECT host FROM b)),
s0 AS (SELECT host, good, bad, {1 - DAMPING!r} * good AS trust, {1 - DAMPING!r} * bad AS distrust FROM h),{steps}
v AS (SELECT host FROM s{rounds} WHERE distrust >= {CUTOFF} AND distrust > trust + {SLACK})
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM v) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""


OP7_SQL = _sql()

"""URL rules, and for what no rule decides, trust and distrust carried over the graph of hosts. DataFrame functions only.

Every host with pages that the rules allow is a trusted seed, every host with pages that they block a blocked one,
each in proportion to the share of its pages. Personalised PageRank carries trust from the trusted seeds along the
links between hosts, and distrust from the blocked seeds against them: who links to a bad host is bad. Each round
moves on what the round before has moved, until what moves is too little to matter. Mass is counted in whole units, so
sums do not depend on their order and every run gives the same rows.

Rules are by path, so what a host starts with counts in its own verdict only where the rule's pages are most of the
host's; what reaches it over links always does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

#: (host, path, verdict): fits the host and its subdomains where the url's path starts with the rule's.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Units of mass in all, percent that follows links; parts of a whole that shares of pages are counted in.
UNITS, DAMPING, SHARE = 10**18, 85, 10**6
#: A host is blocked from the FEWth part of what a wholly blocked seed starts with; rounds end when the last one has moved no more than the NEARth part of that over all hosts.
FEW, NEAR = 1000, 50_000
#: Parts that a host's join rows are split into, and hosts that are broadcast instead, at most; rounds after which a table is written.
SALTS, BROADCAST_ROWS, CUT = 16, 100_000, 4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path together, and its verdict; null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links from pages of one host to another host."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1))
    found = pages.select(split_url(F.col("url"))[0].alias("src"), F.explode(links).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return found.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).distinct()


def seeds(judged: DataFrame) -> DataFrame:
    """(kind, host, most, mass, whole): what each seed starts with, whether the verdict is that of most of its pages, and what a seed starts with if it is that of all."""
    hosts = judged.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    kinds = F.array(F.struct(F.lit("trust").alias("kind"), F.col("a").alias("n")), F.struct(F.lit("distrust").alias("kind"), F.col("b").alias("n")))
    each = hosts.select("host", "pages", F.explode(kinds).alias("s")).where("s.n > 0").select("s.kind", "host", F.expr("2 * s.n > pages").alias("most"), F.expr(f"{SHARE} * s.n div pages").alias("share"))
    total = each.groupBy("kind").agg(F.sum("share").alias("total"))
    part = lambda share: F.expr(f"cast(cast({UNITS // 100 * (100 - DAMPING)} as decimal(38,0)) * {share} div total as long)")
    return each.join(F.broadcast(total), "kind").select("kind", "host", "most", part("share").alias("mass"), part(str(SHARE)).alias("whole"))  # two rows


def spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(kind, host, mass): what each host starts with and what reaches it. Trust goes along the edges, distrust against them.

    A round moves DAMPING percent of what the last one has moved at most. A kind ends with the first round that moves
    no more than the NEARth part of a whole seed; what would still come is at most six times that.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionAll(edges.select(F.lit("distrust"), F.col("dst"), F.col("src")))
    degree = both.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    both = both.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    both = written(both.join(degree.select("kind", "src", "degree", salts), ["kind", "src", "salt"]), "edges")
    least = {r.kind: r.whole // NEAR for r in start.select("kind", "whole").distinct().collect()}  # two rows
    moved = start.select("kind", "host", "mass")
    every, done = [moved], 0
    while least:
        rounds = []
        for k in range(CUT):
            sources = moved.select("kind", F.col("host").alias("src"), "mass", salts)
            moved = sources.join(both, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("host"), F.expr(f"mass div 100 * {DAMPING} div degree").alias("mass"))
            moved = moved.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0")
            rounds.append(moved.withColumn("round", F.lit(done + k)))
        part = rounds[0]
        for r in rounds[1:]:
            part = part.unionAll(r)
        part = written(part, "moved")
        total = {(r.kind, r.round): r.m for r in part.groupBy("kind", "round").agg(F.sum("mass").alias("m")).collect()}  # CUT rows a kind
        for kind in list(least):
            last = next((k for k in range(done, done + CUT) if total.get((kind, k), 0) <= least[kind]), done + CUT)
            every.append(part.where((F.col("kind") == kind) & (F.col("round") < last)).select("kind", "host", "mass"))
            if last < done + CUT:
                del least[kind]
        done += CUT
        moved = part.where((F.col("round") == done - 1) & F.col("kind").isin(list(least))).select("kind", "host", "mass")
    out = every[0]
    for more in every[1:]:
        out = out.unionAll(more)
    return out.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (null: none reached it).

    One row for each row of pages (page_id, url, html), repeated rows and null ids included. A url that is null or has
    no :// has an empty host and path, fits no rule and is allowed. Null html has no links. An empty table gives no
    rows; further columns are ignored. Where no rule fits, a host is blocked if its distrust exceeds its trust and is
    at least the FEWth part of what a wholly blocked seed starts with, however many seeds there are.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "verdict": verdict})
    start = written(seeds(judged), "seeds")
    whole = {r.kind: r.whole for r in start.select("kind", "whole").distinct().collect()}  # two rows
    own = start.where("NOT most").select("kind", "host", (-F.col("mass")).alias("mass"))
    mass = spread(host_edges(pages), start).unionAll(own).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).where("mass > 0")
    hosts = mass.groupBy(F.col("host").alias("h")).agg(F.max(F.when(F.col("kind") == "trust", F.col("mass"))).alias("trust"), F.max(F.when(F.col("kind") == "distrust", F.col("mass"))).alias("distrust"))
    hosts = written(hosts, "hosts")
    if hosts.count() <= BROADCAST_ROWS:  # a name and two numbers each
        joined = judged.join(F.broadcast(hosts), F.col("host") == F.col("h"), "left")
    else:
        hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = judged.withColumn("s", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        joined = judged.join(hosts, (F.col("host") == F.col("h")) & (F.col("s") == F.col("salt")), "left")
    bad = (F.coalesce("distrust", F.lit(0)) >= whole.get("distrust", 0) // FEW) & (F.coalesce("distrust", F.lit(0)) > F.coalesce("trust", F.lit(0)))
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def _sql() -> str:
    cases = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if out == 'rule' else v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))) + " END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    part = lambda share: f"CAST(CAST({UNITS // 100 * (100 - DAMPING)} AS HUGEINT) * {share} // sum(share) OVER (PARTITION BY kind) AS BIGINT)"
    return f"""
WITH RECURSIVE r AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, html, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT page_id, host, path, {cases("rule")} AS rule, {cases("verdict")} AS verdict FROM u),
c AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b FROM j WHERE host <> '' GROUP BY 1),
k AS (SELECT 'trust' AS kind, host, a, n FROM c WHERE a > 0 UNION ALL SELECT 'distrust', host, b, n FROM c WHERE b > 0),
s AS (SELECT kind, host, 2 * a > n AS most, {SHARE} * a // n AS share FROM k),
seed AS MATERIALIZED (SELECT kind, host, most, {part("share")} AS mass, {part(SHARE)} AS whole FROM s),
l AS (SELECT host AS src, {lower("unnest(regexp_extract_all(coalesce(html, ''), '" + link + "', 1))")} AS dst FROM u),
d AS (SELECT DISTINCT src, dst FROM l WHERE src <> '' AND src <> dst),
f AS (SELECT 'trust' AS kind, src, dst FROM d UNION ALL SELECT 'distrust', dst, src FROM d),
e AS MATERIALIZED (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM f),
m AS (SELECT kind, host, mass, whole FROM seed UNION ALL
  SELECT kind, host, mass, whole FROM (
    SELECT m.kind AS kind, e.dst AS host, CAST(sum(m.mass // 100 * {DAMPING} // e.degree) AS BIGINT) AS mass, any_value(whole) AS whole
    FROM m JOIN e ON m.kind = e.kind AND m.host = e.src GROUP BY 1, 2)
  QUALIFY sum(mass) OVER (PARTITION BY kind) > whole // {NEAR}),
t AS (SELECT kind, host, CAST(sum(mass) AS BIGINT) AS mass FROM (SELECT kind, host, mass FROM m UNION ALL SELECT kind, host, -mass FROM seed WHERE NOT most) GROUP BY 1, 2),
h AS (SELECT host, max(mass) FILTER (WHERE kind = 'trust') AS trust, max(mass) FILTER (WHERE kind = 'distrust') AS distrust FROM t WHERE mass > 0 GROUP BY 1)
SELECT page_id, j.host AS host, path, rule,
       coalesce(verdict, CASE WHEN coalesce(distrust, 0) >= coalesce((SELECT max(whole) FROM seed WHERE kind = 'distrust'), 0) // {FEW} AND coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
       trust, distrust
FROM j LEFT JOIN h ON j.host = h.host
"""


SQL = _sql()

"""URL filters: rules for hosts and paths, and for what no rule fits a verdict of the host by propagation over links between hosts.

Trust is a personalised PageRank: it starts at hosts in proportion to their pages that rules allow and follows the links. Distrust starts
at hosts in proportion to their pages that rules block and follows the links backwards: who links to a blocked host gets a share of its distrust. A host whose distrust is over
`ratio` per cent of its trust is blocked. Links within a host don't count, links from a page to a host count once; a host that
links nowhere passes nothing on. Scores are integers, of ONE for all of a kind, and every division is cut off, so that reruns agree to the unit.
Only DataFrame operations; rows of pages never meet those of other pages but in sums by host, and edges are a row per pair of hosts.

Defined cases: a null url, or one without ://, has an empty host and path, and the empty host neither gives nor takes links; a null html has no links;
a rule needs its path at the beginning of the url's (a url without a path has an empty one, which no rule's path fits); of the rules that fit, the longest text wins, of equally
long ones the first given; a host without any score is allowed; without rules there are no seeds and all is allowed; rows that share a page_id, null ids and repeated rows
each have their verdict; an empty table gives no rows. judge() keeps no other column than page_id, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.common import drop_table, read_table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All trust, and all distrust, at the start.
ONE = 10**18
#: Per cent of a score that is passed on, and how often.
PASSED, STEPS = 85, 16
#: Steps between two tables, which cut the lineage.
STEPS_A_TABLE = 4
#: The host of a link's target, in an href with a scheme or at least its two slashes.
HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
#: (host, path, verdict) of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

Rule = tuple[str, str, str]


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _chosen(rules: Sequence[Rule], host: Column, path: Column, what) -> Column:
    """what(rule) of the longest rule that fits; null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # the later stand outside, so the longest is asked first
        name, start, _ = rule
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, what(rule)).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """pages' rows with host, path, and the rule and verdict of the longest rule that fits, else null."""
    rows = pages.withColumns({"host": F.coalesce(host_of(F.col(url)), F.lit("")), "path": F.coalesce(path_of(F.col(url)), F.lit(""))})
    host, path = F.col("host"), F.col("path")
    return rows.withColumns({"rule": _chosen(rules, host, path, lambda r: F.lit(r[0] + r[1])), "verdict": _chosen(rules, host, path, lambda r: F.lit(r[2]))})


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b, pages): how many pages of host a link to host b."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(HREF), 1), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.select(F.coalesce(host_of(F.col(url)), F.lit("")).alias("a"), F.explode(found).alias("b"))
    return links.filter("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pages"))


def arcs_of(edges: DataFrame) -> DataFrame:
    """(kind, start, host, pages, of): trust goes from start to host along a link, distrust against it; of: all that leave start."""
    ways = F.array(F.struct(F.lit("trust").alias("kind"), F.col("a").alias("start"), F.col("b").alias("host")), F.struct(F.lit("distrust").alias("kind"), F.col("b").alias("start"), F.col("a").alias("host")))
    both = edges.select(F.explode(ways).alias("way"), "pages").select("way.*", "pages")
    return both.join(both.groupBy("kind", "start").agg(F.sum("pages").alias("of")), ["kind", "start"])


def propagated(seeds: DataFrame, arcs: DataFrame, steps: int = STEPS, passed: int = PASSED) -> DataFrame:
    """(kind, host, score) after so many steps from seeds (kind, host, seed). Every few steps a table is written; when none of its scores has moved, more steps would move none."""
    seeds = written(seeds, "seeds")
    arcs = written(arcs, "arcs")
    base = seeds.select("kind", "host", F.expr(f"seed * {100 - passed}BD div 100BD").alias("score"))
    share = F.expr(f"CAST(score AS DECIMAL(19)) * CAST(pages AS DECIMAL(12)) * {passed}BD div (CAST(of AS DECIMAL(16)) * 100BD)")
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    table = None
    for step in range(steps):
        given = arcs.join(scores.withColumnRenamed("host", "start"), ["kind", "start"]).select("kind", "host", share.alias("score"))
        scores = base.unionByName(given).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (step + 1) % STEPS_A_TABLE and step + 1 < steps:
            continue
        before, table = table, written(scores, "scores")
        scores = table
        if before is not None:
            moved = table.join(before.withColumnRenamed("score", "was"), ["kind", "host"], "left").filter("was is null or was <> score").limit(1).count()
            drop_table(before)
            if not moved:
                break
    return scores


def host_scores(pages: DataFrame, rules: Sequence[Rule], steps: int = STEPS) -> DataFrame:
    """(host, trust, distrust) of all hosts that a score has reached."""
    seen = with_rules(pages.select("url"), rules).filter("verdict is not null")
    count = seen.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("trust"), F.count_if(F.col("verdict") == "block").alias("distrust"))
    count = written(count, "ruled")  # a row for each host with a rule
    all_of = count.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    kinds = [count.filter(F.col(k) > 0).select(F.lit(k).alias("kind"), "host", F.expr(f"CAST({ONE} AS DECIMAL(19)) * CAST({k} AS DECIMAL(18)) div {all_of[k] or 1}BD").alias("seed")) for k in ("trust", "distrust")]
    scores = propagated(reduce(DataFrame.unionByName, kinds), arcs_of(host_edges(pages)), steps)
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0).cast("long")).alias(k)
    return scores.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, steps: int = STEPS, ratio: int = 100) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of pages (page_id, url, html)."""
    scores = host_scores(pages.select("url", "html"), rules, steps)
    rows = with_rules(pages.select("page_id", "url"), rules).drop("url").join(scores, "host", "left")
    rows = rows.withColumns({k: F.coalesce(k, F.lit(0).cast("long")) for k in ("trust", "distrust")})
    own = F.when(F.expr(f"CAST(distrust AS DECIMAL(19)) * 100BD > CAST(trust AS DECIMAL(19)) * {ratio}BD"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "trust", "distrust")


def op12_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


QUERIES = {"op12_link_graph": op12_link_graph}


def _sql() -> str:
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    after = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    steps = ["r0 AS (SELECT kind, host, seed AS score FROM seeds)"]
    for n in range(STEPS):
        steps.append(
            f"r{n + 1} AS (SELECT kind, host, sum(score) AS score FROM (SELECT kind, host, seed * {100 - PASSED} // 100 AS score FROM seeds UNION ALL "
            f"SELECT a.kind, a.host, r.score * a.pages * {PASSED} // (a.of_start * 100) FROM arcs a JOIN r{n} r ON a.kind = r.kind AND a.start = r.host) GROUP BY 1, 2)"
        )
    return f"""
WITH urls AS (SELECT page_id, html, row_number() OVER () AS row, {after} AS rest FROM pages),
split AS (SELECT page_id, row, html, {lower("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
parts AS (SELECT page_id, row, html, coalesce(host, '') AS host, coalesce(path, '') AS path FROM split),
ruled AS (SELECT *, {case(1)} AS rule, {case(2)} AS verdict FROM parts),
counts AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE verdict IS NOT NULL GROUP BY 1, 2),
seeds AS (SELECT kind, host, {ONE}::HUGEINT * n // sum(n) OVER (PARTITION BY kind) AS seed FROM counts),
links AS (SELECT DISTINCT row, host AS a, {lower("h")} AS b FROM (SELECT row, host, unnest(regexp_extract_all(html, '{HREF.replace("'", "''")}', 1)) AS h FROM ruled)),
edges AS (SELECT a, b, count(*)::HUGEINT AS pages FROM links WHERE a <> '' AND b <> '' AND a <> b GROUP BY 1, 2),
ways AS (SELECT 'trust' AS kind, a AS start, b AS host, pages FROM edges UNION ALL SELECT 'distrust', b, a, pages FROM edges),
arcs AS (SELECT *, sum(pages) OVER (PARTITION BY kind, start) AS of_start FROM ways),
{", ".join(steps)},
scores AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM r{STEPS} GROUP BY 1)
SELECT page_id, u.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict,
 CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM ruled u LEFT JOIN scores s ON u.host = s.host
"""


ORACLE = {"op12_link_graph": _sql()}

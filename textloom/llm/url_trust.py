"""URL filters (2): rules, and for urls that no rule fits trust and distrust propagated over the graph of hosts.

Edges run from the host of a page to the hosts that its links name (absolute or protocol-relative), and between a host
and its parent domain, both ways, as whoever runs one vouches for the other. Trust starts at hosts with allowed pages,
in proportion to their number, and follows the edges (personalised PageRank); distrust starts at hosts with blocked
pages and follows them backwards. Both take ROUNDS rounds of one join and one sum over hosts. What comes to hosts without
edges goes back to the seeds: as every round is linear in the seeds, that is a factor, so both are scaled to a sum of 1.
Hosts with very many edges or pages are joined by broadcast, of which there can only be few. A host is blocked if its
distrust is above LEAST and above RATIO times its trust.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is allowed, as nothing
speaks against it; null pages of html have no links; repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, HOT_SHARE, Workspace, join_counted

#: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DAMPING, ROUNDS = 0.85, 8
#: Distrust that blocks a host: this much of all distrust, and this many times its trust.
LEAST, RATIO = 1e-9, 1.0
#: Rounds between two cuts of the lineage.
CUT = 4
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does. The rules become one expression."""

    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered], F.lit(None))


def host_edges(pages: DataFrame) -> DataFrame:
    """source, target and n: links between hosts, and one each way between a host and its parent domain."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    named = links.select(F.col("host").alias("source"), host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))).alias("target"))
    linked = named.where("target <> '' AND source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    hosts = pages.select("host").unionByName(named.select(F.col("target").alias("host"))).distinct()
    # Every domain of two labels or more above a host.
    labels = F.split("host", r"\.")
    chain = hosts.select("host", labels.alias("labels")).where(F.size("labels") > 2)
    steps = chain.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("labels") - 2), lambda k: F.struct(F.array_join(F.slice("labels", k, F.size("labels")), ".").alias("a"), F.array_join(F.slice("labels", k + 1, F.size("labels")), ".").alias("b")))).alias("x"))
    pairs = steps.select("x.a", "x.b").distinct()
    both = pairs.select(F.col("a").alias("source"), F.col("b").alias("target")).unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target")))
    return linked.unionByName(both.withColumn("n", F.lit(1).cast("long"))).groupBy("source", "target").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, work: Workspace, rounds: int = ROUNDS) -> DataFrame:
    """host, trust and distrust. seeds: host, trust, distrust, each summing to 1 or 0."""
    out_of = edges.groupBy("source").agg(F.sum("n").alias("total"))
    into = edges.groupBy("target").agg(F.sum("n").alias("total"))
    forward = edges.join(out_of, "source").select(F.col("source").alias("a"), F.col("target").alias("b"), (F.col("n") / F.col("total")).alias("f"), F.lit(0.0).alias("r"))
    backward = edges.join(into, "target").select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit(0.0).alias("f"), (F.col("n") / F.col("total")).alias("r"))
    flows = work.save(forward.unionByName(backward).groupBy("a", "b").agg(F.sum("f").alias("f"), F.sum("r").alias("r")), "flows")
    # At most HOT_SHARE hosts can have so many edges.
    most = max(HOT_ROWS, flows.count() // HOT_SHARE)
    hot = [r["a"] for r in flows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("a").collect()]
    start = work.save(seeds, "seeds")
    # A seed's share enters in every round; hosts without any take part through what reaches them.
    base = start.select("host", ((1 - DAMPING) * F.col("trust")).alias("trust"), ((1 - DAMPING) * F.col("distrust")).alias("distrust"))
    state = start
    for k in range(1, rounds + 1):
        met = flows.where(~F.col("a").isin(hot)).join(state, F.col("a") == F.col("host")) if hot else flows.join(state, F.col("a") == F.col("host"))
        if hot:
            met = met.unionByName(flows.where(F.col("a").isin(hot)).join(F.broadcast(state.where(F.col("host").isin(hot))), F.col("a") == F.col("host")))
        sent = met.select(F.col("b").alias("host"), (DAMPING * F.col("trust") * F.col("f")).alias("trust"), (DAMPING * F.col("distrust") * F.col("r")).alias("distrust"))
        state = sent.unionByName(base).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if k % CUT == 0 or k == rounds:
            state = work.save(state, f"round{k}")
    trust, distrust = state.agg(F.sum("trust"), F.sum("distrust")).first()
    return state.select("host", (F.col("trust") / F.lit(trust or 1.0)).alias("trust"), (F.col("distrust") / F.lit(distrust or 1.0)).alias("distrust"))


def url_trust(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (the host's) of each page."""
    work = Workspace(pages.sparkSession, "urls")
    url = F.col("url")
    ruled = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html")).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    edges = work.save(host_edges(ruled), "edges")
    judged = work.save(ruled.drop("html"), "judged")
    is_a = lambda v: F.sum(F.when(F.col("found.verdict") == v, 1).otherwise(0))
    counts = judged.where("host <> ''").groupBy("host").agg(is_a("allow").alias("good"), is_a("block").alias("bad"))
    good, bad = counts.agg(F.sum("good"), F.sum("bad")).first()
    seeds = counts.select("host", (F.col("good") / F.lit(float(good or 1))).alias("trust"), (F.col("bad") / F.lit(float(bad or 1))).alias("distrust"))
    hosts = propagate(seeds, edges, work).select("host", F.round("trust", 12).alias("trust"), F.round("distrust", 12).alias("distrust"))
    hosts = work.save(hosts, "hosts")
    distrusted = (F.col("distrust") > LEAST) & (F.col("distrust") > RATIO * F.col("trust"))
    method = F.when(F.coalesce(distrusted, F.lit(False)), "block").otherwise("allow")
    pages_of = judged.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    counted = hosts.join(pages_of, "host")
    named = join_counted(judged.where("host <> ''"), counted, "host", judged.count(), "left")
    joined = named.unionByName(judged.where("host = ''"), allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"), zero("trust"), zero("distrust"))


def oracle_sql(rules: list[tuple[str, str, str]] = RULES) -> str:
    """The same in DuckDB's SQL, a pair of sums for each round."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in ordered) + " END"
    low = f"'{_UPPER}', '{_LOWER}'"
    link = LINK.replace("'", "''")
    start = rf"""
WITH split AS MATERIALIZED (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), {low}) AS host,
    coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
judged AS MATERIALIZED (SELECT page_id, host, path, html, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM split),
link AS (SELECT host AS source, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM split WHERE host <> ''),
named AS (SELECT source, translate(regexp_extract(link, '//([^/?#]*)', 1), {low}) AS target FROM link),
linked AS (SELECT source, target, count(*) AS n FROM named WHERE target <> '' AND source <> target GROUP BY ALL),
host AS (SELECT host FROM split UNION SELECT target FROM named),
labels AS (SELECT string_split(host, '.') AS l FROM host WHERE len(string_split(host, '.')) > 2),
step AS (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels),
pair AS (SELECT DISTINCT array_to_string(l[k:], '.') AS a, array_to_string(l[k + 1:], '.') AS b FROM step),
edge AS MATERIALIZED (
  SELECT source, target, sum(n) AS n FROM (SELECT * FROM linked UNION ALL SELECT a, b, 1 FROM pair UNION ALL SELECT b, a, 1 FROM pair) GROUP BY ALL),
seed AS MATERIALIZED (
  SELECT host, sum((coalesce(ruled, '') = 'allow')::INT)::DOUBLE / greatest(1, (SELECT count(*) FROM judged WHERE host <> '' AND ruled = 'allow')) AS trust,
    sum((coalesce(ruled, '') = 'block')::INT)::DOUBLE / greatest(1, (SELECT count(*) FROM judged WHERE host <> '' AND ruled = 'block')) AS distrust
  FROM judged WHERE host <> '' GROUP BY host),
forward AS MATERIALIZED (SELECT source AS a, target AS b, n / sum(n) OVER (PARTITION BY source) AS share FROM edge),
backward AS MATERIALIZED (SELECT target AS a, source AS b, n / sum(n) OVER (PARTITION BY target) AS share FROM edge),
state0 AS (SELECT host, trust, distrust FROM seed)"""
    rounds = [
        f""",
state{k} AS MATERIALIZED (
  SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
    SELECT host, {1 - DAMPING} * trust AS trust, {1 - DAMPING} * distrust AS distrust FROM seed
    UNION ALL SELECT b, {DAMPING} * trust * share, 0 FROM forward JOIN state{k - 1} ON a = host
    UNION ALL SELECT b, 0, {DAMPING} * distrust * share FROM backward JOIN state{k - 1} ON a = host) GROUP BY host)"""
        for k in range(1, ROUNDS + 1)
    ]
    end = f""",
scaled AS (SELECT host, trust / CASE WHEN sum(trust) OVER () = 0 THEN 1 ELSE sum(trust) OVER () END AS trust, distrust / CASE WHEN sum(distrust) OVER () = 0 THEN 1 ELSE sum(distrust) OVER () END AS distrust FROM state{ROUNDS})
SELECT page_id, j.host, path, rule,
  coalesce(ruled, CASE WHEN round(distrust, 12) > {LEAST} AND round(distrust, 12) > {RATIO} * round(trust, 12) THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM judged j LEFT JOIN scaled s ON j.host = s.host"""
    return reduce(str.__add__, rounds, start) + end

"""What a question's answer is put together from: call chains, routes wired to handlers, and memories as primary context."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import score
from glyphmill.operators import graph
from glyphmill.operators.storage import materialised
from glyphmill.plans import bindings as b
from glyphmill.plans.analytics import _COS, probes, with_distance
from glyphmill.plans.registry import query


@query("graph_call_chain_build", """WITH e AS (SELECT source, target FROM v_nation_dep), t AS (SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey IN (SELECT target FROM e) ORDER BY n_name LIMIT 3),
p AS (SELECT DISTINCT source AS id FROM e WHERE target IN (SELECT id FROM t) AND source NOT IN (SELECT id FROM t) ORDER BY id LIMIT 32)
SELECT DISTINCT * FROM (SELECT 'up' AS side, source, target FROM e WHERE target IN (SELECT id FROM t) OR target IN (SELECT id FROM p) UNION ALL SELECT 'down', source, target FROM e WHERE source IN (SELECT id FROM t))""")
def call_chain_build(s, d):
    """The chain of the first three symbols by name that anything calls, which stand for a question's hints."""
    deps = materialised(b.nation_dep(s, d), "deps")
    named = b.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name")
    hints = named.join(deps.select(F.col("target").alias("id")), "id", "left_semi").orderBy("n_name").limit(3)
    return graph.call_chain(deps, hints.select("id"))


_WIRED = "WITH w AS (SELECT DISTINCT r.href AS route, 'page:' || p.page_id AS handler FROM v_routes r JOIN pages p ON regexp_extract(p.url, '/([^/]*)$', 1) = r.page_id::VARCHAR)"


def wired(s, d):
    """(route, handler, url): each link that a page has, and the page that its id names."""
    r = b.routes(s, d).select(F.col("page_id").cast("string").alias("tail"), F.col("href").alias("route"))
    p = b.table(s, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("handler"), "url", F.regexp_extract("url", "/([^/]*)$", 1).alias("tail"))
    return r.join(p, "tail").select("route", "handler", "url")


@query("join_cross_wire", f"""{_WIRED}, x AS (SELECT 'callers' AS direction, handler AS name, route AS source, handler AS target FROM w UNION ALL SELECT 'callees', route, route, handler FROM w UNION SELECT 'callees', handler, handler, handler FROM w)
SELECT direction, name, source, target FROM (SELECT *, row_number() OVER (PARTITION BY direction, name ORDER BY source, target) AS rn FROM x) WHERE rn <= 15""")
def cross_wire(s, d):
    """For each name the wires that touch it on either side, at most 15 of a direction."""
    w = materialised(wired(s, d).select("route", "handler").distinct(), "wired")
    side = lambda direction, name, source: w.select(F.lit(direction).alias("direction"), F.col(name).alias("name"), F.col(source).alias("source"), F.col("handler").alias("target"))
    x = side("callers", "handler", "route").unionByName(side("callees", "route", "route")).unionByName(side("callees", "handler", "handler").distinct())
    return graph.top_per(x, ["direction", "name"], [F.col("source"), F.col("target")], 15).select("direction", "name", "source", "target")


@query("agg_manifest_top_file", """WITH m AS (SELECT split_part(r.href, '/', 2) AS host, regexp_extract(p.url, '^(.*)/[^/]*$', 1) AS file FROM v_routes r JOIN pages p ON regexp_extract(p.url, '/([^/]*)$', 1) = r.page_id::VARCHAR),
g AS (SELECT host, file, count(*)::BIGINT AS n FROM m GROUP BY ALL) SELECT host, arg_min(file, (-n, file)) AS file, max(n) AS n, sum(n)::BIGINT AS entries FROM g GROUP BY host HAVING sum(n) >= 3""")
def manifest_top_file(s, d):
    """The file that handles most routes of a manifest; of equal ones the first. Manifests of under three entries are none."""
    g = wired(s, d).groupBy(F.split_part("route", F.lit("/"), F.lit(2)).alias("host"), F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("file")).agg(F.count(F.lit(1)).alias("n"))
    best = g.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("less"), "file")).alias("m"), F.sum("n").alias("entries")).where("entries >= 3")
    return best.select("host", F.col("m.file").alias("file"), (-F.col("m.less")).alias("n"), "entries")


@query("vector_primary_context", f"""WITH near AS (SELECT m.*, round(greatest(0, least(1, {_COS})) * CASE WHEN scope = 'branch' THEN 0.6::DOUBLE ELSE 1 END, 6) AS confidence FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 5) a WHERE mem_type <> 'decision'),
top AS (SELECT *, row_number() OVER (PARTITION BY repo, mem_type ORDER BY confidence DESC, key) AS rn FROM near)
SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, key)::INTEGER AS rank, key, mem_type, CASE WHEN mem_type <> 'flow' THEN file END AS file, confidence, scope = 'branch' AS stale FROM top WHERE rn <= 5""")
def primary_context(s, d):
    """Each repository's five best memories of a type about files, functions and flows, by confidence; flows point at no file."""
    stale = F.col("scope") == "branch"
    near = with_distance(b.memories(s, d).where("mem_type <> 'decision'"), probes(s, d, (5,)))
    near = near.select("repo", "key", "mem_type", F.when(F.col("mem_type") != "flow", F.col("file")).alias("file"), F.round(score.confidence(1 - F.col("distance"), stale), 6).alias("confidence"), stale.alias("stale"))
    top = graph.top_per(near, ["repo", "mem_type"], [F.desc("confidence"), F.col("key")], 5).drop("rank")
    return graph.top_per(top, ["repo"], [F.desc("confidence"), F.col("key")], 15).select("repo", "rank", "key", "mem_type", "file", "confidence", "stale")

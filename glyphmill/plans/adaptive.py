"""Plan filters on graph targets and memories, budgets, expiry and merged links as registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import graph
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

#: A bucket with fewer samples has the profile of its intent; topics of a bucket; days before a false positive expires;
#: callbacks of a channel; breadth used where none is set, and the largest.
SAMPLE_FLOOR, MAX_TOPICS, FP_DAYS, MAX_CALLBACKS, BREADTH, MAX_BREADTH = 20, 32, 14, 40, 5, 15


# ---- plan filters --------------------------------------------------------------------------------------------------


#: What a term of a plan excludes: (term, column, kind of match, lower-case value).
CONVENTIONS = (
    ("test", "path", "contains", "_test.go"), ("test", "path", "contains", "/test/"), ("test", "path", "contains", "/tests/"), ("test", "path", "startswith", "test/"),
    ("test", "path", "startswith", "tests/"), ("test", "name", "startswith", "test"), ("mock", "path", "contains", "/mock"), ("mock", "name", "startswith", "mock"),
    ("fixture", "path", "contains", "/fixture"), ("fixture", "target path", "contains", "/testdata"),
)


def by_convention(columns: dict[str, Column], terms: Sequence[str]) -> Column:
    """Whether a row goes for one of the terms. columns: the row's name, path, and target path where it is a target of the graph."""
    asked = {t.strip().lower() for t in terms}
    low = {c: F.lower(F.coalesce(x, F.lit(""))) for c, x in columns.items()}
    hits = [getattr(F, match)(low[c], F.lit(value)) for term, c, match, value in CONVENTIONS if term in asked and c in low]
    return F.array_contains(F.array(F.lit(False), *hits), True)


def any_term(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.lower(text).contains(t.lower())
    return out


@query("filter_memory_plan", "SELECT key FROM v_memories WHERE (contains(lower(key || ' ' || file), '7') OR contains(lower(key || ' ' || file), 'src/1')) AND NOT (contains(file, '/fixture') OR contains(file, '_test.go'))")
def memory_plan(s, d):
    """Must terms are looked for in the structural text; a must that was found by itself would be advice only."""
    m = b.memories(s, d).select("key", "file")
    return m.where(any_term(F.concat_ws(" ", "key", "file"), ("7", "src/1")) & ~by_convention({"path": F.col("file")}, ("test", "fixture"))).select("key")


@query("filter_memory_scope", "SELECT key, scope FROM v_memories WHERE scope IN ('branch') AND repo = 'r1'")
def memory_scope(s, d):
    return b.memories(s, d).where(F.col("scope").isin("branch") & (F.col("repo") == "r1")).select("key", "scope")


@query("filter_call_chain", """
SELECT e.source, e.target FROM (SELECT DISTINCT source, target FROM v_edges WHERE kind = 'calls') e JOIN v_nodes n ON n.id = e.target
WHERE (n.file_path IN ('parts/brand11/t1.py', 'parts/brand12/t3.py') OR contains(lower(n.name || ' ' || n.file_path), 'brand3')) AND NOT starts_with(lower(n.name), 'test')""")  # fmt: skip
def call_chain(s, d):
    """Calls whose target has a must term, or lies in a file that the search found; targets by test conventions go."""
    n = b.nodes(s, d).select(F.col("id").alias("target"), "name", "file_path").where(~by_convention({"name": F.col("name"), "path": F.col("file_path"), "target path": F.col("file_path")}, ("test",)))
    n = n.where(F.col("file_path").isin("parts/brand11/t1.py", "parts/brand12/t3.py") | any_term(F.concat_ws(" ", "name", "file_path"), ("brand3",)))
    return b.edges(s, d, ("calls",)).select("source", "target").join(n.select("target"), "target", "left_semi").distinct()


_SIBLINGS = "SELECT z.id FROM v_edges e JOIN v_nodes a ON a.id = e.source JOIN v_nodes z ON z.id = e.target WHERE e.kind = 'contains' AND a.kind = 'namespace' AND NOT (contains(lower(z.file_path), '_test.go') OR contains(lower(z.file_path), '/test/') OR contains(lower(z.file_path), '/tests/') OR starts_with(lower(z.file_path), 'test/') OR starts_with(lower(z.file_path), 'tests/') OR starts_with(lower(z.name), 'test') OR contains(lower(z.file_path), '/mock') OR starts_with(lower(z.name), 'mock'))"


@query("filter_siblings", _SIBLINGS)
def siblings(s, d):
    """Members of a namespace by exclude terms only; a must term doesn't narrow them."""
    n = b.nodes(s, d)
    own = b.edges(s, d, ("contains",)).join(n.where("kind = 'namespace'").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    gone = by_convention({"name": F.col("name"), "path": F.col("file_path"), "target path": F.col("file_path")}, ("test", "mock"))
    return n.select("id", "name", "file_path").where(~gone).join(own, "id").select("id")


# ---- dashboards and samples ----------------------------------------------------------------------------------------


@query("agg_dashboard_summary", """
SELECT count(*)::BIGINT AS queries, count(*) FILTER (additional_files > 0)::BIGINT AS with_feedback, count(DISTINCT repo)::BIGINT AS repos, (SELECT count(*) FROM v_nodes)::BIGINT AS symbols
FROM v_traces WHERE ts > (SELECT max(ts) FROM v_traces) - INTERVAL 24 HOUR""")  # fmt: skip
def dashboard_summary(s, d):
    """Of the last 24 hours."""
    t = b.traces(s, d).select("ts", "repo", "additional_files")
    newest = t.crossJoin(F.broadcast(t.agg(F.max("ts").alias("newest")))).where("ts > newest - interval 24 hours")  # one row
    counts = newest.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("additional_files") > 0).alias("with_feedback"), F.count_distinct("repo").alias("repos"))
    return counts.crossJoin(b.nodes(s, d).agg(F.count(F.lit(1)).alias("symbols")))  # one row each


@query("agg_file_feedback", """
SELECT * FROM (SELECT key, file, count(*) FILTER (revisits = 0)::BIGINT AS useful, count(*) FILTER (revisits = 2)::BIGINT AS dead, count(*) FILTER (additional_files >= 6)::BIGINT AS missing
FROM v_traces JOIN v_memories ON vec_id = k WHERE mem_type = 'flow' GROUP BY ALL) WHERE useful + dead + missing > 0""")  # fmt: skip
def file_feedback(s, d):
    """Counters are added up for each memory before they meet its file."""
    t = b.traces(s, d).groupBy(F.col("k").alias("vec_id")).agg(F.count_if(F.col("revisits") == 0).alias("useful"), F.count_if(F.col("revisits") == 2).alias("dead"), F.count_if(F.col("additional_files") >= 6).alias("missing"))
    m = b.memories(s, d).where("mem_type = 'flow'").select("vec_id", "key", "file")
    return m.join(t, "vec_id").where("useful + dead + missing > 0").select("key", "file", "useful", "dead", "missing")


_GOLD = "SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS gold FROM (SELECT doc_id, 0 AS quality FROM documents UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) GROUP BY doc_id"


@query("sample_with_gold", f"""
WITH g AS ({_GOLD}), n AS (SELECT greatest(0, 0.5::DOUBLE * count(*) - sum(gold)) / greatest(1, count(*) - sum(gold)) AS share FROM g)
SELECT doc_id, gold::INTEGER AS gold FROM g, n WHERE gold = 1 OR ('0x' || substr(md5('7:' || doc_id), 1, 8))::BIGINT < floor(share * 4294967296::DOUBLE)::BIGINT""")  # fmt: skip
def sample_with_gold(s, d):
    """Every gold document, and of the others a seeded share that brings the sample to about half of all."""
    gold = b.table(s, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("gold", F.lit(1))
    g = b.table(s, d, "documents").select("doc_id").distinct().join(gold, "doc_id", "left").withColumn("gold", F.coalesce("gold", F.lit(0)))
    n, n_gold = g.agg(F.count(F.lit(1)), F.sum("gold")).first()
    share = max(0.0, 0.5 * n - (n_gold or 0)) / max(1, n - (n_gold or 0))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return g.where((F.col("gold") == 1) | (u < int(share * 2**32)))


# ---- profiles, expiry, budgets -------------------------------------------------------------------------------------


@query("reward_pick_profile", f"""
WITH r AS (SELECT intent, user_id, round(raw * 1000000)::BIGINT AS m FROM v_rewards), g AS (SELECT intent, floor(sum(m)::DOUBLE / count(*))::BIGINT AS base FROM r GROUP BY intent),
t AS (SELECT intent, user_id, count(*)::BIGINT AS samples, floor(sum(m)::DOUBLE / count(*))::BIGINT AS own FROM r GROUP BY intent, user_id)
SELECT intent, user_id, samples, samples >= {SAMPLE_FLOOR} AS from_bucket, CASE WHEN samples >= {SAMPLE_FLOOR} THEN own ELSE base END AS base_millionths FROM t JOIN g USING (intent)""")  # fmt: skip
def pick_profile(s, d):
    """A bucket with enough samples stands for itself, another has its intent's baseline. In whole millionths, so that order doesn't show."""
    r = b.rewards(s, d).groupBy("intent", "user_id").agg(F.count(F.lit(1)).alias("samples"), F.sum(F.round(F.col("raw") * 1_000_000).cast("long")).alias("m"))
    g = r.groupBy("intent").agg(F.floor(F.sum("m").cast("double") / F.sum("samples")).alias("base"))
    hot = F.col("samples") >= SAMPLE_FLOOR
    base = F.when(hot, F.floor(F.col("m").cast("double") / F.col("samples"))).otherwise(F.col("base"))
    return r.join(g, "intent").select("intent", "user_id", "samples", hot.alias("from_bucket"), base.alias("base_millionths"))


@query("reward_topic_eviction", f"SELECT intent, user_id, row_number() OVER (PARTITION BY intent ORDER BY last DESC, user_id) > {MAX_TOPICS} AS evicted FROM (SELECT intent, user_id, max(ts) AS last FROM v_traces GROUP BY ALL)")
def topic_eviction(s, d):
    """Of each intent's topics, the most recently seen stay."""
    t = b.traces(s, d).groupBy("intent", "user_id").agg(F.max("ts").alias("last"))
    kept = graph.top_per(t, ["intent"], [F.desc("last"), F.asc("user_id")], MAX_TOPICS).select("intent", "user_id", F.lit(False).alias("evicted"))
    return t.join(kept, ["intent", "user_id"], "left").select("intent", "user_id", F.coalesce("evicted", F.lit(True)).alias("evicted"))


@query("reward_fp_expiry", f"SELECT k, n FROM (SELECT k, count(*)::BIGINT AS n, max(ts) AS last FROM v_traces WHERE event_type = 'error' GROUP BY k) WHERE last >= (SELECT max(ts) FROM v_traces) - INTERVAL {FP_DAYS} DAY")
def fp_expiry(s, d):
    """False positives of a memory are forgotten after days without a new one."""
    t = b.traces(s, d).select("k", "ts", "event_type")
    seen = t.where("event_type = 'error'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return seen.crossJoin(F.broadcast(t.agg(F.max("ts").alias("newest")))).where(f"last >= newest - interval {FP_DAYS} days").select("k", "n")  # one row


@query("fn_widen_breadth", f"SELECT p_partkey, least({MAX_BREADTH}, greatest(base + base // 2, base + 1))::INTEGER AS breadth FROM (SELECT p_partkey, CASE WHEN p_size % 20 > 0 THEN p_size % 20 ELSE {BREADTH} END AS base FROM part)")
def widen_breadth(s, d):
    base = F.when(F.col("p_size") % 20 > 0, F.col("p_size") % 20).otherwise(F.lit(BREADTH))
    return b.table(s, d, "part").select("p_partkey", F.least(F.lit(MAX_BREADTH), F.greatest(base + F.floor(base / 2), base + 1)).cast("int").alias("breadth"))


@query("fn_graph_proximity", "SELECT event_id, CASE WHEN revisits <= 0 THEN -1 ELSE least(1, additional_files::DOUBLE / (4 * revisits)) END::DOUBLE AS proximity FROM v_traces")
def graph_proximity(s, d):
    """Traced symbols over seeds, at most 1; -1 without seeds."""
    seeds = 4 * F.col("revisits")
    near = F.when(seeds <= 0, F.lit(-1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("additional_files").cast("double"), seeds)))
    return b.traces(s, d).select("event_id", near.alias("proximity"))


@query("fn_explore_budget", "SELECT root, n AS files, CASE WHEN n < 500 THEN 1 WHEN n < 5000 THEN 2 WHEN n < 15000 THEN 3 WHEN n < 25000 THEN 4 ELSE 5 END AS calls FROM (SELECT split_part(file_path, '/', 1) AS root, count(DISTINCT file_path)::BIGINT AS n FROM v_nodes GROUP BY 1)")
def explore_budget(s, d):
    """How often a project of that many files may be explored."""
    n = b.nodes(s, d).groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("root")).agg(F.count_distinct("file_path").alias("files"))
    calls = F.when(F.col("files") < 500, 1).when(F.col("files") < 5000, 2).when(F.col("files") < 15000, 3).when(F.col("files") < 25000, 4).otherwise(5)
    return n.withColumn("calls", calls)


# ---- memories and links --------------------------------------------------------------------------------------------


@query("vector_staleness", """
SELECT doc_id, coalesce(stored <> sha256(text), false) AS stale, CASE WHEN coalesce(stored <> sha256(text), false) THEN 0.6::DOUBLE ELSE 1::DOUBLE END AS confidence
FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN sha256(text || '.') ELSE sha256(text) END AS stored FROM documents)""")  # fmt: skip
def staleness(s, d):
    """A memory is stale if its stored hash differs from the current one; an unknown hash counts as fresh."""
    now = F.sha2(F.col("text").cast("binary"), 256)
    stored = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit(".")).cast("binary"), 256)).otherwise(now)
    stale = F.coalesce(stored != now, F.lit(False))
    return b.table(s, d, "documents").select("doc_id", stale.alias("stale"), F.when(stale, F.lit(0.6)).otherwise(F.lit(1.0)).alias("confidence"))


@query("vector_false_positives", """
SELECT m.key, count(*)::BIGINT AS n FROM (SELECT unnest(range(k, k + 3)) AS vec_id, 'src/' || (user_id % 50) AS read FROM v_traces WHERE additional_files > 0) t JOIN v_memories m ON m.vec_id = t.vec_id
WHERE NOT (contains(m.file, t.read) OR contains(t.read, m.file)) GROUP BY m.key""")  # fmt: skip
def false_positives(s, d):
    """Memories of a query whose file meets none of those read, where more than the offered files were read. Counts are added up before the join."""
    t = b.traces(s, d).where("additional_files > 0").select(F.explode(F.sequence("k", F.col("k") + 2)).alias("vec_id"), F.concat(F.lit("src/"), (F.col("user_id") % 50).cast("string")).alias("read"))
    t = t.groupBy("vec_id", "read").agg(F.count(F.lit(1)).alias("n"))
    m = b.memories(s, d).select("vec_id", "key", "file")
    return t.join(m, "vec_id").where(~(F.contains("file", "read") | F.contains("read", "file"))).groupBy("key").agg(F.sum("n").alias("n"))


@query("resolve_field_channels", f"""
WITH m AS (SELECT id, file_path, is_exported AS field, signature, row_number() OVER (PARTITION BY file_path, is_exported ORDER BY id) AS rn FROM v_nodes WHERE kind = 'method' AND signature = '1-URGENT')
SELECT t.id AS source, m.id AS target FROM v_nodes t JOIN m ON t.file_path = m.file_path AND t.is_exported = m.field WHERE t.kind = 'method' AND t.signature = '5-LOW' AND m.rn <= {MAX_CALLBACKS}""")  # fmt: skip
def field_channels(s, d):
    """Dispatchers to the callbacks registered on the same field of the same file; a channel has a bounded number of them, so that
    the links grow with the dispatchers only."""
    m = b.nodes(s, d).where("kind = 'method'").select("id", "file_path", "is_exported", "signature")
    registered = graph.top_per(m.where("signature = '1-URGENT'"), ["file_path", "is_exported"], [F.asc("id")], MAX_CALLBACKS)
    return m.where("signature = '5-LOW'").withColumnRenamed("id", "source").join(registered.select(F.col("id").alias("target"), "file_path", "is_exported"), ["file_path", "is_exported"]).select("source", "target")


@query("resolve_merge_links", """
SELECT source, target, ['calls', 'references', 'contains'][min(ord)::INTEGER] AS kind, count(*)::BIGINT AS links FROM (
  SELECT source, target, CASE kind WHEN 'calls' THEN 1 WHEN 'references' THEN 2 ELSE 3 END AS ord FROM v_edges UNION ALL SELECT 'class:' || o_custkey, 'method:' || o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F'
) GROUP BY source, target""")  # fmt: skip
def merge_links(s, d):
    """Links of several finders in the order of the finders: the first wins for each source and target."""
    order = F.when(F.col("kind") == "calls", 1).when(F.col("kind") == "references", 2).otherwise(3)
    found = b.edges(s, d).select("source", "target", order.alias("ord"))
    owners = b.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("class:"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("method:"), F.col("o_orderkey").cast("string")).alias("target"), F.lit(1).alias("ord"))
    kinds = F.array(F.lit("calls"), F.lit("references"), F.lit("contains"))
    merged: DataFrame = found.unionByName(owners).groupBy("source", "target").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("links"))
    return merged.select("source", "target", F.element_at(kinds, F.col("ord")).alias("kind"), "links")

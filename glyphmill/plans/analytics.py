"""Rewards, dashboards, evaluation, memories and graph loops as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import score, text, vector
from glyphmill.operators import graph, ordered, resolution
from glyphmill.operators.storage import materialised
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

N, E = "v_nodes", "v_edges"
R = "v_rewards"

# ---- rewards and dashboards ----------------------------------------------------------------------------------------


@query("reward_raw", f"SELECT event_id, round(raw, 6) AS raw FROM {R}")
def reward_raw(s, d):
    return b.rewards(s, d).select("event_id", F.round("raw", 6).alias("raw"))


@query("reward_rolling_mean", f"SELECT event_id, floor(sum(round(raw * 1000000)::BIGINT) OVER w::DOUBLE / count(*) OVER w)::BIGINT AS baseline_millionths FROM {R} WINDOW w AS (PARTITION BY intent, repo ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def rolling_mean(s, d):
    """In whole millionths, so that a sum doesn't depend on its order."""
    r = b.rewards(s, d).select("intent", "repo", "ts", "event_id", F.round(F.col("raw") * 1_000_000).cast("long").alias("m"))
    mean = lambda w: F.floor(F.try_divide(F.sum("m").over(w).cast("double"), F.count("m").over(w)))
    return ordered.over_previous(r, ["intent", "repo"], ["ts", "event_id"], 50, baseline_millionths=mean).select("event_id", "baseline_millionths")


@query("reward_newest_mean", f"SELECT intent, round(avg(raw), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY ts DESC, event_id DESC) AS rn FROM {R}) WHERE rn <= 50 GROUP BY intent")
def newest_mean(s, d):
    r = b.rewards(s, d).select("intent", "raw", "ts", "event_id")
    return graph.top_per(r, ["intent"], [F.desc("ts"), F.desc("event_id")], 50).groupBy("intent").agg(F.round(F.avg("raw"), 6).alias("mean"))


def index_percentile(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place floor((n-1) * share) of each key's sorted values. Counts of distinct values make it, so that no key's
    rows are gathered."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys)
    run = counts.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    return run.where(F.col("upto") > F.floor((F.col("n") - 1) * share)).groupBy(*keys).agg(F.min(value).alias(name))


@query("reward_stats", f"SELECT intent, count(*)::BIGINT AS n, round(avg(raw), 6) AS mean, round(list_sort(list(raw))[floor((count(*) - 1) * 0.5::DOUBLE)::BIGINT + 1], 6) AS p50, round(list_sort(list(raw))[floor((count(*) - 1) * 0.95::DOUBLE)::BIGINT + 1], 6) AS p95 FROM {R} GROUP BY intent")
def reward_stats(s, d):
    r = b.rewards(s, d).select("intent", "raw")
    base = r.groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("raw"), 6).alias("mean"))
    p = [index_percentile(r, ["intent"], "raw", x, c) for x, c in ((0.5, "p50"), (0.95, "p95"))]
    return base.join(p[0], "intent").join(p[1], "intent").select("intent", "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("reward_bucket_stats", f"SELECT intent, repo, count(*)::BIGINT AS n, round(avg(raw), 6) AS mean, round(count(*) FILTER (raw < 0.3)::DOUBLE / count(*), 6) AS low_share FROM {R} GROUP BY ALL")
def bucket_stats(s, d):
    return b.rewards(s, d).groupBy("intent", "repo").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("raw"), 6).alias("mean"), F.round(F.count_if(F.col("raw") < 0.3) / F.count(F.lit(1)), 6).alias("low_share"))


@query("reward_history_hourly", f"WITH last AS (SELECT date_trunc('hour', max(ts)) AS h FROM {R}), hours AS (SELECT h - to_hours(i::INTEGER) AS hour FROM last, range(24) t(i)) SELECT hours.hour AS hour, count(r.raw)::BIGINT AS n, round(coalesce(avg(r.raw), 0), 6) AS mean FROM hours LEFT JOIN {R} r ON date_trunc('hour', r.ts) = hours.hour GROUP BY hours.hour")
def history_hourly(s, d):
    r = b.rewards(s, d).select(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "raw")
    per = r.groupBy("hour").agg(F.count("raw").alias("n"), F.avg("raw").alias("mean"))
    hours = per.agg(F.max("hour").alias("h")).select(F.explode(F.sequence(F.col("h") - F.expr("interval 23 hours"), F.col("h"), F.expr("interval 1 hour"))).alias("hour"))
    return hours.join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


@query("reward_three_strikes", f"WITH f AS (SELECT *, raw < 0.30 AS low, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, raw < 0.30 ORDER BY ts, event_id) AS island FROM {R}) SELECT user_id, min(event_id) AS first_event, count(*)::BIGINT AS strikes FROM f WHERE low GROUP BY user_id, island HAVING count(*) >= 3")
def three_strikes(s, d):
    r = b.rewards(s, d).select("user_id", "event_id", "ts", (F.col("raw") < 0.30).alias("low"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = r.withColumn("island", F.sum((~F.col("low")).cast("int")).over(w)).where("low")
    return run.groupBy("user_id", "island").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("strikes")).where("strikes >= 3").drop("island")


@query("reward_trace_index", f"SELECT event_id, repo FROM {R} ORDER BY ts DESC, event_id DESC LIMIT 500")
def trace_index(s, d):
    return b.traces(s, d).select("event_id", "repo", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "repo")


@query("reward_flow_signal", "SELECT key, useful::BIGINT AS useful, dead::BIGINT AS dead, round(dead::DOUBLE / (useful + dead), 6) AS dead_ratio FROM (SELECT m.key, count(*) FILTER (t.revisits = 0) AS useful, count(*) FILTER (t.revisits = 2) AS dead FROM v_traces t JOIN v_memories m ON m.vec_id = t.k WHERE m.mem_type = 'flow' GROUP BY m.key) WHERE useful + dead >= 3 AND dead > 0 ORDER BY dead::DOUBLE / (useful + dead) DESC, key LIMIT 8")
def flow_signal(s, d):
    t = b.traces(s, d).groupBy(F.col("k").alias("vec_id")).agg(F.count_if(F.col("revisits") == 0).alias("useful"), F.count_if(F.col("revisits") == 2).alias("dead"))
    j = t.join(b.memories(s, d).where("mem_type = 'flow'").select("vec_id", "key"), "vec_id").where("useful + dead >= 3 AND dead > 0")
    ratio = F.col("dead") / (F.col("useful") + F.col("dead"))
    return j.withColumn("r", ratio).orderBy(F.desc("r"), "key").limit(8).select("key", "useful", "dead", F.round("r", 6).alias("dead_ratio"))


_KNOBS = """(VALUES ('max_trace', 5, 3, 8), ('caller_hops', 2, 0, 3), ('max_upstream', 10, 3, 25), ('max_downstream', 5, 2, 15), ('max_importers', 10, 3, 20), ('max_methods', 8, 3, 20), ('max_siblings', 15, 3, 30),
('max_snippets', 10, 1, 10), ('max_impact', 15, 5, 30), ('max_symbols', 20, 3, 25), ('max_primary_ctx', 10, 3, 25), ('max_decisions', 5, 3, 10)) k(knob, "default", least, most)"""
_CURRENT = """CASE WHEN intent IN ('debug', 'trace') AND knob = 'max_upstream' THEN 20 WHEN intent IN ('debug', 'trace') AND knob = 'max_downstream' THEN 10 WHEN intent = 'debug' AND knob = 'max_snippets' THEN 7
WHEN intent = 'explore' AND knob = 'max_siblings' THEN 25 WHEN intent = 'explore' AND knob = 'max_upstream' THEN 5 WHEN intent = 'explore' AND knob = 'max_downstream' THEN 3
WHEN intent IN ('trace', 'refactor') AND knob = 'max_importers' THEN 15 WHEN intent = 'refactor' AND knob = 'max_impact' THEN 25 WHEN intent = 'refactor' AND knob = 'max_methods' THEN 12 ELSE "default" END"""


@query("reward_profile_deltas", f"SELECT intent, n, knob, current, \"default\", current - \"default\" AS delta, least, most FROM (SELECT intent, n, knob, \"default\", least, most, {_CURRENT} AS current FROM (SELECT intent, count(*)::BIGINT AS n FROM v_traces GROUP BY intent), {_KNOBS})")
def profile_deltas(s, d):
    """Each intent's knobs beside the defaults and bounds."""
    n = b.traces(s, d).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    rows = [F.struct(F.lit(k).alias("knob"), score.profile_knob(k, F.col("intent")).alias("current"), F.lit(v).alias("default"), F.lit(lo).alias("least"), F.lit(hi).alias("most")) for k, v, lo, hi in score.KNOBS]
    r = n.select("intent", "n", F.explode(F.array(*rows)).alias("k")).select("intent", "n", "k.*")
    return r.withColumn("delta", F.col("current") - F.col("default"))


@query("reward_profile_shrink", """SELECT event_id, CASE WHEN m >= 3 THEN 2 WHEN m = 2 THEN 3 ELSE 5 END AS max_trace, CASE WHEN m >= 2 THEN 1 ELSE 2 END AS caller_hops,
CASE WHEN m >= 3 THEN 1 WHEN m >= 1 THEN 2 WHEN intent = 'debug' THEN 7 ELSE 10 END AS max_snippets, CASE WHEN m >= 3 THEN 3 WHEN m >= 1 THEN 5 WHEN intent = 'explore' THEN 25 ELSE 15 END AS max_siblings,
CASE WHEN m >= 3 THEN 3 WHEN m >= 1 THEN 5 ELSE 20 END AS max_symbols FROM (SELECT event_id, intent, additional_files % 5 AS m FROM v_traces)""")
def profile_shrink(s, d):
    """The profile of a query's intent, less where memories that point at files answer it already."""
    m = F.col("additional_files") % 5
    return b.traces(s, d).select("event_id", *[score.shrunk_knob(k, score.profile_knob(k, F.col("intent")), m).alias(k) for k in ("max_trace", "caller_hops", "max_snippets", "max_siblings", "max_symbols")])


@query("reward_implicit", "SELECT user_id, event_id, CASE WHEN same THEN 0.0::DOUBLE WHEN near THEN 0.4::DOUBLE END AS reward FROM (SELECT user_id, event_id, event_type = lag(event_type) OVER w AND value = lag(value) OVER w AS same, event_type = lag(event_type) OVER w AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE near")
def implicit(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = b.table(s, d, "events").select("user_id", "event_id", "event_type", "value", F.lag("event_type").over(w).alias("t0"), F.lag("value").over(w).alias("v0"))
    sim = F.when((F.col("event_type") == F.col("t0")) & (F.col("value") == F.col("v0")), 1.0).when(F.col("event_type") == F.col("t0"), 0.8)
    return e.where("event_type = t0").select("user_id", "event_id", score.implicit_reward(sim).alias("reward"))


@query("reward_anchor_scores", f"WITH p AS (SELECT repo, intent, count(*) AS f, count(*) FILTER (raw >= 0.5) AS s FROM {R} GROUP BY ALL), g AS (SELECT intent, sum(f) AS gf, sum(s) AS gs FROM p GROUP BY intent) SELECT repo, intent, round((0.7::DOUBLE * least(f / 3.0::DOUBLE, 1) * (s + 1) / (f + 2) + (1 - 0.7::DOUBLE * least(f / 3.0::DOUBLE, 1)) * (gs + 1) / (gf + 2)), 6) AS score FROM p JOIN g USING (intent)")
def anchor_scores(s, d):
    p = b.rewards(s, d).groupBy("repo", "intent").agg(F.count(F.lit(1)).alias("f"), F.count_if(F.col("raw") >= 0.5).alias("s"))
    g = p.groupBy("intent").agg(F.sum("f").alias("gf"), F.sum("s").alias("gs"))
    points = score.anchor_score(F.col("s"), F.col("f"), F.col("gs"), F.col("gf"), F.lit(0.0))
    return p.join(F.broadcast(g), "intent").select("repo", "intent", F.round(points, 6).alias("score"))


# ---- evaluation ----------------------------------------------------------------------------------------------------


_WORDS = "list_filter(list_distinct(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')), lambda w: w <> '')"


@query("eval_recall_mrr", f"""
WITH iw AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), dw AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents WHERE text IS NOT NULL), df AS (SELECT w, count(*) AS n FROM dw GROUP BY w),
pick AS (SELECT item_id, w, n FROM (SELECT item_id, w, n, row_number() OVER (PARTITION BY item_id ORDER BY n, w) AS r FROM iw JOIN df USING (w)) WHERE r <= 8),
c AS (SELECT item_id, doc_id, sum(1000000 // n)::BIGINT AS score FROM pick JOIN dw USING (w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c),
g AS (SELECT r.item_id, rank FROM r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE contains(d.text, b.text))
SELECT b.item_id, count(g.rank)::BIGINT AS gold, round(count(*) FILTER (g.rank <= 10)::DOUBLE / greatest(1, count(g.rank)), 6) AS recall, round(coalesce(1.0::DOUBLE / min(g.rank), 0), 6) AS rr
FROM benchmark b LEFT JOIN g USING (item_id) GROUP BY b.item_id""")
def recall_mrr(s, d):
    """All documents are searched for each passage by its eight rarest words, weighed by how rare they are; gold are the documents that hold
    the passage, all of which share those words. Words are joined, never pairs of texts; texts meet only for pairs that the search found."""
    words = lambda c: F.array_distinct(text.words_of(F.col(c)))
    docs, items = b.docs(s, d).where("text is not null").select("doc_id", "text"), b.table(s, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    iw = items.select("item_id", F.explode(words("passage")).alias("w"))
    dw = materialised(docs.select("doc_id", F.explode(words("text")).alias("w")).join(iw.select("w").distinct(), "w", "left_semi"), "eval-words")
    df = dw.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pick = graph.top_per(iw.join(df, "w"), ["item_id"], [F.col("n"), F.col("w")], 8).select("item_id", "w", "n")
    found = dw.join(pick, "w").groupBy("item_id", "doc_id").agg(F.sum(F.floor(F.lit(1_000_000) / F.col("n"))).alias("score"))
    ranked = materialised(found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))), "eval-ranked")
    gold = ranked.join(items, "item_id").join(docs, "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", "rank")
    g = items.select("item_id").join(gold, "item_id", "left").groupBy("item_id").agg(F.count("rank").alias("gold"), F.count_if(F.col("rank") <= 10).alias("top"), F.min("rank").alias("first"))
    return g.select("item_id", "gold", F.round(F.col("top") / F.greatest("gold", F.lit(1)), 6).alias("recall"), F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), 6).alias("rr"))


@query("eval_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles(s, d):
    return b.table(s, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("eval_adapter_rollup", f"SELECT repo, intent, count(*)::BIGINT AS n, round(avg(raw), 6) AS mean FROM {R} GROUP BY ROLLUP (repo, intent)")
def adapter_rollup(s, d):
    return b.rewards(s, d).rollup("repo", "intent").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("raw"), 6).alias("mean"))


@query("eval_uniform_tokens", "SELECT lang, (sum(least(strlen(text), 65536) + length(source)) // 4)::BIGINT AS tokens FROM documents GROUP BY lang")
def uniform_tokens(s, d):
    return b.docs(s, d).groupBy("lang").agg(F.expr("sum(least(octet_length(text), 65536) + length(source)) div 4").alias("tokens"))


@query("eval_label_counts", "SELECT quality, toxic, d.lang, count(*)::BIGINT AS n FROM labels JOIN documents d USING (doc_id) GROUP BY ALL")
def label_counts(s, d):
    return b.table(s, d, "labels").join(b.docs(s, d).select("doc_id", "lang"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count(F.lit(1)).alias("n"))


# ---- memories ------------------------------------------------------------------------------------------------------

_DOT = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * m.embedding[i]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({t}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_COS = f"({_DOT} / ({_NORM.format(t='a')} * {_NORM.format(t='m')}))"


def with_distance(memories: DataFrame, probe: DataFrame) -> DataFrame:
    """Cosine distance to each probe (probe_id, probe); the probes are the query, a few rows that the caller names."""
    return memories.crossJoin(F.broadcast(probe)).withColumn("distance", 1 - vector.cosine(F.col("embedding"), F.col("probe")))


def probes(s, d, ids: tuple[int, ...]) -> DataFrame:
    return b.table(s, d, "embeddings").where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("probe_id"), F.col("embedding").alias("probe"))


@query("vector_knn", f"SELECT m.key, round(1 - {_COS}, 6) AS distance FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 3) a WHERE m.mem_type = 'func' AND m.scope IN ('global') ORDER BY 1 - {_COS}, m.key LIMIT 10")
def knn(s, d):
    m = b.memories(s, d).where((F.col("mem_type") == "func") & F.col("scope").isin("global"))
    return with_distance(m, probes(s, d, (3,))).orderBy("distance", "key").limit(10).select("key", F.round("distance", 6).alias("distance"))


@query("vector_knn_per_type", f"SELECT mem_type, key, rank::INTEGER AS rank FROM (SELECT m.mem_type, m.key, row_number() OVER (PARTITION BY m.mem_type ORDER BY 1 - {_COS}, m.key) AS rank FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 5) a) WHERE rank <= 5")
def knn_per_type(s, d):
    near = with_distance(b.memories(s, d), probes(s, d, (5,))).select("mem_type", "key", "distance")
    return graph.top_per(near, ["mem_type"], [F.col("distance"), F.col("key")], 5).select("mem_type", "key", "rank")


@query("vector_distance_floor", f"SELECT m.key FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 7) a WHERE NOT (1 - {_COS} > 1e-9 AND 1 - {_COS} > 0.6)")
def distance_floor(s, d):
    near = with_distance(b.memories(s, d), probes(s, d, (7,)))
    return near.where(~((F.col("distance") > 1e-9) & (F.col("distance") > 0.6))).select("key")


@query("vector_fp_demotion", f"SELECT key, round(dist + CASE WHEN 1 - dist >= 0.70 THEN 0.20::DOUBLE * least(n / 3.0::DOUBLE, 1) * (1 - dist) ELSE 0 END, 6) AS demoted FROM (SELECT m.key, 1 - {_COS} AS dist, m.vec_id % 4 AS n FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 9) a WHERE m.vec_id <> 9)")
def fp_demotion(s, d):
    near = with_distance(b.memories(s, d).where("vec_id <> 9"), probes(s, d, (9,)))
    return near.select("key", F.round(F.col("distance") + score.fp_penalty(1 - F.col("distance"), F.col("vec_id") % 4), 6).alias("demoted"))


@query("vector_should_rerank", f"SELECT key FROM (SELECT m.key, {_COS} + 0.10::DOUBLE * (contains(m.file, '1'))::INTEGER + 0.05::DOUBLE * (m.source = 'agent')::INTEGER AS sim FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 11) a) ORDER BY sim DESC, key LIMIT 20")
def should_rerank(s, d):
    near = with_distance(b.memories(s, d), probes(s, d, (11,)))
    sim = 1 - F.col("distance") + 0.10 * F.contains("file", F.lit("1")).cast("int") + 0.05 * (F.col("source") == "agent").cast("int")
    return near.select("key", sim.alias("sim")).orderBy(F.desc("sim"), "key").limit(20).select("key")


@query("vector_centroids", "SELECT label, pos::INTEGER AS pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def centroids(s, d):
    e = b.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query("vector_similarity_stats", f"SELECT m.repo, round(max({_COS}), 6) AS most, round(avg({_COS}), 6) AS mean FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 13) a WHERE m.vec_id <> 13 GROUP BY m.repo")
def similarity_stats(s, d):
    near = with_distance(b.memories(s, d).where("vec_id <> 13"), probes(s, d, (13,))).withColumn("sim", 1 - F.col("distance"))
    return near.groupBy("repo").agg(F.round(F.max("sim"), 6).alias("most"), F.round(F.avg("sim"), 6).alias("mean"))


@query("vector_context_confidence", "SELECT repo, round(avg(1.0::DOUBLE * CASE WHEN scope = 'branch' THEN 0.6::DOUBLE ELSE 1 END), 6) AS confidence, CASE WHEN count(*) FILTER (scope <> 'branch') >= 3 THEN 'high' WHEN count(*) FILTER (scope <> 'branch') >= 1 THEN 'partial' ELSE 'low' END AS coverage FROM v_memories GROUP BY repo")
def context_confidence(s, d):
    stale = F.col("scope") == "branch"
    fresh = F.count_if(~stale)
    g = b.memories(s, d).groupBy("repo").agg(F.round(F.avg(score.confidence(F.lit(1.0), stale)), 6).alias("confidence"), fresh.alias("fresh"))
    return g.select("repo", "confidence", F.when(F.col("fresh") >= 3, "high").when(F.col("fresh") >= 1, "partial").otherwise("low").alias("coverage"))


@query("vector_memory_partition", "SELECT mem_type, CASE WHEN source = 'auto' THEN 'hint' ELSE 'memory' END AS section, count(*)::BIGINT AS n FROM v_memories GROUP BY ALL")
def memory_partition(s, d):
    section = F.when(F.col("source") == "auto", "hint").otherwise("memory")
    return b.memories(s, d).groupBy("mem_type", section.alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query("vector_populate_guard", "SELECT vec_id, repo, file, (repo || ' ' || file) NOT IN (SELECT repo || ' ' || file FROM v_memories WHERE source = 'agent') AS free FROM v_memories WHERE source = 'auto'")
def populate_guard(s, d):
    """Whether an automatic memory may be written: not where an agent has written one of the same repository and file."""
    m = b.memories(s, d).select("vec_id", "repo", "file", "source")
    held = m.where("source = 'agent'").select("repo", "file").distinct().withColumn("held", F.lit(True))
    return m.where("source = 'auto'").join(held, ["repo", "file"], "left").select("vec_id", "repo", "file", F.col("held").isNull().alias("free"))


# ---- graph loops ---------------------------------------------------------------------------------------------------

_REACH = """WITH RECURSIVE pairs AS (SELECT DISTINCT {s} AS s, {t} AS t FROM {src}), walk(id, depth) AS (SELECT {seed}, 0 UNION SELECT t, depth + 1 FROM walk JOIN pairs ON s = id WHERE depth < {depth})
SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id"""


def one(spark, value, kind: str) -> DataFrame:
    return spark.range(1).select(F.lit(value).cast(kind).alias("id"))


@query("graph_bfs", _REACH.format(s="source", t="target", src=f"{E} WHERE kind IN ('contains','calls')", seed="'namespace:3'", depth=3))
def bfs(s, d):
    return graph.reach(b.edges(s, d, ("contains", "calls")), one(s, "namespace:3", "string"), 3)


@query("graph_callers_depth", _REACH.format(s="target", t="source", src=f"{E} WHERE kind <> 'contains'", seed="'struct:1'", depth=2))
def callers_depth(s, d):
    return graph.reach(graph.reverse(b.edges(s, d, ("calls", "references"))), one(s, "struct:1", "string"), 2)


@query("graph_call_graph", f"WITH RECURSIVE pairs AS (SELECT DISTINCT source AS s, target AS t FROM {E} WHERE kind <> 'contains'), down(id, depth) AS (SELECT 'function:2', 0 UNION SELECT t, depth + 1 FROM down JOIN pairs ON s = id WHERE depth < 2), up(id, depth) AS (SELECT 'function:2', 0 UNION SELECT s, depth + 1 FROM up JOIN pairs ON t = id WHERE depth < 2) SELECT DISTINCT id FROM (SELECT id FROM down UNION ALL SELECT id FROM up)")
def call_graph(s, d):
    e = graph.materialised(b.edges(s, d, ("calls", "references")).select("source", "target").distinct())
    seed = one(s, "function:2", "string")
    return graph.reach(e, seed, 2).unionByName(graph.reach(graph.reverse(e), seed, 2)).select("id").distinct()


@query("graph_type_hierarchy", _REACH.format(s="source", t="target", src="v_nation_dep", seed="0::BIGINT", depth=25))
def type_hierarchy(s, d):
    return graph.reach(b.nation_dep(s, d), one(s, 0, "long"), 25)


@query("graph_find_usages", f"SELECT source, kind, count(*)::BIGINT AS n FROM {E} WHERE target = 'function:5' GROUP BY ALL")
def find_usages(s, d):
    return b.edges(s, d).where("target = 'function:5'").groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("graph_impact_radius", f"WITH RECURSIVE dep AS (SELECT DISTINCT target AS s, source AS t FROM {E} WHERE kind <> 'contains'), walk(id, depth) AS (SELECT 'struct:3', 0 UNION SELECT t, depth + 1 FROM walk JOIN dep ON s = id WHERE depth < 2) SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id")
def impact_radius(s, d):
    """A struct contains nothing here, so that members add no rows; impact() itself takes them in."""
    return graph.impact(b.edges(s, d), one(s, "struct:3", "string"), 2)


@query("graph_impact_container", f"""
WITH RECURSIVE inside AS (SELECT DISTINCT source AS s, target AS t FROM {E} WHERE kind = 'contains'), dep AS (SELECT DISTINCT target AS s, source AS t FROM {E} WHERE kind <> 'contains'),
walk(id, depth) AS (SELECT 'namespace:3', 0 UNION (SELECT t, depth FROM walk JOIN inside ON s = id UNION ALL SELECT t, depth + 1 FROM walk JOIN dep ON s = id WHERE depth < 1))
SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id""")
def impact_container(s, d):
    """What depends on anything within a namespace: its classes, structs and methods are taken in first, at no cost."""
    return graph.impact(b.edges(s, d), one(s, "namespace:3", "string"), 1)


@query("graph_shortest_path", "WITH RECURSIVE walk(id, depth, path) AS (SELECT 0::BIGINT, 0, [0::BIGINT] UNION ALL SELECT target, depth + 1, list_append(path, target) FROM walk JOIN v_nation_dep ON source = id WHERE depth < 4 AND NOT list_contains(path, target)) SELECT id, min(depth)::INTEGER AS depth, array_to_string(arg_min(path, (depth, path)), '>') AS path FROM walk GROUP BY id")
def shortest_path(s, d):
    e = b.nation_dep(s, d).unionByName(s.range(1).select(F.lit(0).cast("long").alias("source"), F.lit(-1).cast("long").alias("target")).where("false"))
    p = graph.shortest_paths(e, F.lit(0).cast("long"), 4)
    return p.select("id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("graph_ancestors", f"WITH RECURSIVE up(id, depth) AS (SELECT 'method:7', 0 UNION ALL SELECT source, depth + 1 FROM up JOIN {E} ON target = id AND kind = 'contains') SELECT id, depth::INTEGER AS depth FROM up")
def ancestors(s, d):
    return graph.reach(graph.reverse(b.edges(s, d, ("contains",))), one(s, "method:7", "string"), 8)


@query("graph_node_context", f"SELECT 'out' AS side, kind, target AS other FROM {E} WHERE source = 'namespace:3' UNION ALL SELECT 'in', kind, source FROM {E} WHERE target = 'namespace:3'")
def node_context(s, d):
    e = b.edges(s, d)
    out = e.where("source = 'namespace:3'").select(F.lit("out").alias("side"), "kind", F.col("target").alias("other"))
    return out.unionByName(e.where("target = 'namespace:3'").select(F.lit("in").alias("side"), "kind", F.col("source").alias("other")))


@query("graph_cycles", "WITH RECURSIVE walk(a, z) AS (SELECT source, target FROM v_nation_dep UNION SELECT a, target FROM walk JOIN v_nation_dep ON source = z) SELECT DISTINCT a AS id FROM walk WHERE a = z")
def cycles(s, d):
    return graph.cycle_members(b.nation_dep(s, d))


@query("graph_filtered_subgraph", f"WITH keep AS (SELECT id FROM {N} WHERE is_exported AND kind <> 'method') SELECT source, target, kind FROM {E} WHERE source IN (SELECT id FROM keep) AND target IN (SELECT id FROM keep)")
def filtered_subgraph(s, d):
    keep = b.nodes(s, d).where("is_exported AND kind <> 'method'").select("id")
    return graph.induced(b.edges(s, d), keep).select("source", "target", "kind")


@query("graph_exported", f"SELECT id, kind FROM {N} WHERE is_exported")
def exported(s, d):
    return b.nodes(s, d).where("is_exported").select("id", "kind")


@query("graph_affected_tests", "WITH RECURSIVE walk(id, depth) AS (SELECT DISTINCT target, 0 FROM v_nation_dep WHERE target % 5 = 2 UNION SELECT source, depth + 1 FROM walk JOIN v_nation_dep ON target = id WHERE depth < 5 AND (depth = 0 OR id % 5 <> 0)) SELECT DISTINCT id FROM walk WHERE id % 5 = 0 AND depth > 0")
def affected_tests(s, d):
    is_test = F.col("id") % 5 == 0
    deps = materialised(b.nation_dep(s, d), "deps")
    changed = deps.where("target % 5 = 2").select(F.col("target").alias("id")).distinct()
    found = graph.reach(graph.reverse(deps), changed, 5, stop=is_test)
    return found.where(is_test & (F.col("depth") > 0)).select("id")


_RANK_STEP = "SELECT b.id, 0.25::DOUBLE * b.base + 0.75::DOUBLE * coalesce(sum(r.rank * p.p), 0) AS rank FROM base b LEFT JOIN p ON p.t = b.id LEFT JOIN r{i} r ON r.id = p.s GROUP BY b.id, b.base"
_RANKS = ", ".join(f"r{i + 1} AS MATERIALIZED ({_RANK_STEP.format(i=i)})" for i in range(25))


@query("graph_pagerank", f"WITH e AS (SELECT source AS s, target AS t FROM v_nation_dep UNION ALL SELECT target, source FROM v_nation_dep), w AS (SELECT s, t, count(*) AS w FROM e GROUP BY ALL), p AS MATERIALIZED (SELECT s, t, w::DOUBLE / sum(w) OVER (PARTITION BY s) AS p FROM w), base AS MATERIALIZED (SELECT id, (id IN (1, 2))::INTEGER / 2.0::DOUBLE AS base FROM (SELECT DISTINCT s AS id FROM e)), r0 AS (SELECT id, base AS rank FROM base), {_RANKS} SELECT id, round(rank, 6) AS rank FROM r25")
def pagerank(s, d):
    seeds = b.table(s, d, "nation").where("n_nationkey in (1, 2)").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph.personalised_pagerank(materialised(b.nation_dep(s, d), "deps"), seeds).select("id", F.round("rank", 6).alias("rank"))


@query("graph_components", f"WITH RECURSIVE e AS (SELECT source AS s, target AS t FROM {E} WHERE kind = 'contains' UNION ALL SELECT target, source FROM {E} WHERE kind = 'contains'), top(id, root) AS (SELECT id, id FROM {N} WHERE kind = 'module' UNION SELECT t, root FROM top JOIN e ON s = id) SELECT min(id) AS component, count(DISTINCT id)::BIGINT AS members FROM top GROUP BY root")
def components(s, d):
    return graph.components_of(b.edges(s, d, ("contains",))).groupBy("component").agg(F.count(F.lit(1)).alias("members"))


_NEXT = """SELECT start, id, {i} AS depth, min(streak) AS streak FROM (SELECT l.start, e.target AS id, CASE WHEN e.target IN (SELECT id FROM named) THEN 0 ELSE l.streak + 1 END AS streak FROM l{j} l JOIN (SELECT DISTINCT source, target FROM v_nation_dep) e ON e.source = l.id)
WHERE streak <= 1 AND start || '>' || id NOT IN ({seen}) GROUP BY start, id"""
_LEVELS = ", ".join(f"l{i} AS MATERIALIZED ({_NEXT.format(i=i, j=i - 1, seen=' UNION ALL '.join(f'SELECT start || chr(62) || id FROM l{k}' for k in range(i)))})" for i in range(1, 8))


@query("graph_named_flow", f"WITH named AS (SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey < 3), l0 AS (SELECT id AS start, id, 0 AS depth, 0 AS streak FROM named), {_LEVELS} SELECT start, id, depth::INTEGER AS depth, streak::INTEGER AS streak FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(8)) + ")")
def named_flow(s, d):
    named = b.table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph.named_flow(materialised(b.nation_dep(s, d), "deps"), named)


_STEP = """l{i} AS MATERIALIZED (SELECT start, id, {i} AS depth, min(streak) AS streak, arg_min(path, (streak, path)) AS path FROM (
SELECT l.start, e.target AS id, list_append(l.path, e.target) AS path, CASE WHEN e.target IN (SELECT id FROM named) THEN 0 ELSE l.streak + 1 END AS streak FROM l{j} l JOIN (SELECT DISTINCT source, target FROM v_nation_dep) e ON e.source = l.id)
WHERE streak <= 1 AND start || '>' || id NOT IN ({seen}) GROUP BY start, id)"""
_STEPS = ", ".join(_STEP.format(i=i, j=i - 1, seen=" UNION ALL ".join(f"SELECT start || chr(62) || id FROM l{k}" for k in range(i))) for i in range(1, 7))


@query("graph_longest_flow", f"WITH named AS (SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey % 2 = 0), l0 AS (SELECT id AS start, id, 0 AS depth, 0 AS streak, [id] AS path FROM named ORDER BY id LIMIT 8), {_STEPS}, best AS (SELECT path FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, 7)) + ") WHERE id IN (SELECT id FROM named) AND depth >= 2 ORDER BY depth DESC, start, id LIMIT 1) SELECT generate_subscripts(path, 1)::INTEGER AS place, unnest(path) AS id FROM best")
def longest_flow(s, d):
    """The chain itself, a row for each of its symbols."""
    named = b.table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("id"))
    return graph.longest_flow(materialised(b.nation_dep(s, d), "deps"), named)


@query("graph_blast_radius", f"SELECT z.id, count(DISTINCT a.id)::BIGINT AS callers, count(DISTINCT a.file_path)::BIGINT AS files FROM {E} e JOIN {N} z ON z.id = e.target JOIN {N} a ON a.id = e.source WHERE e.kind = 'calls' AND z.file_path = 'parts/brand11/t15.py' GROUP BY z.id")
def blast_radius(s, d):
    n = b.nodes(s, d)
    z = n.where("file_path = 'parts/brand11/t15.py'").select(F.col("id").alias("target"))
    e = b.edges(s, d, ("calls",)).join(z, "target", "left_semi").select("source", "target").distinct()
    j = e.join(n.select(F.col("id").alias("source"), "file_path"), "source")
    return j.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.count_distinct("file_path").alias("files"))


# ---- resolution ----------------------------------------------------------------------------------------------------


@query("resolve_exact_name", f"WITH refs AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem), cand AS (SELECT name, count(*) AS n, min(id) AS id FROM {N} WHERE kind = 'function' GROUP BY name) SELECT l_orderkey, l_linenumber, c.id, CASE WHEN c.n = 1 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM refs JOIN part p ON p.p_partkey = l_partkey JOIN cand c ON c.name = p.p_name")
def exact_name(s, d):
    """Every line's reference to a function by name. Candidates are looked up for each function, before the lines meet them."""
    cand = b.nodes(s, d).where("kind = 'function'").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    known = b.table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")).join(cand, "name")
    known = known.select("l_partkey", "id", F.when(F.col("n") == 1, 0.9).otherwise(0.4).alias("confidence"))
    return b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(known, "l_partkey").select("l_orderkey", "l_linenumber", "id", "confidence")


@query("resolve_best_match", f"WITH c AS (SELECT a.id AS ref, z.id AS target, CASE WHEN a.file_path = z.file_path THEN 100 ELSE 0 END + CASE WHEN a.language = z.language THEN 50 ELSE -80 END + CASE WHEN z.is_exported THEN 10 ELSE 0 END + greatest(0, 20 - abs(a.start_line - z.start_line) // 10) AS points FROM {N} a JOIN {N} z ON a.name = z.name AND a.id <> z.id WHERE a.kind = 'function' AND z.kind = 'function') SELECT ref, target, points::INTEGER AS points FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY points DESC, target) AS rn FROM c) WHERE rn = 1 AND points > -1")
def best_match(s, d):
    n = b.nodes(s, d).where("kind = 'function'").select("id", "name", "file_path", "language", "start_line", F.coalesce("is_exported", F.lit(False)).alias("is_exported"))
    return resolution.best_homonyms(n)


@query("resolve_fuzzy_name", f"SELECT lower(name) AS low, count(*)::BIGINT AS n, CASE WHEN count(*) = 1 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM {N} GROUP BY 1")
def fuzzy_name(s, d):
    g = b.nodes(s, d).groupBy(F.lower("name").alias("low")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("confidence", F.when(F.col("n") == 1, 0.5).otherwise(0.3))


@query("resolve_overrides", "WITH o AS (SELECT o_orderkey AS sub, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS base FROM orders) SELECT base, sub, z.l_linenumber FROM o JOIN lineitem a ON a.l_orderkey = base JOIN lineitem z ON z.l_orderkey = sub AND z.l_linenumber = a.l_linenumber WHERE a.l_returnflag = z.l_returnflag")
def overrides(s, d):
    """A customer's order extends the one before it and overrides its lines of the same number and flag: at most as many links as lines."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = b.table(s, d, "orders").select(F.col("o_orderkey").alias("sub"), before.alias("base")).where("base is not null")
    li = b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    own = li.withColumnRenamed("l_orderkey", "sub").join(o, "sub")
    return own.join(li.withColumnRenamed("l_orderkey", "base"), ["base", "l_linenumber", "l_returnflag"]).select("base", "sub", "l_linenumber")


@query("resolve_event_channels", "WITH l AS (SELECT l_partkey || '/' || l_returnflag || l_linestatus || l_linenumber AS event, l_suppkey, l_orderkey FROM lineitem), e AS (SELECT event FROM l GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 6 AND count(DISTINCT l_orderkey) <= 6) SELECT DISTINCT a.l_suppkey AS emitter, z.l_orderkey AS handler FROM l a JOIN l z USING (event) JOIN e USING (event)")
def event_channels(s, d):
    """Emitters and handlers of an event by its name; events with more than six of either are left out, as too common a name."""
    li = b.table(s, d, "lineitem").select(F.concat(F.col("l_partkey").cast("string"), F.lit("/"), "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("event"), "l_suppkey", "l_orderkey")
    few = li.groupBy("event").agg(F.count_distinct("l_suppkey").alias("a"), F.count_distinct("l_orderkey").alias("z")).where("a <= 6 AND z <= 6").select("event")
    own = li.join(few, "event", "left_semi")
    emits, hears = own.select("event", F.col("l_suppkey").alias("emitter")).distinct(), own.select("event", F.col("l_orderkey").alias("handler")).distinct()
    return emits.join(hears, "event").select("emitter", "handler").distinct()


@query("resolve_edge_kinds", f"SELECT CASE WHEN e.kind = 'references' AND z.kind = 'struct' THEN 'instantiates' ELSE e.kind END AS kind, count(*)::BIGINT AS n FROM {E} e JOIN {N} z ON z.id = e.target GROUP BY 1")
def edge_kinds(s, d):
    n = b.nodes(s, d).select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
    kind = F.when((F.col("kind") == "references") & (F.col("target_kind") == "struct"), "instantiates").otherwise(F.col("kind"))
    return b.edges(s, d).join(n, "target").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("resolve_stats", f"SELECT confidence, count(*)::BIGINT AS n FROM (SELECT CASE WHEN count(*) = 1 THEN 'unique' WHEN count(*) <= 3 THEN 'few' ELSE 'many' END AS confidence FROM {N} GROUP BY name) GROUP BY confidence")
def resolve_stats(s, d):
    g = b.nodes(s, d).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    c = F.when(F.col("n") == 1, "unique").when(F.col("n") <= 3, "few").otherwise("many")
    return g.groupBy(c.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))

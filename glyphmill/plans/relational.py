"""Lookups, filters, joins and aggregates over the graph views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import score, text
from glyphmill.operators import ordered
from glyphmill.operators.graph import first_by, induced, top_per
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

N, E = "v_nodes", "v_edges"

# ---- lookups and filters -------------------------------------------------------------------------------------------


@query("scan_by_ids", f"SELECT id, kind, name, file_path FROM {N} WHERE id IN ('module:1','namespace:3','class:7','function:11','method:32')")
def by_ids(s, d):
    return b.nodes(s, d).where(F.col("id").isin("module:1", "namespace:3", "class:7", "function:11", "method:32")).select("id", "kind", "name", "file_path")


@query("scan_by_file", f"SELECT id, name, start_line FROM {N} WHERE file_path LIKE 'parts/brand11/%'")
def by_file(s, d):
    return b.nodes(s, d).where(F.startswith("file_path", F.lit("parts/brand11/"))).select("id", "name", "start_line").orderBy("start_line", "id")


@query("scan_by_kind_name", f"SELECT id, kind, name FROM {N} WHERE kind = 'namespace' OR lower(name) = 'asia'")
def by_kind_name(s, d):
    return b.nodes(s, d).where((F.col("kind") == "namespace") | (F.lower("name") == "asia")).select("id", "kind", "name")


@query("scan_outgoing_edges", f"SELECT source, target, kind, line FROM {E} WHERE source IN ('class:1','class:2','method:1','method:5') AND kind IN ('contains','calls')")
def outgoing(s, d):
    e = b.edges(s, d, ("contains", "calls"))
    return e.where(F.col("source").isin("class:1", "class:2", "method:1", "method:5"))


@query("scan_incoming_edges", f"SELECT source, target, kind, line FROM {E} WHERE target IN ('function:3','function:9','struct:2') AND kind <> 'contains'")
def incoming(s, d):
    return b.edges(s, d, ("calls", "references")).where(F.col("target").isin("function:3", "function:9", "struct:2"))


@query("scan_edges_between", f"WITH ids AS (SELECT id FROM {N} WHERE kind IN ('module','namespace') OR file_path LIKE 'world/1/%') SELECT source, target, kind FROM {E} WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids)")
def edges_between(s, d):
    n = b.nodes(s, d)
    ids = n.where(F.col("kind").isin("module", "namespace") | F.startswith("file_path", F.lit("world/1/"))).select("id")
    return induced(b.edges(s, d), ids).select("source", "target", "kind")


@query("filter_substring_name", f"SELECT id, name FROM {N} WHERE kind = 'function' AND contains(lower(name), 'ing') AND NOT starts_with(lower(name), 'ing') ORDER BY length(name), id LIMIT 50")
def substring_name(s, d):
    n = b.nodes(s, d).where("kind = 'function'").select("id", "name")
    return n.where(F.contains(F.lower("name"), F.lit("ing")) & ~F.startswith(F.lower("name"), F.lit("ing"))).orderBy(F.length("name"), "id").limit(50)


@query("filter_glob_qualified", f"SELECT id, qualified_name FROM {N} WHERE kind IN ('function','class','struct','method') AND regexp_full_match(qualified_name, 'Brand#1.\\..*')")
def glob_qualified(s, d):
    n = b.nodes(s, d).where(F.col("kind").isin("function", "class", "struct", "method"))
    return n.where(F.rlike("qualified_name", F.lit("^Brand#1.\\..*$"))).select("id", "qualified_name")


@query("filter_file_listing", f"SELECT DISTINCT file_path FROM {N} WHERE starts_with(file_path, 'parts/') AND regexp_matches(file_path, '^parts/[^/]*/t[0-9]+\\.py$')")
def file_listing(s, d):
    n = b.nodes(s, d).select("file_path").where(F.startswith("file_path", F.lit("parts/")) & F.rlike("file_path", F.lit("^parts/[^/]*/t[0-9]+\\.py$")))
    return n.distinct()


#: The rules of test files written out over file_path, apart from the pattern that the functions use.
_IS_TEST = """regexp_matches(lower(parse_filename(file_path)), '^test[_.]|[._-](tests?|specs?)\\.[a-z0-9]+$') OR regexp_matches(parse_filename(file_path), '(Test|Tests|TestCase|Tester|Spec|Specs)\\.[A-Za-z0-9]+$') OR regexp_matches(lower(file_path), '/(tests?|__tests__|specs?|testlib|testing)/|^(tests?|specs?)/') OR regexp_matches(file_path, '(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/') OR len(list_intersect(string_split(lower(file_path), '/')[1:-2], ['integration','sample','samples','example','examples','fixture','fixtures','benchmark','benchmarks','demo','demos'])) > 0"""
_PATHS = "(SELECT DISTINCT file_path FROM v_nodes UNION SELECT split_part(split_part(url, '://', 2), '?', 1) FROM pages UNION SELECT 'src/' || source || '/' || lang || ['/test_a.py', '/a_test.go', '/FooTest.java', '/latest.kt', 'Test/x.kt', '/demo/x.ts', '/testing/x.go', '/x.spec.ts', '/x.pb.go', '/mock_x.go', '/x_mock.go', '/x.g.dart', '/AGrpc.java'][(doc_id % 13 + 1)::INTEGER] FROM documents)"


def _paths(s, d):
    """File paths of symbols, of pages and, with the endings that conventions know, of documents."""
    ends = ("/test_a.py", "/a_test.go", "/FooTest.java", "/latest.kt", "Test/x.kt", "/demo/x.ts", "/testing/x.go", "/x.spec.ts", "/x.pb.go", "/mock_x.go", "/x_mock.go", "/x.g.dart", "/AGrpc.java")
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("doc_id") % 13 + 1).cast("int"))
    urls = b.table(s, d, "pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)).alias("file_path"))
    docs = b.table(s, d, "documents").select(F.concat(F.lit("src/"), "source", F.lit("/"), "lang", end).alias("file_path"))
    return b.nodes(s, d).select("file_path").unionByName(urls).unionByName(docs).distinct()


@query("filter_test_files", f"SELECT file_path, {_IS_TEST} AS is_test FROM {_PATHS}")
def test_files(s, d):
    return _paths(s, d).withColumn("is_test", score.is_test_path(F.col("file_path")))


@query("filter_low_value_files", f"SELECT file_path, regexp_matches(lower(file_path), '(^|/)(tests?|__tests?__|spec)/|_test\\.(go|py|rb|dart)$|(^|/)test_[^/]+\\.py$|_spec\\.rb$|\\.(test|spec)\\.[jt]sx?$|(test|spec|tests)\\.(java|kt|scala)$|(tests?|spec)\\.cs$|tests?\\.swift$') OR regexp_matches(file_path, '(\\.pb|\\.pulsar|_mocks?)\\.go$|^mock_[^/]+\\.go$|\\.(generated|gen)\\.[jt]sx?$|(\\.|_|_grpc_)pb\\.[jt]s$|_pb2(_grpc)?\\.py$|_pb2\\.pyi$|\\.pb\\.(cc|h|swift|dart)$|\\.g\\.(cs|dart)$|Grpc\\.(cs|java)$|OuterClass\\.java$|\\.(freezed|pbgrpc|chopper)\\.dart$|\\.generated\\.rs$') AS low FROM {_PATHS}")
def low_value(s, d):
    return _paths(s, d).withColumn("low", score.is_low_value(F.col("file_path")))


@query("filter_exclude_conventions", f"SELECT id FROM {N} WHERE NOT (regexp_matches(file_path, '_test\\.go$|/tests?/|(^|/)test_') OR regexp_matches(name, '^test($|[A-Z])'))")
def exclude_conventions(s, d):
    bad = F.rlike("file_path", F.lit("_test\\.go$|/tests?/|(^|/)test_")) | F.rlike("name", F.lit("^test($|[A-Z])"))
    return b.nodes(s, d).where(~bad).select("id")


@query("filter_decisions", "SELECT name, decision_type, scope FROM v_decisions WHERE repo = 'r3' AND status = 'active' AND contains(scope, 'src1') AND len(list_filter(files, lambda x: x IN ('src/3','src/13','lib/23'))) > 0")
def decision_filter(s, d):
    v = b.decisions(s, d)
    hit = F.arrays_overlap("files", F.array(F.lit("src/3"), F.lit("src/13"), F.lit("lib/23")))
    return v.where((F.col("repo") == "r3") & (F.col("status") == "active") & F.contains("scope", F.lit("src1")) & hit).select("name", "decision_type", "scope")


@query("filter_plan_sanitise", "SELECT item_id, array_to_string(list_slice(list_distinct_ordered, 1, 6), ' ') AS should FROM (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_ordered FROM (SELECT item_id, list_filter(list_transform(string_split(lower(text), ' '), lambda x: trim(x)), lambda x: strlen(x) >= 2 AND strlen(x) <= 40) AS w FROM benchmark))")
def plan_sanitise(s, d):
    w = F.filter(F.transform(F.split(F.lower("text"), " "), F.trim), lambda x: (F.octet_length(x) >= 2) & (F.octet_length(x) <= 40))
    return b.table(s, d, "benchmark").select("item_id", F.array_join(F.slice(F.array_distinct(w), 1, 6), " ").alias("should"))


@query("filter_known_names", f"SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def known_names(s, d):
    known = b.table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return b.table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").join(known, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("filter_language_gate", f"SELECT e.kind, a.language AS from_language, z.language AS to_language, count(*)::BIGINT AS n FROM {E} e JOIN {N} a ON a.id = e.source JOIN {N} z ON z.id = e.target WHERE e.kind <> 'references' OR a.language = z.language GROUP BY ALL")
def language_gate(s, d):
    n = b.nodes(s, d).select("id", "language")
    j = b.edges(s, d).join(n.select(F.col("id").alias("source"), F.col("language").alias("from_language")), "source").join(n.select(F.col("id").alias("target"), F.col("language").alias("to_language")), "target")
    return j.where((F.col("kind") != "references") | (F.col("from_language") == F.col("to_language"))).groupBy("kind", "from_language", "to_language").agg(F.count(F.lit(1)).alias("n"))


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("join_intra_file_edges", f"SELECT a.file_path, e.kind, count(*)::BIGINT AS n FROM {E} e JOIN {N} a ON a.id = e.source JOIN {N} z ON z.id = e.target WHERE a.file_path = z.file_path OR (a.language = z.language AND e.kind = 'contains') GROUP BY ALL")
def intra_file(s, d):
    n = b.nodes(s, d).select("id", "file_path", "language")
    a, z = n.toDF("source", "file_path", "l1"), n.toDF("target", "f2", "l2")
    j = b.edges(s, d).select("source", "target", "kind").join(a, "source").join(z, "target")
    return j.where((F.col("file_path") == F.col("f2")) | ((F.col("l1") == F.col("l2")) & (F.col("kind") == "contains"))).groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("join_routing_manifest", "SELECT r.page_id, r.href, p.page_id AS handler FROM v_routes r JOIN pages p ON ends_with(p.url, '/' || r.page_id)")
def routing_manifest(s, d):
    r = b.routes(s, d).withColumn("tail", F.col("page_id").cast("string"))
    p = b.table(s, d, "pages").select(F.col("page_id").alias("handler"), F.regexp_extract("url", "/([^/]*)$", 1).alias("tail"))
    return r.join(p, "tail").select("page_id", "href", "handler")


@query("join_file_dependencies", f"SELECT DISTINCT a.file_path AS from_file, z.file_path AS to_file FROM {E} e JOIN {N} a ON a.id = e.source JOIN {N} z ON z.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> z.file_path")
def file_dependencies(s, d):
    n = b.nodes(s, d).select("id", "file_path")
    e = b.edges(s, d, ("calls", "references")).select("source", "target").distinct()
    j = e.join(n.toDF("source", "from_file"), "source").join(n.toDF("target", "to_file"), "target")
    return j.where("from_file <> to_file").select("from_file", "to_file").distinct()


@query("join_callers_by_name", f"SELECT DISTINCT a.name AS caller, z.name AS callee FROM {E} e JOIN {N} a ON a.id = e.source JOIN {N} z ON z.id = e.target WHERE e.kind = 'calls' AND z.name IN (SELECT p_name FROM part WHERE p_partkey <= 5) AND a.name <> z.name")
def callers_by_name(s, d):
    n = b.nodes(s, d).select("id", "name")
    names = b.table(s, d, "part").where("p_partkey <= 5").select(F.col("p_name").alias("callee"))
    targets = n.toDF("target", "callee").join(F.broadcast(names), "callee", "left_semi")
    j = b.edges(s, d, ("calls",)).select("source", "target").join(targets, "target").join(n.toDF("source", "caller"), "source")
    return j.where("caller <> callee").select("caller", "callee").distinct()


@query("join_upstream_two_hops", f"SELECT DISTINCT p.source AS grandparent, p.target AS parent, c.target AS child FROM {E} p JOIN {E} c ON p.target = c.source WHERE p.kind = 'contains' AND c.kind = 'calls' AND c.target IN ('function:1','function:2','function:3')")
def upstream(s, d):
    calls = b.edges(s, d, ("calls",)).where(F.col("target").isin("function:1", "function:2", "function:3")).select(F.col("source").alias("parent"), F.col("target").alias("child")).distinct()
    own = b.edges(s, d, ("contains",)).select(F.col("source").alias("grandparent"), F.col("target").alias("parent"))
    return own.join(calls, "parent").select("grandparent", "parent", "child").distinct()


@query("join_importers", f"SELECT DISTINCT a.file_path AS importer, z.file_path AS imported FROM {E} e JOIN {N} a ON a.id = e.source JOIN {N} z ON z.id = e.target WHERE e.kind IN ('references','calls') AND a.file_path <> z.file_path AND z.kind = 'struct'")
def importers(s, d):
    n = b.nodes(s, d)
    z = n.where("kind = 'struct'").select(F.col("id").alias("target"), F.col("file_path").alias("imported"))
    j = b.edges(s, d, ("references",)).join(z, "target").join(n.select(F.col("id").alias("source"), F.col("file_path").alias("importer")), "source")
    return j.where("importer <> imported").select("importer", "imported").distinct()


@query("join_extends_both_ways", "SELECT source AS a, target AS z, 'extends' AS side FROM v_nation_dep UNION ALL SELECT target, source, 'extended_by' FROM v_nation_dep")
def extends_both(s, d):
    e = b.nation_dep(s, d)
    up = e.select(F.col("source").alias("a"), F.col("target").alias("z"), F.lit("extends").alias("side"))
    return up.unionByName(e.select(F.col("target").alias("a"), F.col("source").alias("z"), F.lit("extended_by").alias("side")))


@query("join_methods", f"SELECT e.source AS owner, z.kind, count(*)::BIGINT AS members FROM {E} e JOIN {N} z ON z.id = e.target WHERE e.kind = 'contains' AND z.kind IN ('method','class','struct') GROUP BY ALL")
def methods(s, d):
    z = b.nodes(s, d).where(F.col("kind").isin("method", "class", "struct")).select(F.col("id").alias("target"), F.col("kind").alias("member_kind"))
    j = b.edges(s, d, ("contains",)).select("source", "target").join(z, "target")
    return j.groupBy(F.col("source").alias("owner"), F.col("member_kind").alias("kind")).agg(F.count(F.lit(1)).alias("members"))


@query("join_edge_validation", f"SELECT kind, count(*)::BIGINT AS n FROM {E} WHERE source IN (SELECT id FROM {N} WHERE is_exported) AND target IN (SELECT id FROM {N} WHERE is_exported) GROUP BY kind")
def edge_validation(s, d):
    ids = b.nodes(s, d).where("is_exported").select("id")
    return induced(b.edges(s, d), ids).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("join_cascade_delete", f"SELECT kind, count(*)::BIGINT AS n FROM {E} WHERE source NOT IN (SELECT id FROM {N} WHERE file_path LIKE 'parts/brand1%') AND target NOT IN (SELECT id FROM {N} WHERE file_path LIKE 'parts/brand1%') GROUP BY kind")
def cascade_delete(s, d):
    gone = b.nodes(s, d).where(F.startswith("file_path", F.lit("parts/brand1"))).select("id")
    e = b.edges(s, d).join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti")
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("join_dead_code", f"SELECT id, kind, name FROM {N} WHERE NOT is_exported AND id NOT IN (SELECT target FROM {E} WHERE kind <> 'contains')")
def dead_code(s, d):
    used = b.edges(s, d, ("calls", "references")).select(F.col("target").alias("id"))
    return b.nodes(s, d).where("NOT is_exported").select("id", "kind", "name").join(used, "id", "left_anti")


@query("join_feedback_asof", """
SELECT f.event_id, f.repo, (SELECT max(struct_pack(ts := t.ts, id := t.event_id)).id FROM v_traces t WHERE t.repo = f.repo AND t.event_type = 'view' AND t.ts <= f.ts) AS trace_id
FROM v_traces f WHERE f.event_type = 'purchase'""")
def feedback_asof(s, d):
    """The last view at or before each purchase in its repository: one sorted pass for each repository and day, without a range join."""
    t = b.traces(s, d).where(F.col("event_type").isin("view", "purchase")).select("event_id", "repo", "ts", "event_type")
    view = F.when(F.col("event_type") == "view", F.struct("ts", F.col("event_id").alias("id")))
    # a whole repository's history doesn't go to one task: days are scanned apart, and carry the last view of earlier days over
    day = F.to_date("ts")
    last = t.withColumn("day", day).groupBy("repo", "day").agg(F.max(view).alias("own"))
    carry = last.withColumn("before", F.max("own").over(Window.partitionBy("repo").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("repo", "day", "before")
    within = F.max(view).over(Window.partitionBy("repo", "day").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    j = t.withColumn("day", day).withColumn("hit", within).where("event_type = 'purchase'").join(carry, ["repo", "day"])
    return j.select("event_id", "repo", F.coalesce("hit.id", "before.id").alias("trace_id"))


@query("join_memory_files", "SELECT t.event_id, m.key, m.file FROM v_traces t JOIN v_memories m ON m.vec_id IN (t.k, t.k * 2 + 1) WHERE t.event_type = 'signup'")
def memory_files(s, d):
    keys = F.split(F.concat(F.lit("mem:"), F.col("k").cast("string"), F.lit(",mem:"), (F.col("k") * 2 + 1).cast("string")), ",")
    t = b.traces(s, d).where("event_type = 'signup'").select("event_id", F.explode(F.array_distinct(keys)).alias("key"))
    return t.join(b.memories(s, d).select("key", "file"), "key").select("event_id", "key", "file")


@query("join_path_overlap", f"SELECT a.file_path AS a, z.file_path AS z FROM (SELECT DISTINCT file_path FROM {N} WHERE kind = 'namespace') a JOIN (SELECT DISTINCT file_path FROM {N} WHERE kind = 'struct') z ON starts_with(z.file_path, regexp_replace(a.file_path, 'ns\\.go$', ''))")
def path_overlap(s, d):
    """Containment of paths as an equi-join on the directories that a path lies in."""
    n = b.nodes(s, d)
    a = n.where("kind = 'namespace'").select("file_path").distinct().select(F.col("file_path").alias("a"), text.dir_name(F.col("file_path")).alias("dir"))
    z = n.where("kind = 'struct'").select(F.col("file_path").alias("z")).distinct()
    parts = F.split("z", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return z.withColumn("dir", F.explode(up)).join(a, "dir").select("a", "z")


@query("join_decision_conflicts", "SELECT scope, least(a.decision_type, z.decision_type) AS t1, greatest(a.decision_type, z.decision_type) AS t2, count(*)::BIGINT AS n FROM v_decisions a JOIN v_decisions z USING (scope) WHERE a.doc_id < z.doc_id AND a.decision_type <> z.decision_type GROUP BY ALL")
def decision_conflicts(s, d):
    """Conflicting pairs per scope, from counts by type: no pair is made."""
    c = b.decisions(s, d).groupBy("scope", "decision_type").agg(F.count(F.lit(1)).alias("n"))
    j = c.toDF("scope", "t1", "n1").join(c.toDF("scope", "t2", "n2"), "scope").where("t1 < t2")
    return j.select("scope", "t1", "t2", (F.col("n1") * F.col("n2")).alias("n"))


@query("join_decision_lineage", "SELECT a.name, a.status, z.name AS superseded, z.status AS old_status FROM v_decisions a LEFT JOIN v_decisions z ON a.supersedes = z.name WHERE a.supersedes IS NOT NULL")
def decision_lineage(s, d):
    v = b.decisions(s, d).select("name", "status", "supersedes")
    old = v.select(F.col("name").alias("superseded"), F.col("status").alias("old_status"))
    return v.where("supersedes is not null").join(old, F.col("supersedes") == F.col("superseded"), "left").select("name", "status", "superseded", "old_status")


@query("join_flow_overlay", "SELECT m.key, m.repo, coalesce(o.n, 0)::BIGINT AS n FROM v_memories m LEFT JOIN (SELECT repo, k, count(*) AS n FROM v_traces GROUP BY ALL) o ON o.repo = m.repo AND o.k = m.vec_id WHERE m.mem_type = 'flow'")
def flow_overlay(s, d):
    o = b.traces(s, d).groupBy("repo", F.col("k").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"))
    return b.memories(s, d).where("mem_type = 'flow'").select("key", "repo", "vec_id").join(o, ["repo", "vec_id"], "left").select("key", "repo", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("join_flow_topics", "SELECT m.key, array_to_string(list_sort(list(DISTINCT t.intent)), ',') AS topics FROM v_traces t JOIN v_memories m ON m.vec_id = t.k WHERE m.mem_type = 'flow' GROUP BY m.key")
def flow_topics(s, d):
    t = b.traces(s, d).select(F.col("k").alias("vec_id"), "intent").distinct()
    return b.memories(s, d).where("mem_type = 'flow'").select("key", "vec_id").join(t, "vec_id").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("intent")), ",").alias("topics"))


@query("join_repeat_detection", "SELECT q.event_id, max(p.event_id) AS earlier FROM events q JOIN events p ON p.user_id = q.user_id AND p.event_type = q.event_type AND p.ts < q.ts AND p.ts >= q.ts - INTERVAL 15 MINUTE GROUP BY q.event_id")
def repeat_detection(s, d):
    """Queries of the last 15 minutes, met by equality on user, type and quarter hour."""
    e = b.table(s, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    slot = F.floor(F.col("us") / 900_000_000)
    old = e.select("user_id", "event_type", F.col("us").alias("old_us"), F.col("event_id").alias("earlier"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    j = e.withColumn("slot", slot).join(old, ["user_id", "event_type", "slot"]).where("old_us < us AND old_us >= us - 900000000")
    return j.groupBy("event_id").agg(F.max("earlier").alias("earlier"))


@query("join_service_patterns", f"SELECT r_name, kind, count(*)::BIGINT AS files FROM region JOIN (SELECT * FROM {N} WHERE kind IN ('class','struct','namespace')) n ON starts_with(n.file_path, 'world/' || r_regionkey || '/') GROUP BY ALL")
def service_patterns(s, d):
    r = b.table(s, d, "region").select("r_name", F.col("r_regionkey").cast("string").alias("region"))
    n = b.nodes(s, d).where(F.col("kind").isin("class", "struct", "namespace")).select("kind", F.split_part("file_path", F.lit("/"), F.lit(2)).alias("region"))
    return n.join(F.broadcast(r), "region").groupBy("r_name", "kind").agg(F.count(F.lit(1)).alias("files"))


@query("join_set_containment", """
WITH have AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), need AS (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_linenumber <= 4)
SELECT l_orderkey AS owner FROM have WHERE l_linenumber IN (SELECT l_linenumber FROM need) GROUP BY l_orderkey HAVING count(*) = (SELECT count(*) FROM need)""")
def set_containment(s, d):
    """Relational division: owners whose members include all that are asked for."""
    have = b.table(s, d, "lineitem").select(F.col("l_orderkey").alias("owner"), "l_linenumber").distinct()
    need = have.where("l_linenumber <= 4").select("l_linenumber").distinct()
    n = F.broadcast(need.agg(F.count(F.lit(1)).alias("n")))
    return have.join(F.broadcast(need), "l_linenumber", "left_semi").groupBy("owner").agg(F.count(F.lit(1)).alias("found")).crossJoin(n).where("found = n").select("owner")


_TAGS = "(SELECT DISTINCT lower(p_type) AS tag FROM part UNION SELECT DISTINCT split_part(lower(p_name), ' ', 2) FROM part UNION SELECT lower(r_name) FROM region)"
_REPOS = "(SELECT DISTINCT lower(replace(p_name, ' ', '-')) AS repo FROM part UNION SELECT lower(r_name) FROM region)"


@query("join_tag_repo_score", f"""
SELECT tag, repo, CASE WHEN tag = repo THEN 1.0::DOUBLE WHEN starts_with(repo, tag) THEN 0.9::DOUBLE WHEN ends_with(repo, tag) THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS score
FROM {_TAGS} a JOIN {_REPOS} z ON contains(repo, tag) WHERE length(tag) >= 3""")
def tag_repo_score(s, d):
    """A tag against the names of repositories: equal, at the start, at the end, or within. Both sides are distinct names; tags are joined by
    their parts between hyphens first, and by containment only for those that are no whole part."""
    p, r = b.table(s, d, "part"), b.table(s, d, "region").select(F.lower("r_name").alias("name"))
    tags = p.select(F.lower("p_type").alias("name")).unionByName(p.select(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(2)).alias("name"))).unionByName(r).distinct().where("length(name) >= 3").select(F.col("name").alias("tag"))
    repos = p.select(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name")).unionByName(r).distinct().select(F.col("name").alias("repo"))
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(F.col(c), i, F.lit(3))))
    # a tag within a name shares its first three letters with one of the name's triplets
    within = repos.where("length(repo) >= 3").withColumn("gram", F.explode(grams("repo"))).join(tags.withColumn("gram", F.substring("tag", 1, 3)), "gram").where(F.contains("repo", F.col("tag")))
    points = F.when(F.col("tag") == F.col("repo"), 1.0).when(F.startswith("repo", F.col("tag")), 0.9).when(F.endswith("repo", F.col("tag")), 0.8).otherwise(0.6)
    return within.select("tag", "repo", points.alias("score")).distinct()


@query("topk_link_order", f"""
SELECT tag, repo, place::INTEGER AS place FROM (SELECT tag, repo, row_number() OVER (PARTITION BY tag ORDER BY score DESC, length(repo) DESC, repo) AS place FROM (
SELECT tag, repo, CASE WHEN tag = repo THEN 1.0::DOUBLE WHEN starts_with(repo, tag) THEN 0.9::DOUBLE WHEN ends_with(repo, tag) THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS score
FROM {_TAGS} a JOIN {_REPOS} z ON contains(repo, tag) WHERE length(tag) >= 3)) WHERE place <= 5""")
def link_order(s, d):
    """Links of a tag by confidence, then longer names, then name."""
    return top_per(tag_repo_score(s, d), ["tag"], [F.desc("score"), F.desc(F.length("repo")), F.col("repo")], 5).select("tag", "repo", F.col("rank").alias("place"))


@query("set_append_distinct", "SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS names FROM (SELECT doc_id, [lang, source] || ['src/' || (doc_id % 50), source, lang, 'lib/' || (doc_id % 30)] AS w FROM documents)")
def append_distinct(s, d):
    """Two lists after each other, each name at its first place only."""
    v = b.docs(s, d).select("doc_id", "lang", "source")
    more = F.array(F.concat(F.lit("src/"), (F.col("doc_id") % 50).cast("string")), "source", "lang", F.concat(F.lit("lib/"), (F.col("doc_id") % 30).cast("string")))
    return v.select("doc_id", F.array_distinct(F.concat(F.array("lang", "source"), more)).alias("names"))


# ---- aggregates ----------------------------------------------------------------------------------------------------


@query("agg_stats", f"SELECT 'node' AS what, kind AS value, count(*)::BIGINT AS n FROM {N} GROUP BY kind UNION ALL SELECT 'language', language, count(DISTINCT file_path) FROM {N} GROUP BY language UNION ALL SELECT 'edge', kind, count(*) FROM {E} GROUP BY kind")
def stats(s, d):
    n = b.nodes(s, d)
    kinds = n.groupBy(F.lit("node").alias("what"), F.col("kind").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    langs = n.select("language", "file_path").distinct().groupBy(F.lit("language").alias("what"), F.col("language").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(langs).unionByName(b.edges(s, d).groupBy(F.lit("edge").alias("what"), F.col("kind").alias("value")).agg(F.count(F.lit(1)).alias("n")))


@query("agg_node_edge_count", f"SELECT (SELECT count(*) FROM {N})::BIGINT AS nodes, (SELECT count(*) FROM {E})::BIGINT AS edges")
def node_edge_count(s, d):
    return b.nodes(s, d).agg(F.count(F.lit(1)).alias("nodes")).crossJoin(b.edges(s, d).agg(F.count(F.lit(1)).alias("edges")))


@query("agg_last_indexed", "SELECT max(o_orderdate)::DATE AS last_indexed, count(*)::BIGINT AS n FROM orders")
def last_indexed(s, d):
    return b.table(s, d, "orders").agg(F.max("o_orderdate").cast("date").alias("last_indexed"), F.count(F.lit(1)).alias("n"))


@query("agg_dominant_file", f"WITH c AS (SELECT file_path, count(*) AS n FROM {N} WHERE kind = 'function' GROUP BY file_path), t AS (SELECT *, row_number() OVER (ORDER BY n DESC, file_path) AS r FROM (SELECT * FROM c WHERE NOT regexp_matches(file_path, '{score.TEST_PATH}'))) SELECT file_path, n::BIGINT AS n, (SELECT n FROM t WHERE r = 2)::BIGINT AS runner_up FROM t WHERE r = 1")
def dominant_file(s, d):
    c = b.nodes(s, d).where("kind = 'function'").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(~score.is_test_path(F.col("file_path")))
    top = c.orderBy(F.desc("n"), "file_path").limit(2)
    return top.withColumn("runner_up", F.lead("n").over(Window.orderBy(F.desc("n"), "file_path"))).orderBy(F.desc("n"), "file_path").limit(1)


@query("agg_top_route_file", "WITH c AS (SELECT page_id, count(*) AS n FROM v_routes GROUP BY page_id), t AS (SELECT *, sum(n) OVER () AS total FROM (SELECT * FROM c ORDER BY n DESC, page_id LIMIT 20)) SELECT page_id, n::BIGINT AS n, total::BIGINT AS total FROM t WHERE total >= 3 AND n >= 3 ORDER BY n DESC, page_id LIMIT 5")
def top_route_file(s, d):
    c = b.routes(s, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "page_id").limit(20)
    return c.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1)))).where("total >= 3 AND n >= 3").orderBy(F.desc("n"), "page_id").limit(5)


@query("agg_node_metrics", f"SELECT id, (SELECT count(*) FROM {E} WHERE target = id AND kind = 'calls')::BIGINT AS callers, o.n_out::BIGINT AS n_out, o.n_calls::BIGINT AS n_calls, o.n_children::BIGINT AS n_children FROM {N} JOIN (SELECT source, count(*) AS n_out, count(*) FILTER (kind = 'calls') AS n_calls, count(*) FILTER (kind = 'contains') AS n_children FROM {E} GROUP BY source) o ON o.source = id")
def node_metrics(s, d):
    e = b.edges(s, d)
    sides = e.select(F.col("source").alias("id"), "kind", F.lit(1).alias("out")).unionByName(e.select(F.col("target").alias("id"), "kind", F.lit(0).alias("out")))
    when = lambda c: F.count_if(c)
    m = sides.groupBy("id").agg(
        when((F.col("out") == 0) & (F.col("kind") == "calls")).alias("callers"), when(F.col("out") == 1).alias("n_out"),
        when((F.col("out") == 1) & (F.col("kind") == "calls")).alias("n_calls"), when((F.col("out") == 1) & (F.col("kind") == "contains")).alias("n_children"),
    )
    return m.where("n_out > 0").join(b.nodes(s, d).select("id"), "id", "left_semi")


@query("agg_module_structure", f"SELECT regexp_replace(file_path, '/?[^/]*$', '') AS dir, array_to_string(list_sort(list(DISTINCT file_path)), ',') AS files FROM {N} WHERE kind <> 'method' GROUP BY 1")
def module_structure(s, d):
    f = b.nodes(s, d).where("kind <> 'method'").select("file_path").distinct()
    return f.groupBy(text.dir_name(F.col("file_path")).alias("dir")).agg(F.array_join(F.sort_array(F.collect_list("file_path")), ",").alias("files"))


@query("agg_name_hits", f"SELECT t.term, count(*)::BIGINT AS n FROM {N} JOIN (VALUES ('red'), ('customer'), ('supplier'), ('a')) t(term) ON contains(lower(name), t.term) GROUP BY t.term")
def name_hits(s, d):
    terms = F.array(*[F.lit(t) for t in ("red", "customer", "supplier", "a")])
    hit = F.filter(terms, lambda t: F.contains(F.lower("name"), t))
    return b.nodes(s, d).select(F.explode(hit).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("agg_auto_anchor", f"WITH words AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, string_split_regex(lower(text), '[^a-z0-9]+') AS w FROM benchmark)), df AS (SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents) WHERE word <> '' GROUP BY word) SELECT item_id, arg_min(words.word, n * 1000000 + pos) AS anchor, min(n)::BIGINT AS n FROM words JOIN df ON df.word = words.word WHERE words.word <> '' GROUP BY item_id")
def auto_anchor(s, d):
    words = b.table(s, d, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("pos", "word")).where("word <> ''")
    # distinct words within each document are found before anything is shuffled
    df = b.docs(s, d).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    j = words.join(df, "word").groupBy("item_id").agg(F.min(F.struct("n", "pos", "word")).alias("m"))
    return j.select("item_id", F.col("m.word").alias("anchor"), F.col("m.n").alias("n"))


@query("agg_file_roles", f"SELECT z.file_path, min(CASE e.kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END)::INTEGER AS best_role, min(abs(e.line))::INTEGER AS depth FROM {E} e JOIN {N} z ON z.id = e.target GROUP BY z.file_path")
def file_roles(s, d):
    role = F.when(F.col("kind") == "contains", 0).when(F.col("kind") == "calls", 1).otherwise(2)
    per = b.edges(s, d).groupBy(F.col("target").alias("id")).agg(F.min(role).alias("r"), F.min(F.abs("line")).alias("l"))
    return per.join(b.nodes(s, d).select("id", "file_path"), "id").groupBy("file_path").agg(F.min("r").alias("best_role"), F.min("l").alias("depth"))


@query("agg_token_estimate", "SELECT source, (sum(strlen(text)) // 4 + 100)::BIGINT AS tokens FROM documents GROUP BY source")
def token_estimate(s, d):
    return b.docs(s, d).groupBy("source").agg(F.expr("sum(octet_length(text)) div 4 + 100").alias("tokens"))


@query("agg_keyword_affinity", "SELECT kw AS keyword, lang, count(*)::BIGINT AS weight FROM (SELECT DISTINCT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS kw FROM documents) GROUP BY ALL HAVING count(*) >= 20")
def keyword_affinity(s, d):
    k = b.docs(s, d).select("lang", F.explode(text.keywords(F.col("text"))).alias("keyword"))
    return k.groupBy("keyword", "lang").agg(F.count(F.lit(1)).alias("weight")).where("weight >= 20")


@query("agg_pattern_stats", "SELECT repo, intent, count(*)::BIGINT AS fired, floor(sum(CASE WHEN raw >= 0.5 THEN 0.5 ELSE 0 END)::DOUBLE)::BIGINT AS success FROM v_rewards GROUP BY GROUPING SETS ((repo, intent), (intent))")
def pattern_stats(s, d):
    r = b.rewards(s, d)
    credit = F.when(F.col("raw") >= 0.5, 0.5).otherwise(0.0)
    return r.groupingSets([[F.col("repo"), F.col("intent")], [F.col("intent")]], F.col("repo"), F.col("intent")).agg(F.count(F.lit(1)).alias("fired"), F.floor(F.sum(credit)).alias("success"))


@query("agg_distinct_repos", "SELECT DISTINCT split_part(key, ':', 2)::BIGINT % 7 AS part, repo FROM v_memories")
def distinct_repos(s, d):
    return b.memories(s, d).select((F.split_part("key", F.lit(":"), F.lit(2)).cast("long") % 7).alias("part"), "repo").distinct()


@query("agg_histogram", "SELECT CASE WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 WHEN value <= 500 THEN 500 ELSE -1 END::INTEGER AS le, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def histogram(s, d):
    le = F.when(F.col("value") <= 10, 10).when(F.col("value") <= 50, 50).when(F.col("value") <= 100, 100).when(F.col("value") <= 500, 500).otherwise(-1)
    return b.table(s, d, "events").groupBy(le.alias("le"), "event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- windows, top-k, sets ------------------------------------------------------------------------------------------


@query("window_first_edge", f"SELECT source, target, line FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY line) AS rn FROM {E} WHERE kind = 'calls' AND source <> target) WHERE rn = 1")
def first_edge(s, d):
    e = b.edges(s, d, ("calls",)).where("source <> target")
    return e.groupBy("source", "target").agg(F.min("line").alias("line"))


@query("window_top_per_name", f"SELECT name, id, rank::INTEGER AS rank FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY is_exported DESC, start_line, id) AS rank FROM {N} WHERE kind = 'function') WHERE rank <= 2")
def top_per_name(s, d):
    n = b.nodes(s, d).where("kind = 'function'").select("name", "id", "is_exported", "start_line")
    return top_per(n, ["name"], [F.desc("is_exported"), F.col("start_line"), F.col("id")], 2).select("name", "id", "rank")


@query("window_snippet_per_file", f"SELECT file_path, id FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS rn FROM {N}) WHERE rn = 1")
def snippet_per_file(s, d):
    return first_by(b.nodes(s, d).select("file_path", "id", "start_line"), ["file_path"], [F.col("start_line"), F.col("id")]).select("file_path", "id")


@query("window_per_file_cap", f"SELECT file_path, id FROM (SELECT file_path, id, row_number() OVER (PARTITION BY file_path ORDER BY is_exported DESC, id) AS rn FROM {N} WHERE kind IN ('function','class')) WHERE rn <= 5")
def per_file_cap(s, d):
    n = b.nodes(s, d).where(F.col("kind").isin("function", "class")).select("file_path", "id", "is_exported")
    return top_per(n, ["file_path"], [F.desc("is_exported"), F.col("id")], 5).select("file_path", "id")


@query("window_newest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def newest_per_key(s, d):
    m = b.table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return m.select("user_id", "m.event_id", "m.event_type")


@query("topk_merge", f"SELECT id, kind, name, start_line FROM {N} ORDER BY start_line DESC, kind, name, id LIMIT 30")
def topk_merge(s, d):
    return b.nodes(s, d).select("id", "kind", "name", "start_line").orderBy(F.desc("start_line"), "kind", "name", "id").limit(30)


@query("topk_offset", f"SELECT id, start_line FROM {N} WHERE kind = 'class' ORDER BY start_line DESC, id LIMIT 100 OFFSET 100")
def topk_offset(s, d):
    return b.nodes(s, d).where("kind = 'class'").select("id", "start_line").orderBy(F.desc("start_line"), "id").offset(100).limit(100)


@query("topk_stable_partition", f"SELECT id, row_number() OVER (ORDER BY NOT contains(file_path, '/2/'), start_line, id) AS place FROM {N}")
def stable_partition(s, d):
    n = b.nodes(s, d).select("id", "start_line", (~F.contains("file_path", F.lit("/2/"))).alias("later"))
    return ordered.numbered(n, ["later", "start_line", "id"], "place").select("id", "place")


@query("topk_section_trims", "SELECT repo, least(n, 5)::INTEGER AS kept, greatest(n - 5, 0)::INTEGER AS dropped FROM (SELECT repo, count(*) AS n FROM v_memories GROUP BY repo)")
def section_trims(s, d):
    c = b.memories(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return c.select("repo", F.least("n", F.lit(5)).cast("int").alias("kept"), F.greatest(F.col("n") - 5, F.lit(0)).cast("int").alias("dropped"))


@query("set_union_max_score", f"SELECT id, max(score)::DOUBLE AS score FROM (SELECT id, 2.0 AS score FROM {N} WHERE is_exported UNION ALL SELECT id, 1.0 FROM {N} WHERE kind = 'class') GROUP BY id")
def union_max(s, d):
    n = b.nodes(s, d)
    u = n.where("is_exported").select("id", F.lit(2.0).alias("score")).unionByName(n.where("kind = 'class'").select("id", F.lit(1.0).alias("score")))
    return u.groupBy("id").agg(F.max("score").alias("score"))


@query("set_append_unseen", f"SELECT id, 1 AS pass FROM {N} WHERE kind = 'struct' UNION ALL SELECT id, 2 FROM {N} WHERE is_exported AND kind IN ('struct','class') AND id NOT IN (SELECT id FROM {N} WHERE kind = 'struct')")
def append_unseen(s, d):
    n = b.nodes(s, d)
    a = n.where("kind = 'struct'").select("id")
    z = n.where(F.col("is_exported") & F.col("kind").isin("struct", "class")).select("id").join(a, "id", "left_anti")
    return a.withColumn("pass", F.lit(1)).unionByName(z.withColumn("pass", F.lit(2)))


@query("set_intersection", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 1000")
def intersection(s, d):
    c = b.table(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    return c.intersect(b.table(s, d, "supplier").where("s_acctbal > 1000").select("s_nationkey"))


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def difference(s, d):
    return b.table(s, d, "customer").select("c_custkey").exceptAll(b.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()).distinct()


@query("set_merge_types", "SELECT key, mem_type, list_position(['file','func','flow','decision'], mem_type)::INTEGER AS ord FROM v_memories")
def merge_types(s, d):
    m = b.memories(s, d).select("key", "mem_type")
    return m.withColumn("ord", F.array_position(F.array(*[F.lit(t) for t in b.MEM_TYPES]), F.col("mem_type")).cast("int"))

"""Answers put together from several operators: repositories and what links them, a node's surroundings, and capped sections."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import score
from glyphmill.operators import graph
from glyphmill.operators.storage import materialised, shared_path
from glyphmill.plans import bindings as b
from glyphmill.plans.analytics import _COS, one, probes, with_distance
from glyphmill.plans.registry import query
from glyphmill.plans.relational import _REPOS, _TAGS, tag_repo_score

#: Repositories searched at once, hits of each, hits in all; results of a linked repository; letters of a tag that tells little.
MOST_REPOS, PER_REPO, IN_ALL, PER_LINK, SHORT_TAG = 8, 10, 30, 5, 4
#: Chance to explore a pattern, and fires from which a pattern is proven.
EPSILON, PROVEN = 0.10, 3

# ---- repositories --------------------------------------------------------------------------------------------------

_REPO = "split_part(file_path, '/', 1) || '-' || split_part(file_path, '/', 2)"


def repo_of(path: str) -> Column:
    """The first two folders name a repository."""
    return F.concat_ws("-", F.split_part(path, F.lit("/"), F.lit(1)), F.split_part(path, F.lit("/"), F.lit(2)))


def registry(s, d) -> DataFrame:
    """(name, root, symbols, files): the repositories as their registry lists them, a file of JSON lines."""
    path = shared_path(s, "registry")
    n = b.nodes(s, d).select("file_path", repo_of("file_path").alias("name"))
    per_file = n.groupBy("name", "file_path").agg(F.count(F.lit(1)).alias("symbols"))
    listed = per_file.groupBy("name").agg(F.sum("symbols").alias("symbols"), F.count(F.lit(1)).alias("files"))
    listed.select("name", F.replace("name", F.lit("-"), F.lit("/")).alias("root"), "symbols", "files").write.json(path)
    return s.read.schema("name string, root string, symbols long, files long").json(path)


@query("scan_repo_registry", f"SELECT {_REPO} AS name, split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) AS root, count(*)::BIGINT AS symbols, count(DISTINCT file_path)::BIGINT AS files FROM v_nodes GROUP BY 1, 2")
def repo_registry(s, d):
    return registry(s, d)


def surface(term: Column) -> Column:
    """The weight of the best surface that holds a term."""
    holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), term)
    return F.when(holds("name"), 1.0).when(holds("file_path"), 0.7).when(holds("signature"), 0.4)


_SURFACE = "CASE WHEN contains(lower(name), t) THEN 1.0 WHEN contains(lower(file_path), t) THEN 0.7 WHEN contains(lower(coalesce(signature, '')), t) THEN 0.4 END::DOUBLE"


@query("search_across_repos", f"""WITH r AS (SELECT DISTINCT {_REPO} AS repo FROM v_nodes WHERE starts_with(file_path, 'parts/') ORDER BY 1 LIMIT {MOST_REPOS}),
h AS (SELECT repo, id, name, t, {_SURFACE} AS w FROM (SELECT *, {_REPO} AS repo FROM v_nodes) JOIN r USING (repo), (VALUES ('red'), ('widget')) x(t)), k AS (SELECT * FROM h WHERE w IS NOT NULL),
f AS (SELECT repo, t, least(8.0::DOUBLE, ln(1 + 1000.0::DOUBLE / (count(*) + 1))) AS idf FROM k GROUP BY repo, t), p AS (SELECT repo, id, name, round(sum(idf * w), 6) AS score FROM k JOIN f USING (repo, t) GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, id) AS rn FROM p), o AS (SELECT *, count(*) OVER (PARTITION BY repo)::BIGINT AS per_repo FROM c WHERE rn <= {PER_REPO})
SELECT repo, id, name, score, per_repo FROM o ORDER BY score DESC, repo, id LIMIT {IN_ALL}""")
def across_repos(s, d):
    """One question to several repositories, each searched on its own: its ten best, how many it gave, and the best of all."""
    repos = materialised(registry(s, d).where(F.startswith("name", F.lit("parts-"))).select(F.col("name").alias("repo")).orderBy("repo").limit(MOST_REPOS), "repos")
    n = b.nodes(s, d).withColumn("repo", repo_of("file_path")).join(F.broadcast(repos), "repo")
    terms = F.array(F.lit("red"), F.lit("widget"))
    hits = n.select("repo", "id", "name", F.explode(F.transform(terms, lambda t: F.struct(t.alias("t"), surface(t).alias("w")))).alias("h")).select("repo", "id", "name", "h.*").where("w is not null")
    idf = hits.groupBy("repo", "t").agg(score.term_idf(F.count(F.lit(1))).alias("idf"))
    found = hits.join(F.broadcast(idf), ["repo", "t"]).groupBy("repo", "id", "name").agg(F.round(F.sum(F.col("idf") * F.col("w")), 6).alias("score"))
    best = materialised(graph.top_per(found, ["repo"], [F.desc("score"), F.col("id")], PER_REPO).drop("rank"), "across")
    counts = best.groupBy("repo").agg(F.count(F.lit(1)).alias("per_repo"))
    return best.join(F.broadcast(counts), "repo").orderBy(F.desc("score"), "repo", "id").limit(IN_ALL).select("repo", "id", "name", "score", "per_repo")


@query("search_linked_routes", f"""WITH l AS (SELECT DISTINCT tag, repo FROM {_TAGS} a JOIN {_REPOS} z ON contains(repo, tag) WHERE length(tag) >= 3),
h AS (SELECT tag, repo, id, list_sum(list_transform(CASE WHEN length(tag) < {SHORT_TAG} THEN [tag, 'route', 'handler'] ELSE [tag] END, lambda t: coalesce({_SURFACE}, 0))) AS points
FROM l JOIN (SELECT *, replace(lower(name), ' ', '-') AS repo FROM v_nodes WHERE kind = 'function') USING (repo))
SELECT tag, repo, id, points, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY tag, repo ORDER BY points DESC, id) AS rank FROM h WHERE points > 0) WHERE rank <= {PER_LINK}""")
def linked_routes(s, d):
    """What a tag may lead to in the repositories that it links: each is searched for the tag, and for routes and handlers where the tag tells little."""
    links = tag_repo_score(s, d).select("tag", "repo")
    n = b.nodes(s, d).where("kind = 'function'").select("id", "name", "file_path", "signature", F.lower(F.replace("name", F.lit(" "), F.lit("-"))).alias("repo"))
    more = F.when(F.length("tag") < SHORT_TAG, F.array("tag", F.lit("route"), F.lit("handler"))).otherwise(F.array("tag"))
    points = F.aggregate(F.transform(more, lambda t: F.coalesce(surface(t), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    hits = n.join(links, "repo").select("tag", "repo", "id", points.alias("points")).where("points > 0")
    return graph.top_per(hits, ["tag", "repo"], [F.desc("points"), F.col("id")], PER_LINK)


# ---- exploration ---------------------------------------------------------------------------------------------------

_DRAW = "('0x' || md5(repo || '/' || intent || '/{use}')[1:8])::BIGINT / 4294967296.0::DOUBLE"


def draw(use: str) -> Column:
    """A number from 0 to 1 that a rerun draws again."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", "repo", "intent", F.lit(use))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


@query("topk_explored_slot", f"""WITH p AS (SELECT repo, intent, k, count(*) AS fired, (count(*) FILTER (raw >= 0.5) + 1)::DOUBLE / (count(*) + 2) AS points FROM v_rewards GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY repo, intent ORDER BY points DESC, k) AS slot, count(*) OVER (PARTITION BY repo, intent) AS n FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY repo, intent ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY repo, intent) AS m FROM r WHERE fired < {PROVEN}),
c AS (SELECT repo, intent, k AS chosen, n FROM u WHERE {_DRAW.format(use="explore")} < {EPSILON}::DOUBLE AND i = floor({_DRAW.format(use="pick")} * m) AND slot > least(5, n))
SELECT repo, intent, slot::INTEGER AS slot, CASE WHEN slot = 5 AND chosen IS NOT NULL THEN chosen ELSE k END AS pattern, slot = 5 AND chosen IS NOT NULL AS explored FROM r LEFT JOIN c USING (repo, intent) WHERE slot <= 5""")
def explored_slot(s, d):
    """Each bucket's five best patterns; now and then an unproven one takes the last slot, unless it is among them anyway. A bucket of
    five patterns or fewer serves them all, so that none can be outside."""
    p = b.rewards(s, d).groupBy("repo", "intent", "k").agg(F.count(F.lit(1)).alias("fired"), ((F.count_if(F.col("raw") >= 0.5) + 1) / (F.count(F.lit(1)) + 2)).alias("points"))
    ranked = materialised(graph.top_per(p, ["repo", "intent"], [F.desc("points"), F.col("k")], 2**31 - 1, "slot"), "patterns")
    unproven = ranked.where(F.col("fired") < PROVEN)
    sizes = unproven.groupBy("repo", "intent").agg(F.count(F.lit(1)).alias("m"))
    asked = sizes.where(draw("explore") < EPSILON).select("repo", "intent", (F.floor(draw("pick") * F.col("m")) + 1).alias("i"))
    placed = graph.top_per(unproven, ["repo", "intent"], [F.col("k")], 2**31 - 1, "i").select("repo", "intent", "i", F.col("k").alias("chosen"), F.col("slot").alias("own"))
    chosen = placed.join(asked, ["repo", "intent", "i"]).where("own > 5").select("repo", "intent", "chosen")
    explored = (F.col("slot") == 5) & F.col("chosen").isNotNull()
    top = ranked.where("slot <= 5").join(chosen, ["repo", "intent"], "left")
    return top.select("repo", "intent", "slot", F.when(explored, F.col("chosen")).otherwise(F.col("k")).alias("pattern"), explored.alias("explored"))


# ---- decisions -----------------------------------------------------------------------------------------------------


@query("join_decision_overlaps", """SELECT least(a.decision_type, z.decision_type) AS t1, greatest(a.decision_type, z.decision_type) AS t2, count(*)::BIGINT AS n FROM v_decisions a JOIN v_decisions z ON a.doc_id < z.doc_id
AND a.decision_type <> z.decision_type AND (a.scope = z.scope OR (length(a.scope) >= 3 AND contains(z.scope, a.scope)) OR (length(z.scope) >= 3 AND contains(a.scope, z.scope)) OR a.files[1] = z.files[1] OR a.files[2] = z.files[2]) GROUP BY ALL""")
def decision_overlaps(s, d):
    """Pairs of decisions of different types that may conflict, as one scope is or holds the other or as they share a file, counted by types.

    No pair is made: the pairs that share a key are products of counts, and those that share several keys are taken off again.
    """
    v = b.decisions(s, d).select("decision_type", "scope", F.col("files")[0].alias("src"), F.col("files")[1].alias("lib"))
    counts = materialised(v.groupBy("decision_type", "scope", "src", "lib").agg(F.count(F.lit(1)).alias("n")), "decisions")
    scopes = counts.select("scope").where("scope is not null").distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("scope") - 2), lambda i: F.substring(F.col("scope"), i, F.lit(3))))
    holds = scopes.where("length(scope) >= 3").select("scope", F.explode(grams).alias("gram")).join(scopes.where("length(scope) >= 3").select(F.col("scope").alias("within"), F.substring("scope", 1, 3).alias("gram")), "gram")
    held = holds.where(F.contains("scope", F.col("within"))).select("scope", F.col("within").alias("other"))
    related = materialised(held.unionByName(held.select(F.col("other").alias("scope"), F.col("scope").alias("other"))).unionByName(scopes.select("scope", F.col("scope").alias("other"))).distinct(), "scopes")

    def shared(keys: tuple[str, ...]) -> DataFrame:
        mine = counts.groupBy("decision_type", *keys).agg(F.sum("n").alias("n"))
        a, z = mine.withColumnsRenamed({"decision_type": "t1", "n": "n1"}), mine.withColumnsRenamed({"decision_type": "t2", "n": "n2"})
        if "scope" in keys:
            a = a.join(related, "scope").drop("scope").withColumnRenamed("other", "scope")
        sign = 1 if len(keys) % 2 else -1
        return a.join(z, list(keys)).where("t1 < t2").groupBy("t1", "t2").agg((F.sum(F.col("n1") * F.col("n2")) * sign).alias("n"))

    parts = [shared(keys) for r in (1, 2, 3) for keys in combinations(("scope", "src", "lib"), r)]
    return reduce(DataFrame.unionByName, parts).groupBy("t1", "t2").agg(F.sum("n").alias("n")).where("n > 0")


# ---- a node's surroundings -----------------------------------------------------------------------------------------


def node_surroundings(edges: DataFrame, nodes: DataFrame, focal: str) -> DataFrame:
    """(part, kind, other): a node's ancestors, children, references in and out, types and the imports of its file.

    Types are what it is of or returns; the file is an ancestor of kind `file`. Ends that aren't nodes are left out.
    """
    held = edges.where("kind = 'contains'")
    up = graph.reach(graph.reverse(held), one(edges.sparkSession, focal, "string"), 25).where("depth > 0").select(F.lit("ancestor").alias("part"), F.lit("contains").alias("kind"), F.col("id").alias("other"))
    out, into = edges.where(F.col("source") == focal), edges.where(F.col("target") == focal)
    part = lambda df, name, end: df.select(F.lit(name).alias("part"), "kind", F.col(end).alias("other"))
    files = nodes.where("kind = 'file'").select("id").join(up.select(F.col("other").alias("id")), "id").select(F.col("id").alias("source"))
    parts = [
        up, part(out.where("kind = 'contains'"), "child", "target"), part(into.where("kind <> 'contains'"), "in", "source"), part(out.where("kind <> 'contains'"), "out", "target"),
        part(out.where("kind in ('type_of', 'returns')"), "type", "target").distinct(), part(edges.where("kind = 'imports'").join(files, "source"), "import", "target"),
    ]
    return reduce(DataFrame.unionByName, parts).join(nodes.select(F.col("id").alias("other")), "other", "left_semi").select("part", "kind", "other")


_AROUND = """SELECT '{f}' AS focal, 'child' AS part, kind, target AS other FROM v_edges WHERE source = '{f}' AND kind = 'contains' UNION ALL SELECT '{f}', 'in', kind, source FROM v_edges WHERE target = '{f}' AND kind <> 'contains'
UNION ALL SELECT '{f}', 'out', kind, target FROM v_edges WHERE source = '{f}' AND kind <> 'contains' UNION ALL SELECT DISTINCT '{f}', 'ancestor', 'contains', id FROM up WHERE focal = '{f}' AND id <> '{f}'"""


@query("graph_node_surroundings", "WITH RECURSIVE up(focal, id) AS (SELECT unnest(['class:3', 'function:5']), unnest(['class:3', 'function:5']) UNION SELECT focal, source FROM up JOIN v_edges ON target = id AND kind = 'contains') " + _AROUND.format(f="class:3") + " UNION ALL " + _AROUND.format(f="function:5"))
def surroundings(s, d):
    """A class, which has ancestors and children, and a function, which has references; the tables hold no types and imports."""
    e, n = b.edges(s, d), b.nodes(s, d).select("id", "kind")
    parts = [node_surroundings(e, n, f).withColumn("focal", F.lit(f)) for f in ("class:3", "function:5")]
    return reduce(DataFrame.unionByName, parts).select("focal", "part", "kind", "other")


@query("graph_blast_sections", f"""WITH r AS (SELECT id, name FROM v_nodes WHERE kind = 'struct' ORDER BY id LIMIT 5), e AS (SELECT DISTINCT r.id, r.name, e.source FROM r JOIN v_edges e ON e.target = r.id AND e.kind <> 'contains'),
f AS (SELECT e.id, e.name, count(*)::BIGINT AS callers FROM e GROUP BY ALL), g AS (SELECT DISTINCT e.id, n.file_path, regexp_matches(n.file_path, '{score.TEST_PATH}') AS test FROM e JOIN v_nodes n ON n.id = e.source)
SELECT f.id, f.name, f.callers, array_to_string((list(file_path ORDER BY file_path) FILTER (NOT test))[1:4], ' ') AS files, greatest(count(*) FILTER (NOT test) - 4, 0)::BIGINT AS more,
array_to_string((list(file_path ORDER BY file_path) FILTER (test))[1:4], ' ') AS tests FROM f JOIN g USING (id) GROUP BY f.id, f.name, f.callers""")
def blast_sections(s, d):
    """What depends on the first five types that anything uses: how many callers, the first four of their files, how many more, and the tests among them."""
    n = b.nodes(s, d)
    roots = n.where("kind = 'struct'").select("id", "name").orderBy("id").limit(5)
    uses = b.edges(s, d, ("calls", "references")).select(F.col("target").alias("id"), "source").join(F.broadcast(roots), "id").distinct()
    placed = materialised(uses.join(n.select(F.col("id").alias("source"), "file_path"), "source", "left"), "uses")
    per_file = placed.where("file_path is not null").groupBy("id", "file_path").agg(F.lit(1).alias("one")).select("id", "file_path", score.is_test_path(F.col("file_path")).alias("test"))
    sizes = per_file.groupBy("id").agg(F.greatest(F.count_if(~F.col("test")) - 4, F.lit(0)).cast("long").alias("more"))
    first = graph.top_per(per_file, ["id", "test"], [F.col("file_path")], 4)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("rank", "file_path")))), lambda r: r["file_path"]), " ")
    lists = first.groupBy("id").agg(listed(~F.col("test")).alias("files"), listed(F.col("test")).alias("tests"))
    lists = lists.select("id", F.nullif("files", F.lit("")).alias("files"), F.nullif("tests", F.lit("")).alias("tests"))
    callers = placed.groupBy("id", "name").agg(F.count(F.lit(1)).alias("callers"))
    return callers.join(sizes, "id").join(lists, "id").select("id", "name", "callers", "files", "more", "tests")


# ---- plans and sections --------------------------------------------------------------------------------------------

#: A plan's fields, what is cut off at the ends of a term, bytes of a term, and how many terms stay.
PLAN_FIELDS = {"must": (2, 40, 2), "should": (2, 40, 6), "exclude": (2, 40, 3), "phrases": (3, 80, 3), "hints": (2, 80, 3)}
ENDS = ".,;:!?\"'()[]{}"
_SPLIT = {"must": " ", "should": " ", "exclude": " ", "phrases": ". ", "hints": ", "}


def _clean_sql(field: str) -> str:
    least, most, cap = PLAN_FIELDS[field]
    ends = "" if field == "phrases" else (" " if field == "hints" else "") + ENDS.replace("'", "''")
    term = f"trim(trim(x), '{ends}')" if ends else "trim(x)"
    word = " AND NOT regexp_matches(x, '[ \\t\\n/]')" if most == 40 else ""
    kept = f"list_filter(list_transform(string_split(lower(text), '{_SPLIT[field]}'), lambda x: {term}), lambda x: strlen(x) BETWEEN {least} AND {most}{word})"
    return f"array_to_string(list_filter({kept}, lambda x, i: list_position({kept}, x) = i)[1:{cap}], '|') AS \"{field}\""


def clean_terms(terms: Column, field: str) -> Column:
    """The terms of a plan's field as a search takes them: trimmed, lower case, of fair length, each once, and no more than the field's cap."""
    least, most, cap = PLAN_FIELDS[field]
    trimmed = F.transform(terms, lambda x: F.trim(F.lower(x)))
    if field != "phrases":
        trimmed = F.transform(trimmed, lambda x: F.btrim(x, F.lit((" " if field == "hints" else "") + ENDS)))
    fair = lambda x: F.octet_length(x).between(least, most) & (~F.rlike(x, F.lit("[ \t\n/]")) if most == 40 else F.lit(True))
    return F.slice(F.array_distinct(F.filter(trimmed, fair)), 1, cap)


@query("filter_plan_fields", "SELECT item_id, " + ", ".join(_clean_sql(f) for f in PLAN_FIELDS) + " FROM benchmark")
def plan_fields(s, d):
    """All five fields of a plan; a passage's words, sentences and clauses stand for them."""
    terms = lambda f: F.split("text", _SPLIT[f].replace(".", "\\."))
    return b.table(s, d, "benchmark").select("item_id", *[F.array_join(clean_terms(terms(f), f), "|").alias(f) for f in PLAN_FIELDS])


@query("topk_section_lists", "SELECT repo, mem_type, array_to_string(list(key ORDER BY vec_id)[1:5], ' ') AS kept, greatest(count(*) - 5, 0)::BIGINT AS dropped FROM v_memories GROUP BY ALL")
def section_lists(s, d):
    """Each section's first five, and how many were cut off."""
    m = b.memories(s, d).select("repo", "mem_type", "key", "vec_id")
    sizes = m.groupBy("repo", "mem_type").agg(F.greatest(F.count(F.lit(1)) - 5, F.lit(0)).cast("long").alias("dropped"))
    first = graph.top_per(m, ["repo", "mem_type"], [F.col("vec_id")], 5).groupBy("repo", "mem_type")
    kept = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda r: r["key"]), " ").alias("kept"))
    return kept.join(sizes, ["repo", "mem_type"])


@query("vector_memory_sections", f"""WITH h AS (SELECT m.*, round(greatest(0, least(1, {_COS})), 6) AS sim FROM v_memories m, (SELECT * FROM embeddings WHERE vec_id = 7) a ORDER BY {_COS} DESC, key LIMIT 60)
SELECT DISTINCT 'hint' AS section, file AS item, NULL::DOUBLE AS sim, NULL::BOOLEAN AS stale FROM h WHERE source = 'auto' UNION ALL SELECT mem_type, key, sim, scope = 'branch' FROM h WHERE source <> 'auto'""")
def memory_sections(s, d):
    """A question's sixty nearest memories: automatic ones only hint at their files, each once; others come by type with likeness and staleness."""
    near = with_distance(b.memories(s, d), probes(s, d, (7,))).orderBy("distance", "key").limit(60)
    hits = materialised(near.select("key", "mem_type", "source", "file", "scope", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance"))), 6).alias("sim")), "hits")
    hints = hits.where("source = 'auto'").select(F.lit("hint").alias("section"), F.col("file").alias("item"), F.lit(None).cast("double").alias("sim"), F.lit(None).cast("boolean").alias("stale")).distinct()
    return hints.unionByName(hits.where("source <> 'auto'").select(F.col("mem_type").alias("section"), F.col("key").alias("item"), "sim", (F.col("scope") == "branch").alias("stale")))

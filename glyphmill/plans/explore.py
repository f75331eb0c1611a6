"""Files to explore for a question, plan filters on graph links, answers as text, and texts as vectors without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import score, text
from glyphmill.operators import graph
from glyphmill.operators.storage import materialised
from glyphmill.plans import bindings as b
from glyphmill.plans.adaptive import any_term, by_convention
from glyphmill.plans.analytics import _RANKS
from glyphmill.plans.registry import query
from glyphmill.plans.search import idf_name_search

#: Points of a file for a named symbol, an entry, a neighbour of one, and any other; least points; the share of the best file's rank that stays.
NAMED, ENTRY, NEAR, OTHER, LEAST, SHARE = 50, 10, 3, 1, 3, 0.06
TERMS = ("red", "widget")


def explored(nodes: DataFrame, edges: DataFrame, entries: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(place, file_path, points, symbols, hits): files of a subgraph in the order in which to read them, 40 at most.

    entries: id and named. Files of few points go; tests and generated files go where two others stay; then those far from the entries by
    rank, unless central, with an entry or with two terms, again where two stay. Ranks within one hundredth of the best count as equal.
    """
    ranks = graph.personalised_pagerank(edges, entries.select("id"))
    ends = edges.join(entries.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    ends = ends.unionByName(edges.join(entries.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id"))).distinct().withColumn("near", F.lit(True))
    points = F.when(F.col("named"), NAMED).when(F.col("named").isNotNull(), ENTRY).when(F.col("near"), NEAR).otherwise(OTHER)
    rows = nodes.join(ranks, "id").join(F.broadcast(entries), "id", "left").join(ends, "id", "left")
    held = [F.max(F.contains(F.lower(F.concat_ws(" ", "file_path", "name")), F.lit(t)).cast("int")) for t in terms]
    files = rows.groupBy("file_path").agg(
        F.sum(points).alias("points"), F.count(F.lit(1)).alias("symbols"), F.sum("rank").alias("rank"), sum(held, F.lit(0)).alias("hits"),
        F.coalesce(F.max("named"), F.lit(False)).alias("named"), F.max(F.col("named").isNotNull()).alias("entry"),
    ).withColumn("low", score.is_low_value(F.col("file_path")))
    files = materialised(files, "files")
    best = files.agg(F.max("rank").alias("most"))
    kept = files.where(F.col("points") >= LEAST).join(F.broadcast(best))
    kept = _where_two_stay(kept, ~F.col("low"))
    central = kept.where("hits >= 1 AND rank > 0").orderBy(F.desc("rank"), F.desc("hits"), "file_path").limit(2).select("file_path", F.lit(True).alias("central"))
    kept = _where_two_stay(kept.join(F.broadcast(central), "file_path", "left"), (F.col("rank") >= F.col("most") * SHARE) | F.coalesce("central", F.lit(False)) | F.col("entry") | (F.col("hits") >= 2))
    order = [F.desc("named"), F.desc(F.floor(F.round(F.col("rank") / F.col("most") * 100, 4))), F.desc("hits"), F.col("low"), F.desc("points"), F.desc("symbols"), F.col("file_path")]
    return kept.orderBy(*order).limit(40).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "file_path", "points", "symbols", "hits")


def _where_two_stay(files: DataFrame, keep: Column) -> DataFrame:
    n = files.agg(F.count_if(keep).alias("n"))
    return files.join(F.broadcast(n)).where(keep | (F.col("n") < 2)).drop("n")


_SEEDS = """h AS (SELECT id, name, t, CASE WHEN contains(lower(name), t) THEN 1.0 WHEN contains(lower(file_path), t) THEN 0.7 WHEN contains(lower(coalesce(signature, '')), t) THEN 0.4 END::DOUBLE AS w FROM v_nodes, (VALUES ('red'), ('widget')) x(t) WHERE kind = 'function'),
k AS (SELECT * FROM h WHERE w IS NOT NULL), f AS (SELECT t, least(8.0::DOUBLE, ln(1 + 1000.0::DOUBLE / (count(*) + 1))) AS idf FROM k GROUP BY t),
s AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY score DESC, length(name), id) <= 2 AS named FROM (SELECT id, name, sum(idf * w) AS score FROM k JOIN f USING (t) GROUP BY id, name ORDER BY score DESC, length(name), id LIMIT 5))"""


@query("search_explore_ranked", f"""WITH {_SEEDS}, e1 AS (SELECT source, target FROM v_edges WHERE kind = 'references' AND source IN (SELECT id FROM s)),
e AS MATERIALIZED (SELECT * FROM e1 UNION ALL SELECT source, target FROM v_edges WHERE kind = 'contains' AND target IN (SELECT target FROM e1)),
both_ AS (SELECT source AS s, target AS t FROM e UNION ALL SELECT target, source FROM e), w AS (SELECT s, t, count(*) AS w FROM both_ GROUP BY ALL), p AS MATERIALIZED (SELECT s, t, w::DOUBLE / sum(w) OVER (PARTITION BY s) AS p FROM w),
base AS MATERIALIZED (SELECT id, (id IN (SELECT id FROM s))::INTEGER / (SELECT count(*) FROM s)::DOUBLE AS base FROM (SELECT DISTINCT s AS id FROM both_)), r0 AS (SELECT id, base AS rank FROM base), {_RANKS},
q AS (SELECT n.file_path, n.name, s.named, s.id IS NOT NULL AS entry, r.rank, CASE WHEN s.named THEN {NAMED} WHEN s.id IS NOT NULL THEN {ENTRY} WHEN n.id IN (SELECT target FROM e1) THEN {NEAR} ELSE {OTHER} END AS points
  FROM v_nodes n JOIN r25 r USING (id) LEFT JOIN s USING (id)),
g AS (SELECT file_path, sum(points)::BIGINT AS points, count(*)::BIGINT AS symbols, sum(rank) AS rank, coalesce(bool_or(named), false) AS named, bool_or(entry) AS entry, regexp_matches(file_path, '(^|/)test_[^/]+\\.py$') AS low,
  max(contains(lower(file_path || ' ' || name), 'red')::INTEGER) + max(contains(lower(file_path || ' ' || name), 'widget')::INTEGER) AS hits FROM q GROUP BY file_path),
m AS (SELECT max(rank) AS most FROM g), a AS (SELECT * FROM g WHERE points >= {LEAST}), a1 AS (SELECT * FROM a WHERE NOT low OR (SELECT count(*) FROM a WHERE NOT low) < 2),
c AS (SELECT file_path FROM a1 WHERE hits >= 1 AND rank > 0 ORDER BY rank DESC, hits DESC, file_path LIMIT 2),
a2 AS (SELECT a1.*, most, rank >= most * {SHARE}::DOUBLE OR entry OR hits >= 2 OR file_path IN (SELECT file_path FROM c) AS stays FROM a1, m), a3 AS (SELECT * FROM a2 WHERE stays OR (SELECT count(*) FROM a2 WHERE stays) < 2)
SELECT row_number() OVER (ORDER BY named DESC, floor(round(rank / most * 100, 4)) DESC, hits DESC, low, points DESC, symbols DESC, file_path)::INTEGER AS place, file_path, points, symbols, hits FROM a3 ORDER BY 1 LIMIT 40""")
def explore_ranked(s, d):
    """The files around the five best functions of a question: the types that they refer to, and what holds these."""
    terms = list(TERMS)
    found = idf_name_search(b.nodes(s, d).where("kind = 'function'"), terms, 5)
    entries = materialised(found.select("id", (F.row_number().over(Window.orderBy(F.desc("score"), F.length("name"), "id")) <= 2).alias("named")), "entries")
    refs = b.edges(s, d, ("references",)).join(F.broadcast(entries.select(F.col("id").alias("source"))), "source", "left_semi").select("source", "target")
    held = b.edges(s, d, ("contains",)).select("source", "target").join(refs.select("target").distinct(), "target", "left_semi").select("source", "target")
    return explored(b.nodes(s, d).select("id", "name", "file_path"), materialised(refs.unionByName(held), "around"), entries, TERMS)


# ---- plan filters --------------------------------------------------------------------------------------------------


def kept_links(links: DataFrame, seeds: DataFrame, must: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """Links (source, target, from_path, and name and path of the target) that touch a seed or have a must term, without targets that a convention excludes."""
    ids = F.broadcast(seeds.select("id").distinct())
    touched = links.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("a")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("z")), "target", "left")
    wanted = F.coalesce("a", "z", F.lit(False)) | any_term(F.concat_ws(" ", "source", "name", "from_path"), must) if must else F.lit(True)
    gone = by_convention({"name": F.col("name"), "path": F.col("from_path"), "target path": F.col("path")}, exclude)
    return touched.where(wanted & ~gone).drop("a", "z")


@query("filter_graph_links", """SELECT DISTINCT e.source, e.target FROM v_edges e JOIN v_nodes a ON a.id = e.source JOIN v_nodes z ON z.id = e.target WHERE e.kind <> 'calls'
AND (e.source IN ('struct:1', 'namespace:3') OR e.target IN ('struct:1', 'namespace:3') OR contains(lower(e.source || ' ' || z.name || ' ' || a.file_path), 'brand3')) AND NOT starts_with(lower(z.name), 'mock') AND NOT contains(lower(a.file_path), '/mock')""")
def graph_links(s, d):
    """References and members by a plan: what touches the question's seeds stays, other links need a must term."""
    n = b.nodes(s, d)
    links = b.edges(s, d, ("contains", "references")).select("source", "target").join(n.select(F.col("id").alias("source"), F.col("file_path").alias("from_path")), "source")
    links = links.join(n.select(F.col("id").alias("target"), "name", F.col("file_path").alias("path")), "target")
    seeds = n.where(F.col("id").isin("struct:1", "namespace:3")).select("id")
    return kept_links(links, seeds, ("brand3",), ("mock",)).select("source", "target").distinct()


# ---- answers as text -----------------------------------------------------------------------------------------------


def markdown_entry(name: str = "name", kind: str = "kind", path: str = "file_path", line: str = "start_line", signature: str = "signature") -> Column:
    """A symbol as an item of a list, its signature below it."""
    head = F.concat(F.lit("- **"), F.col(name), F.lit("** ("), F.col(kind), F.lit(") - "), F.col(path), F.coalesce(F.concat(F.lit(":"), F.col(line).cast("string")), F.lit("")))
    return F.concat(head, F.coalesce(F.concat(F.lit("\n  `"), F.col(signature), F.lit("`")), F.lit("")))


@query("fn_format_entries", """SELECT id, '- **' || name || '** (' || kind || ') - ' || file_path || ':' || start_line || coalesce(chr(10) || '  `' || signature || '`', '') AS markdown,
to_json({'name': name, 'kind': kind, 'filePath': file_path, 'startLine': start_line})::VARCHAR AS json FROM v_nodes""")
def format_entries(s, d):
    """Each symbol as an answer shows it, as markdown and as JSON."""
    shape = F.struct("name", "kind", F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"))
    return b.nodes(s, d).select("id", markdown_entry().alias("markdown"), F.to_json(shape).alias("json"))


# ---- texts as vectors ----------------------------------------------------------------------------------------------


def hashed_vectors(rows: DataFrame, key: str, column: str, size: int = 64) -> DataFrame:
    """(key, dim, x): unit vectors of texts from hashed words, one row for each component that isn't zero. A text without words has none."""
    w = rows.select(key, F.explode(text.words_of(F.col(column), 3)).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    h = F.md5("w")
    dim = (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % size).cast("int")
    part = w.groupBy(key, dim.alias("dim")).agg(F.sum(F.when(F.substring(h, 9, 1) < "8", F.col("n")).otherwise(-F.col("n"))).alias("n")).where("n <> 0")
    norm = part.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return part.join(norm, key).select(key, "dim", F.round(F.col("n") / F.col("norm"), 6).alias("x"))


@query("vector_embed_hashed", """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS w FROM documents),
p AS (SELECT doc_id, (('0x' || md5(w)[1:8])::BIGINT % 64)::INTEGER AS dim, sum(CASE WHEN md5(w)[9] < '8' THEN 1 ELSE -1 END)::BIGINT AS n FROM w GROUP BY ALL HAVING n <> 0)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS x FROM p""")
def embed_hashed(s, d):
    """Documents as vectors where no model is at hand."""
    return hashed_vectors(b.docs(s, d), "doc_id", "text")

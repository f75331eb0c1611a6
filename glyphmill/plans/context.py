"""Hybrid context: a query's field filters, candidates of several channels, re-ranking by what corroborates them, and
the graph around what is left."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import score, text
from glyphmill.operators import subgraph
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query
from glyphmill.plans.search import COLUMN_WEIGHTS, bm25

N, E = "v_nodes", "v_edges"
DEFINITIONS = ("class", "interface", "struct", "trait", "protocol", "enum", "type_alias")
FIELDS = {"kind": "kinds", "lang": "languages", "language": "languages", "path": "paths", "name": "names"}
LANGUAGES = ("go", "java", "python", "typescript", "tsx", "javascript", "ruby", "rust", "php", "csharp", "vue", "html")


@dataclass
class FieldQuery:
    """What a query line asks for: filters of a field are alternatives, fields narrow each other, and the rest is text."""

    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def condition(self) -> Column:
        out = F.lit(True)
        if self.kinds:
            out &= F.col("kind").isin(*self.kinds)
        if self.languages:
            out &= F.col("language").isin(*self.languages)
        for column, parts in (("file_path", self.paths), ("name", self.names)):
            if parts:
                hit = F.lit(False)
                for p in parts:
                    hit |= F.contains(F.lower(column), F.lit(p.lower()))
                out &= hit
        return out


def field_query(line: str) -> FieldQuery:
    """Words as shlex-like tokens with double quotes; a field with an unknown name or value is text."""
    out, words, token, quoted = FieldQuery(), [], "", False
    for c in [*line, " "]:
        if c == '"':
            quoted = not quoted
        if c.isspace() and not quoted:
            words += [token] if token else []
            token = ""
        else:
            token += c
    words += [token.strip()] if token.strip() else []
    free = []
    for w in words:
        name, colon, value = w.partition(":")
        value = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
        into = FIELDS.get(name.lower()) if colon and value else None
        known = {"kinds": score.KIND_BONUS, "languages": LANGUAGES}.get(into)
        if into is None or (known is not None and value.lower() not in known):
            free.append(w)
        else:
            getattr(out, into).append(value.lower() if known is not None else value)
    out.text = " ".join(free)
    return out


def term_groups(terms: Sequence[str]) -> list[list[str]]:
    """Terms that hold one another are one concept; the longest opens a group."""
    groups: list[list[str]] = []
    for t in sorted(dict.fromkeys(terms), key=lambda x: (-len(x), x)):
        home = next((g for g in groups if t in g[0] or g[0] in t), None)
        groups.append([t]) if home is None else home.append(t)
    return groups


def exact_hits(n: DataFrame, symbols: Sequence[str]) -> DataFrame:
    return n.where(F.lower("name").isin(*[s.lower() for s in symbols])).select("id", F.lit(100.0).alias("score"), F.lit(True).alias("exact"))


def prefix_definitions(n: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Type definitions whose name starts with a term, shorter names higher."""
    low, hit = F.lower("name"), F.lit(False)
    for t in terms:
        hit |= F.startswith(low, F.lit(t))
    return n.where(F.col("kind").isin(*DEFINITIONS) & hit).select("id", (F.lit(15.0) + F.greatest(F.lit(0.0), F.lit(10.0) - F.length("name") / 4)).alias("score"), F.lit(False).alias("exact"))


def text_hits(n: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The best score that a single term gives, and 5 for each further term that hits too."""
    per = None
    for t in terms:
        one = bm25(n, "id", COLUMN_WEIGHTS, t)
        per = one if per is None else per.unionByName(one)
    g = per.groupBy("id").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))
    return g.select("id", (F.col("best") + 5.0 * (F.col("n") - 1)).alias("score"), F.lit(False).alias("exact"))


def corroborated(terms: Sequence[str], distinctive: Sequence[str]) -> tuple[Column, Column]:
    """(number of term groups that a node's name holds or that name one of its folders, the factor that follows)."""
    folders, low = F.split(F.lower(text.dir_name(F.col("file_path"))), "/"), F.lower("name")
    count = F.lit(0)
    for g in term_groups(terms):
        hit = F.lit(False)
        for t in g:
            hit |= F.contains(low, F.lit(t)) | F.array_contains(folders, t)
        count = count + hit.cast("int")
    factor = F.when(F.lit(len(terms) < 2), 1.0).when(count >= 2, 1 + 0.5 * count)
    if distinctive:
        factor = factor.when(F.col("exact") & low.isin(*distinctive), 1.0)
    return count, factor.when(F.col("exact"), 0.3).otherwise(0.6)


def hybrid_context(n: DataFrame, question: str, *, core_dir: str | None = None, limit: int = 20) -> DataFrame:
    """(id, score, hits, confident): the symbols that a question is about, best first.

    Channels (exact names, type definitions by prefix, text by term) are united by their best score; tests count for
    less unless asked for, a core folder for more; then each row is weighed by how many of the question's concepts
    meet in it. confident: several concepts meet in the row, or the question names it. Ties go to the smaller id.
    """
    asked = field_query(question)
    n = n.where(asked.condition())
    terms = [t for t in dict.fromkeys(asked.text.lower().replace("::", " ").split()) if len(t) > 1 and t not in text.STOP_WORDS]
    if not terms:
        return n.orderBy("name", "id").limit(limit).select("id", F.lit(1.0).alias("score"), F.lit(0).alias("hits"), F.lit(False).alias("confident"))
    distinctive = [w.lower() for w in asked.text.split() if any(c in "_0123456789" for c in w) or any(c.isupper() for c in w[1:])]
    channels = exact_hits(n, terms).unionByName(prefix_definitions(n, terms)).unionByName(text_hits(n, terms))
    best = channels.groupBy("id").agg(F.max("score").alias("score"), F.max("exact").alias("exact"))
    r = best.join(n.select("id", "name", "file_path"), "id")
    if "test" not in question.lower() and "spec" not in question.lower():
        r = r.withColumn("score", F.col("score") * F.when(score.is_test_path(F.col("file_path")), 0.3).otherwise(1.0))
    if core_dir:
        r = r.withColumn("score", F.col("score") + F.when(F.startswith("file_path", F.lit(core_dir)), 25.0).otherwise(0.0))
    count, factor = corroborated(terms, distinctive)
    r = r.withColumns({"hits": count, "factor": factor})
    named = (F.col("exact") & F.lower("name").isin(*distinctive)) if distinctive else F.lit(False)
    out = r.select("id", (F.col("score") * F.col("factor")).alias("score"), F.col("hits").cast("int").alias("hits"), ((F.col("hits") >= 2) | named).alias("confident"))
    return out.orderBy(F.desc("score"), "id").limit(limit)


_TOK = "string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+')"


def _bm25_all(src: str, term: str) -> str:
    parts = " UNION ALL ".join(f"SELECT id AS k, unnest({_TOK.format(c=c)}) AS term, {w}::DOUBLE AS w FROM {src}" for c, w in COLUMN_WEIGHTS)
    return f"""(WITH toks AS (SELECT * FROM ({parts}) WHERE term <> ''), lens AS (SELECT k, count(*) AS len FROM toks GROUP BY k),
stats AS (SELECT (SELECT count(*) FROM {src}) AS n, (SELECT count(*) FROM toks)::DOUBLE / (SELECT count(*) FROM {src}) AS avgl), m AS (SELECT k, sum(w) AS tf FROM toks WHERE starts_with(term, '{term}') GROUP BY k),
df AS (SELECT count(*) AS df FROM m) SELECT m.k AS id, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgl)) AS score FROM m JOIN lens USING (k), stats, df)"""


_CONTEXT = f"""
WITH src AS (SELECT * FROM {N} WHERE kind IN ('function', 'class', 'struct')),
t AS (SELECT id, max(score) + 5.0::DOUBLE * (count(*) - 1) AS score FROM (SELECT * FROM {_bm25_all('src', 'red')} UNION ALL SELECT * FROM {_bm25_all('src', 'widget')}) GROUP BY id),
c AS (SELECT id, score, false AS exact FROM t UNION ALL SELECT id, 100.0::DOUBLE, true FROM src WHERE lower(name) IN ('red', 'widget')
  UNION ALL SELECT id, 15.0::DOUBLE + greatest(0.0::DOUBLE, 10.0::DOUBLE - length(name) / 4.0::DOUBLE), false FROM src WHERE kind IN ('class', 'struct') AND (starts_with(lower(name), 'red') OR starts_with(lower(name), 'widget'))),
g AS (SELECT id, max(score) AS score, bool_or(exact) AS exact FROM c GROUP BY id),
r AS (SELECT id, name, exact, (score * CASE WHEN regexp_matches(file_path, '{score.TEST_PATH}') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN starts_with(file_path, 'parts/brand1') THEN 25.0::DOUBLE ELSE 0.0::DOUBLE END) AS score,
  contains(lower(name), 'red')::INTEGER + contains(lower(name), 'widget')::INTEGER AS hits FROM g JOIN src USING (id)),
top AS (SELECT id, score * CASE WHEN hits >= 2 THEN 1 + 0.5::DOUBLE * hits WHEN exact THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS score, hits::INTEGER AS hits, hits >= 2 AS confident FROM r ORDER BY 2 DESC, id LIMIT 20)"""


@query("context_hybrid", f"{_CONTEXT} SELECT id, round(score, 6) AS score, hits, confident FROM top")
def context_hybrid(s, d):
    n = b.nodes(s, d).select("id", "kind", "name", "qualified_name", "file_path", "language", "signature", "docstring")
    return hybrid_context(n, "kind:function kind:class kind:struct red widget", core_dir="parts/brand1").withColumn("score", F.round("score", 6))


@query("context_field_query", f"SELECT id, name FROM {N} WHERE kind IN ('struct', 'namespace') AND language = 'go' AND contains(lower(file_path), 'world/1/') ORDER BY name, id LIMIT 50")
def context_field_query(s, d):
    asked = field_query('kind:struct KIND:namespace lang:go path:"World/1/"')
    return b.nodes(s, d).where(asked.condition()).select("id", "name").orderBy("name", "id").limit(50)


def _level(name: str, seen: str, before: str, s: str, t: str, src: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT DISTINCT {t} AS id FROM {src} WHERE {s} IN (SELECT id FROM {before} ORDER BY id LIMIT {subgraph.MAX_FRONTIER}) AND {t} NOT IN ({seen}))"


_CALLS = f"(SELECT source, target FROM {E} WHERE kind <> 'contains')"
_SNAPSHOT = f"""
WITH e AS MATERIALIZED (SELECT DISTINCT source, target, kind FROM {E}), x AS (SELECT source, target FROM e WHERE kind <> 'contains'), s0 AS (SELECT id FROM (VALUES ('function:1'), ('function:7')) v(id)),
{_level('d1', 'SELECT id FROM s0', 's0', 'source', 'target', 'x')}, {_level('d2', 'SELECT id FROM s0 UNION ALL SELECT id FROM d1', 'd1', 'source', 'target', 'x')},
{_level('u1', 'SELECT id FROM s0', 's0', 'target', 'source', 'x')}, {_level('u2', 'SELECT id FROM s0 UNION ALL SELECT id FROM u1', 'u1', 'target', 'source', 'x')},
a AS (SELECT id, 'seed' AS role, 0 AS depth, 0 AS turn, 1 AS rank FROM s0 UNION ALL SELECT id, 'callee', 1, 1, 3 FROM d1 UNION ALL SELECT id, 'callee', 2, 1, 3 FROM d2 UNION ALL SELECT id, 'caller', -1, 2, 2 FROM u1 UNION ALL SELECT id, 'caller', -2, 2, 2 FROM u2
  UNION ALL SELECT target, 'method', 1, 3, 6 FROM e WHERE kind = 'contains' AND source IN (SELECT id FROM s0)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, abs(depth)) AS rn FROM a) WHERE rn = 1),
snap AS (SELECT id, role, depth FROM f ORDER BY rank, abs(depth), id LIMIT {subgraph.MAX_NODES})"""


def _snapshot(s, d) -> tuple[DataFrame, DataFrame]:
    e = b.edges(s, d)
    seeds = s.range(1).select(F.explode(F.array(F.lit("function:1"), F.lit("function:7"))).alias("id"))
    return e, subgraph.snapshot(e, seeds, call_kinds=("calls", "references"), auxiliary=(("contains", "method", False),), depth=2)


@query("graph_snapshot_nodes", f"{_SNAPSHOT} SELECT id, role, depth::INTEGER AS depth FROM snap")
def snapshot_nodes(s, d):
    return _snapshot(s, d)[1]


@query("graph_snapshot_edges", f"{_SNAPSHOT} SELECT source, target, kind FROM e WHERE source IN (SELECT id FROM snap) AND target IN (SELECT id FROM snap) ORDER BY 1, 2, 3 LIMIT {subgraph.MAX_EDGES}")
def snapshot_edges(s, d):
    e, nodes = _snapshot(s, d)
    return subgraph.snapshot_edges(e, nodes)


_FILTERED = f"""{_SNAPSHOT}, p AS (SELECT snap.*, file_path, name FROM snap JOIN {N} USING (id)),
o AS (SELECT *, role = 'seed' OR contains(file_path, '1') AS fits FROM p WHERE role = 'seed' OR NOT contains(file_path, '/s3')),
b2 AS (SELECT source AS s, target AS t FROM e UNION SELECT target, source FROM e), nr AS (SELECT DISTINCT t AS id FROM b2 WHERE s IN (SELECT id FROM o WHERE fits)),
k AS (SELECT * FROM o WHERE fits OR (abs(depth) = 1 AND id IN (SELECT id FROM nr))), ln AS (SELECT DISTINCT s AS id FROM b2 WHERE s <> t AND s IN (SELECT id FROM k) AND t IN (SELECT id FROM k)),
kept AS (SELECT * FROM k WHERE role = 'seed' OR id IN (SELECT id FROM ln))"""


def _filtered(s, d) -> DataFrame:
    e, nodes = _snapshot(s, d)
    placed = b.nodes(s, d).select("id", "name", "file_path").join(F.broadcast(nodes), "id")
    return subgraph.plan_filtered(placed, e, F.contains("file_path", F.lit("1")), F.contains("file_path", F.lit("/s3")))


@query("graph_plan_filter", f"{_FILTERED} SELECT id, role, depth::INTEGER AS depth FROM kept")
def plan_filter(s, d):
    return _filtered(s, d).select("id", "role", "depth")


@query("graph_collapse_files", f"{_FILTERED} SELECT file_path, arg_min(role, (rank, abs(depth))) AS role, arg_min(depth, (rank, abs(depth)))::INTEGER AS depth, count(*)::BIGINT AS symbols FROM (SELECT *, CASE role WHEN 'seed' THEN 1 WHEN 'caller' THEN 2 WHEN 'callee' THEN 3 ELSE 6 END AS rank FROM kept) GROUP BY file_path")
def collapse_files(s, d):
    return subgraph.collapsed_to_files(_filtered(s, d))


@query("graph_glue_nodes", f"WITH roots AS (SELECT id FROM {N} WHERE kind = 'namespace' OR (kind = 'class' AND name <= 'Customer#000000200')), b2 AS (SELECT source AS s, target AS t FROM {E} UNION ALL SELECT target, source FROM {E}), l AS (SELECT t AS id, count(*) AS links FROM b2 WHERE s IN (SELECT id FROM roots) GROUP BY t) SELECT id, links::BIGINT AS links FROM l JOIN {N} n USING (id) WHERE n.file_path IN (SELECT file_path FROM {N} WHERE id IN (SELECT id FROM roots)) AND id NOT IN (SELECT id FROM roots) ORDER BY links DESC, id LIMIT 60")
def glue_nodes(s, d):
    n = b.nodes(s, d).select("id", "kind", "name", "file_path")
    roots = n.where("kind = 'namespace' OR (kind = 'class' AND name <= 'Customer#000000200')").select("id")
    return subgraph.glue_nodes(n, b.edges(s, d), roots)


@query("graph_edge_recovery", f"{_SNAPSHOT} SELECT DISTINCT source, target, kind FROM e WHERE source IN (SELECT id FROM snap) AND target IN (SELECT id FROM snap) AND NOT (kind = 'calls' AND source < target)")
def edge_recovery(s, d):
    """Edges between the nodes of a snapshot beside those that a walk in one direction has found."""
    e, nodes = _snapshot(s, d)
    have = e.where("kind = 'calls' AND source < target")
    return subgraph.recovered_edges(e, nodes, have)

"""Lexical search: BM25 over a prefix index, substring and edit-distance tiers, IDF name search and rescoring."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import score, text
from glyphmill.operators.graph import top_per
from glyphmill.operators.storage import materialised
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

N, E = "v_nodes", "v_edges"
#: BM25 constants and column weights.
K1, B = 1.2, 0.75
COLUMN_WEIGHTS = (("name", 20.0), ("qualified_name", 5.0), ("docstring", 1.0), ("signature", 2.0))


def postings(rows: DataFrame, key: str, columns: tuple[tuple[str, float], ...]) -> DataFrame:
    """(key, term, tf, len): weighted term counts of each row, and its length in tokens; counted within the row before any shuffle."""
    words = [text.words_of(F.col(c)) for c, _ in columns]

    def weighing(x: float):
        return lambda t: F.struct(t.alias("t"), F.lit(x).alias("w"))

    weighted = F.concat(*[F.transform(w, weighing(x)) for w, (_, x) in zip(words, columns, strict=True)])
    size = sum((F.size(w) for w in words), F.lit(0))
    # beside a generator, the length would be made again for each term
    per_row = rows.select(key, size.alias("len"), weighted.alias("all"))
    return per_row.select(key, "len", F.explode("all").alias("p")).groupBy(key, "len", F.col("p.t").alias("term")).agg(F.sum("p.w").alias("tf"))


def bm25(rows: DataFrame, key: str, columns: tuple[tuple[str, float], ...], query_text: str) -> DataFrame:
    """(key, score): terms of the query match as prefixes and are added up.

    The text is read once: each row gives its length and its weighted count for each query term, and only those few numbers go further.
    """
    terms = [t for t in dict.fromkeys(query_text.lower().replace("::", " ").split()) if t.upper() not in ("AND", "OR", "NOT", "NEAR")]
    words = F.array(*[text.words_of(F.col(c)) for c, _ in columns])

    def count(term: str) -> Column:
        own = [F.size(F.filter(F.element_at("words", i), lambda w: F.startswith(w, F.lit(term)))) * F.lit(x) for i, (_, x) in enumerate(columns, 1)]
        return sum(own, F.lit(0.0))

    size = F.aggregate("words", F.lit(0), lambda n, w: n + F.size(w))
    counted = materialised(rows.select(key, words.alias("words")).select(key, size.alias("len"), F.array(*[count(t) for t in terms]).alias("tf")), "bm25")
    found = [F.count_if(F.element_at("tf", i) > 0).alias(f"df{i}") for i in range(1, len(terms) + 1)]
    corpus = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *found).first()
    score = F.lit(0.0)
    for i in range(1, len(terms) + 1):
        df, tf = corpus[f"df{i}"], F.element_at("tf", i)
        idf = max(1e-6, math.log((corpus["n"] - df + 0.5) / (df + 0.5)))
        score = score + F.when(tf > 0, F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(corpus["avg"])))).otherwise(0.0)
    return counted.where(F.exists("tf", lambda x: x > 0)).select(key, score.alias("score"))


def _rounded(c: str, n: int = 6) -> Column:
    return F.round(F.col(c), n).alias(c)


_TOKENS = "string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+')"


def _bm25_sql(rows: str, key: str, columns, terms: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT {key} AS k, unnest({_TOKENS.format(c=c)}) AS term, {w}::DOUBLE AS w FROM src" for c, w in columns)
    likes = ", ".join(f"('{t}')" for t in terms)
    return f"""
WITH src AS (SELECT * FROM {rows}), toks AS (SELECT * FROM ({parts}) WHERE term <> ''), lens AS (SELECT k, count(*) AS len FROM toks GROUP BY k),
stats AS (SELECT (SELECT count(*) FROM src) AS n, (SELECT count(*) FROM toks)::DOUBLE / (SELECT count(*) FROM src) AS avgl),
m AS (SELECT toks.k, q, sum(w) AS tf FROM toks JOIN (VALUES {likes}) t(q) ON starts_with(term, q) GROUP BY ALL), df AS (SELECT q, count(*) AS df FROM m GROUP BY q),
s AS (SELECT m.k, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgl))) AS score FROM m JOIN df USING (q) JOIN lens ON lens.k = m.k, stats GROUP BY m.k)
SELECT k AS {key}, round(score, 6) AS score FROM s ORDER BY s.score DESC, k LIMIT 20"""


@query("search_bm25_nodes", _bm25_sql("(SELECT * FROM v_nodes WHERE kind = 'function')", "id", COLUMN_WEIGHTS, ["red", "widget"]))
def bm25_nodes(s, d):
    n = b.nodes(s, d).where("kind = 'function'").select("id", *[c for c, _ in COLUMN_WEIGHTS])
    return bm25(n, "id", COLUMN_WEIGHTS, "red widget").orderBy(F.desc("score"), "id").limit(20).select("id", _rounded("score"))


@query("search_bm25_documents", _bm25_sql("documents", "doc_id", (("text", 1.0),), ["license", "apache"]))
def bm25_documents(s, d):
    return bm25(b.docs(s, d).select("doc_id", "text"), "doc_id", (("text", 1.0),), "license apache").orderBy(F.desc("score"), "doc_id").limit(20).select("doc_id", _rounded("score"))


@query("search_like_tiers", f"SELECT id, score FROM (SELECT id, name, CASE WHEN lower(name) = 'red' THEN 1.0::DOUBLE WHEN starts_with(lower(name), 'red') THEN 0.9::DOUBLE WHEN contains(lower(name), 'red') THEN 0.8::DOUBLE WHEN contains(lower(qualified_name), 'red') THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS score FROM {N} WHERE contains(lower(name), 'red') OR contains(lower(qualified_name), 'red') OR contains(lower(file_path), 'red')) ORDER BY score DESC, length(name), id LIMIT 100")
def like_tiers(s, d):
    low, term = lambda c: F.lower(c), F.lit("red")
    tier = F.when(low("name") == "red", 1.0).when(F.startswith(low("name"), term), 0.9).when(F.contains(low("name"), term), 0.8).when(F.contains(low("qualified_name"), term), 0.7).otherwise(0.5)
    n = b.nodes(s, d).where(F.contains(low("name"), term) | F.contains(low("qualified_name"), term) | F.contains(low("file_path"), term))
    return n.select("id", "name", tier.alias("score")).orderBy(F.desc("score"), F.length("name"), "id").limit(100).select("id", "score")


@query("search_fuzzy", f"SELECT name, levenshtein(lower(name), 'red widgat')::INTEGER AS d, (1.0::DOUBLE / (1 + levenshtein(lower(name), 'red widgat'))) AS score FROM (SELECT DISTINCT name FROM {N} WHERE kind = 'function') WHERE levenshtein(lower(name), 'red widgat') <= 2")
def fuzzy(s, d):
    names = b.nodes(s, d).where("kind = 'function'").select("name").distinct().where(F.abs(F.length("name") - F.lit(10)) <= 2)
    j = names.withColumn("d", F.levenshtein(F.lower("name"), F.lit("red widgat"), 2)).where("d >= 0")
    return j.select("name", "d", (F.lit(1.0) / (1 + F.col("d"))).alias("score"))


@query("search_exact_supplement", f"SELECT id, name FROM (SELECT id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS rn FROM {N} WHERE lower(name) IN ('asia', 'france', 'customer#000000001')) WHERE rn <= 20")
def exact_supplement(s, d):
    n = b.nodes(s, d).select("id", "name").where(F.lower("name").isin("asia", "france", "customer#000000001"))
    return top_per(n.withColumn("low", F.lower("name")), ["low"], [F.col("id")], 20).select("id", "name")


@query("search_rescored", f"""
SELECT id, points::INTEGER AS points FROM (SELECT id, file_path, CASE WHEN lower(name) IN ('red', 'widget') THEN 60 WHEN lower(name) = 'redwidget' THEN 80 WHEN contains(lower(name), 'red') AND contains(lower(name), 'widget') THEN 15 ELSE 0 END
 + CASE kind WHEN 'function' THEN 10 WHEN 'method' THEN 10 WHEN 'class' THEN 8 WHEN 'struct' THEN 6 WHEN 'module' THEN 4 WHEN 'namespace' THEN 4 ELSE 0 END - CASE WHEN regexp_matches(file_path, '{score.TEST_PATH}') THEN 15 ELSE 0 END AS points
 FROM {N} WHERE contains(lower(name), 'red') OR contains(lower(name), 'widget')) ORDER BY points DESC, id LIMIT 50""")
def rescored(s, d):
    low = F.lower("name")
    n = b.nodes(s, d).select("id", "kind", "name", "file_path").where(F.contains(low, F.lit("red")) | F.contains(low, F.lit("widget")))
    points = score.name_match_bonus(F.col("name"), "red widget") + score.kind_bonus(F.col("kind")) - F.when(score.is_test_path(F.col("file_path")), 15).otherwise(0)
    return n.select("id", points.cast("int").alias("points")).orderBy(F.desc("points"), "id").limit(50)


@query("search_filter_only", f"SELECT id, name FROM {N} WHERE kind = 'struct' AND language = 'go' ORDER BY name, id LIMIT 100")
def filter_only(s, d):
    return b.nodes(s, d).where("kind = 'struct' AND language = 'go'").select("id", "name").orderBy("name", "id").limit(100)


def idf_name_search(n: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """(id, name, score): sum over terms of the term's idf and the weight of the best surface that holds it."""
    arr = F.array(*[F.lit(t) for t in terms])
    surface = lambda t: F.when(F.contains(F.lower("name"), t), 1.0).when(F.contains(F.lower("file_path"), t), 0.7).when(F.contains(F.lower(F.coalesce("signature", F.lit(""))), t), 0.4)
    hits = n.select("id", "name", F.explode(F.transform(arr, lambda t: F.struct(t.alias("t"), surface(t).alias("w")))).alias("h")).where("h.w is not null").select("id", "name", "h.*")
    idf = hits.groupBy("t").agg(F.count(F.lit(1)).alias("df")).select("t", score.term_idf(F.col("df")).alias("idf"))
    scored = hits.join(F.broadcast(idf), "t").groupBy("id", "name").agg(F.sum(F.col("idf") * F.col("w")).alias("score"))
    return scored.orderBy(F.desc("score"), F.length("name"), "id").limit(limit)


@query("search_idf_name", f"""
WITH h AS (SELECT id, name, t, CASE WHEN contains(lower(name), t) THEN 1.0 WHEN contains(lower(file_path), t) THEN 0.7 WHEN contains(lower(coalesce(signature, '')), t) THEN 0.4 END::DOUBLE AS w FROM {N}, (VALUES ('red'), ('widget')) x(t) WHERE kind = 'function'),
k AS (SELECT * FROM h WHERE w IS NOT NULL), f AS (SELECT t, least(8.0::DOUBLE, ln(1 + 1000.0::DOUBLE / (count(*) + 1))) AS idf FROM k GROUP BY t),
top AS (SELECT id, name, sum(idf * w) AS score FROM k JOIN f USING (t) GROUP BY id, name ORDER BY score DESC, length(name), id LIMIT 10)
SELECT top.name, round(score, 6) AS score, e.source AS caller, min(e.line)::INTEGER AS line FROM top JOIN {E} e ON e.target = top.id AND e.kind = 'calls' GROUP BY top.name, round(score, 6), e.source""")
def idf_name(s: SparkSession, d: str) -> DataFrame:
    """The flagship: names by IDF search, then who calls them, the first line of each pair."""
    top = idf_name_search(b.nodes(s, d).where("kind = 'function'"), ["red", "widget"], 10)
    calls = b.edges(s, d, ("calls",)).select(F.col("source").alias("caller"), F.col("target").alias("id"), "line")
    first = calls.join(F.broadcast(top), "id").groupBy("name", "score", "caller", "id").agg(F.min("line").alias("line"))
    return first.groupBy("name", _rounded("score"), "caller").agg(F.min("line").alias("line"))


@query("search_must_files", f"SELECT DISTINCT file_path FROM {N} WHERE contains(lower(file_path), 'brand2') OR contains(lower(name), 'brand2') OR contains(lower(coalesce(signature, '')), 'brand2') OR contains(lower(qualified_name), 'brand2')")
def must_files(s, d):
    cols = ("file_path", "name", "signature", "qualified_name")
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("brand2"))
    return b.nodes(s, d).where(hit).select("file_path").distinct()


@query("search_by_path_tiers", f"WITH t AS (SELECT id, start_line, CASE WHEN file_path = 't14.py' THEN 1 WHEN ends_with(file_path, '/t15.py') THEN 2 WHEN contains(file_path, 't15.py') THEN 3 END AS tier FROM {N}) SELECT id, start_line, tier::INTEGER AS tier FROM t WHERE tier = (SELECT min(tier) FROM t)")
def by_path_tiers(s, d):
    tier = F.when(F.col("file_path") == "t14.py", 1).when(F.endswith("file_path", F.lit("/t15.py")), 2).when(F.contains("file_path", F.lit("t15.py")), 3)
    t = b.nodes(s, d).select("id", "start_line", tier.alias("tier")).where("tier is not null")
    return t.join(F.broadcast(t.agg(F.min("tier").alias("best"))), F.col("tier") == F.col("best")).select("id", "start_line", "tier")


@query("search_siblings", f"SELECT DISTINCT file_path FROM {N} WHERE regexp_replace(file_path, '/?[^/]*$', '') = 'world/1/1'")
def siblings(s, d):
    return b.nodes(s, d).select("file_path").where(text.dir_name(F.col("file_path")) == "world/1/1").distinct()


@query("search_importers_by_package", f"SELECT DISTINCT a.file_path FROM {E} e JOIN {N} z ON z.id = e.target JOIN {N} a ON a.id = e.source WHERE z.kind IN ('namespace','class') AND contains(lower(z.name), 'nation') AND e.kind = 'contains' AND NOT contains(lower(string_split(a.file_path, '/')[-1]), 'nation')")
def importers_by_package(s, d):
    n = b.nodes(s, d)
    z = n.where(F.col("kind").isin("namespace", "class") & F.contains(F.lower("name"), F.lit("nation"))).select(F.col("id").alias("target"))
    src = b.edges(s, d, ("contains",)).join(z, "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return n.join(src, "id", "left_semi").where(~F.contains(F.lower(text.base_name(F.col("file_path"))), F.lit("nation"))).select("file_path").distinct()


@query("search_colocation", f"WITH f AS (SELECT name, count(DISTINCT file_path) AS files FROM {N} WHERE kind = 'function' GROUP BY name), dis AS (SELECT DISTINCT file_path FROM {N} JOIN f USING (name) WHERE kind = 'function' AND files < 10) SELECT name, id, points::INTEGER AS points FROM (SELECT name, id, points, row_number() OVER (PARTITION BY name ORDER BY points DESC, id) AS rn FROM (SELECT name, id, CASE WHEN file_path IN (SELECT file_path FROM dis) THEN 20 ELSE 0 END AS points FROM {N} WHERE kind = 'function')) WHERE rn <= 3")
def colocation(s, d):
    n = b.nodes(s, d).where("kind = 'function'").select("id", "name", "file_path")
    files = n.select("name", "file_path").distinct()
    rare = files.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n < 10")
    near = files.join(rare, "name", "left_semi").select("file_path").distinct().withColumn("points", F.lit(20))
    p = n.join(near, "file_path", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return top_per(p, ["name"], [F.desc("points"), F.col("id")], 3).select("name", "id", "points")


@query("search_cross_repo", "SELECT repo, key, rank::INTEGER AS rank FROM (SELECT repo, key, row_number() OVER (PARTITION BY repo ORDER BY vec_id % 13, key) AS rank FROM v_memories) WHERE rank <= 10")
def cross_repo(s, d):
    m = b.memories(s, d).select("repo", "key", (F.col("vec_id") % 13).alias("score"))
    return top_per(m, ["repo"], [F.col("score"), F.col("key")], 10).select("repo", "key", "rank")


@query("search_generated_last", f"SELECT page_id, (row_number() OVER (ORDER BY regexp_matches(url, '\\.html'), page_id))::INTEGER AS place FROM pages ORDER BY 2 LIMIT 50")
def generated_last(s, d):
    p = b.table(s, d, "pages").select("page_id", F.rlike("url", F.lit("\\.html")).alias("late")).orderBy("late", "page_id").limit(50)
    return p.select("page_id", F.row_number().over(Window.orderBy("late", "page_id")).alias("place"))


@query("search_explore_files", f"SELECT z.file_path, sum(CASE e.kind WHEN 'calls' THEN 10 WHEN 'contains' THEN 3 ELSE 1 END)::BIGINT AS points, count(DISTINCT z.id)::BIGINT AS symbols FROM {E} e JOIN {N} z ON z.id = e.target WHERE NOT regexp_matches(z.file_path, '{score.TEST_PATH}') GROUP BY z.file_path HAVING points >= 3 ORDER BY points DESC, z.file_path LIMIT 40")
def explore_files(s, d):
    w = F.when(F.col("kind") == "calls", 10).when(F.col("kind") == "contains", 3).otherwise(1)
    per = b.edges(s, d).groupBy(F.col("target").alias("id")).agg(F.sum(w).alias("p"))
    n = b.nodes(s, d).select("id", "file_path").where(~score.is_test_path(F.col("file_path")))
    g = per.join(n, "id").groupBy("file_path").agg(F.sum("p").alias("points"), F.count(F.lit(1)).alias("symbols"))
    return g.where("points >= 3").orderBy(F.desc("points"), "file_path").limit(40)


@query("search_symbol_resolution", f"SELECT id, qualified_name FROM {N} WHERE name = 'order_7' OR ends_with(qualified_name, '.order_9') OR ends_with(qualified_name, '.FRANCE')")
def symbol_resolution(s, d):
    hit = (F.col("name") == "order_7") | F.endswith("qualified_name", F.lit(".order_9")) | F.endswith("qualified_name", F.lit(".FRANCE"))
    return b.nodes(s, d).where(hit).select("id", "qualified_name")


@query("search_node_lookup", f"SELECT id, file_path, start_line FROM (SELECT *, rank() OVER (ORDER BY abs(start_line - 500)) AS r FROM {N} WHERE kind = 'function' AND ends_with(file_path, '/t15.py')) WHERE r = 1")
def node_lookup(s, d):
    n = b.nodes(s, d).where((F.col("kind") == "function") & F.endswith("file_path", F.lit("/t15.py"))).select("id", "file_path", "start_line", F.abs(F.col("start_line") - 500).alias("gap"))
    return n.join(F.broadcast(n.agg(F.min("gap").alias("gap"))), "gap").select("id", "file_path", "start_line")


# ---- scalar functions over whole tables ----------------------------------------------------------------------------


@query("fn_topic_words", "SELECT item_id, len(w)::INTEGER AS n, w[1] AS first_word FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3) AS w FROM benchmark)")
def topic_words(s, d):
    w = text.words_of(F.col("text"), 3)
    return b.table(s, d, "benchmark").select("item_id", F.size(w).alias("n"), F.try_element_at(w, F.lit(1)).alias("first_word"))


@query("fn_keyword_count", "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')))::INTEGER AS n FROM documents")
def keyword_count(s, d):
    return b.docs(s, d).select("doc_id", F.size(text.keywords(F.col("text"))).alias("n"))


@query("fn_normal_path", "SELECT page_id, regexp_replace(regexp_replace(lower(trim(regexp_replace(url, '^https?://', ''))), ':.*$', ''), '^/+|/+$', '', 'g') AS path FROM pages")
def normal_path(s, d):
    return b.table(s, d, "pages").select("page_id", text.normal_path(F.regexp_replace("url", "^https?://", "")).alias("path"))


@query("fn_node_identity", f"SELECT id, kind || ':' || sha256(file_path || ':' || kind || ':' || name || ':' || start_line)[1:32] AS node_id FROM {N}")
def node_identity(s, d):
    return b.nodes(s, d).select("id", text.content_id(F.col("kind"), F.col("file_path"), F.col("kind"), F.col("name"), F.col("start_line").cast("string")).alias("node_id"))


@query("fn_safe_key", "SELECT page_id, translate(url, ': /' || chr(92), '____') AS key FROM pages")
def safe_key(s, d):
    return b.table(s, d, "pages").select("page_id", text.safe_key(F.col("url")).alias("key"))


@query("fn_name_token", f"SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS token, regexp_matches(name, '[_0-9]|.[A-Z]') AS distinctive FROM {N}")
def name_token(s, d):
    return b.nodes(s, d).select("id", text.name_token(F.col("name")).alias("token"), text.is_distinctive(F.col("name")).alias("distinctive"))


@query("fn_intent_class", "SELECT conv_id, turn, CASE WHEN contains(t, 'debug') OR contains(t, 'bug') OR contains(t, 'error') OR contains(t, 'fix') OR contains(t, 'crash') OR contains(t, 'panic') OR contains(t, 'nil pointer') OR contains(t, 'why does') OR contains(t, 'broken') OR contains(t, 'failing') OR contains(t, 'failure') OR contains(t, 'wrong') OR contains(t, 'issue') OR contains(t, 'not working') OR contains(t, 'unexpected') THEN 'debug' WHEN contains(t, 'trace') OR contains(t, 'flow') OR contains(t, 'propagate') OR contains(t, 'upstream') OR contains(t, 'downstream') OR contains(t, 'call chain') OR contains(t, 'how does') OR contains(t, 'reach') OR contains(t, 'path from') OR contains(t, 'path to') OR contains(t, 'end to end') OR contains(t, 'e2e') OR contains(t, 'sequence') THEN 'trace' WHEN contains(t, 'refactor') OR contains(t, 'rename') OR contains(t, 'move') OR contains(t, 'impact') OR contains(t, 'what breaks') OR contains(t, 'who uses') OR contains(t, 'who calls') OR contains(t, 'callers of') OR contains(t, 'dependents') OR contains(t, 'breaking change') OR contains(t, 'deprecate') THEN 'refactor' WHEN contains(t, 'what is') OR contains(t, 'explain') OR contains(t, 'understand') OR contains(t, 'overview') OR contains(t, 'how does') OR contains(t, 'describe') OR contains(t, 'summarize') OR contains(t, 'architecture') OR contains(t, 'structure') OR contains(t, 'purpose of') OR contains(t, 'role of') THEN 'explore' ELSE 'general' END AS intent FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations)")
def intent_class(s, d):
    return b.table(s, d, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent"))


@query("fn_summary", "SELECT doc_id, CASE WHEN strpos(t, '. ') > 0 AND strpos(t, '. ') <= 200 THEN substr(t, 1, strpos(t, '. ')) WHEN length(string_split(t, chr(10))[1]) < 200 THEN string_split(t, chr(10))[1] ELSE substr(t, 1, 150) END AS summary FROM (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents)")
def summary(s, d):
    return b.docs(s, d).select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("fn_slice_lines", "SELECT doc_id, substr(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), 1, 65536) AS lines FROM documents")
def slice_lines(s, d):
    return b.docs(s, d).select("doc_id", text.slice_lines(F.col("text"), 2, 3).alias("lines"))


@query("fn_path_proximity", f"SELECT a.id AS a, z.id AS z, least(80, 15 * (CASE WHEN string_split(a.file_path, '/')[2] = string_split(z.file_path, '/')[2] THEN CASE WHEN string_split(a.file_path, '/')[3] = string_split(z.file_path, '/')[3] THEN 3 ELSE 2 END ELSE 1 END))::INTEGER AS points FROM {N} a JOIN {N} z ON a.kind = 'namespace' AND z.kind = 'struct' AND string_split(a.file_path, '/')[1] = string_split(z.file_path, '/')[1]")
def path_proximity(s, d):
    """Every struct against the namespaces, of which there is one for each nation; without a common first folder there are no points."""
    n = b.nodes(s, d).select("id", "kind", "file_path", F.split_part("file_path", F.lit("/"), F.lit(1)).alias("top"))
    a = n.where("kind = 'namespace'").select(F.col("id").alias("a"), F.col("file_path").alias("pa"), "top")
    z = n.where("kind = 'struct'").select(F.col("id").alias("z"), F.col("file_path").alias("pz"), "top")
    return z.join(a, "top").select("a", "z", score.path_proximity(F.col("pa"), F.col("pz")).cast("int").alias("points"))


@query("fn_external_docs", "SELECT event_id, coalesce(json_extract_string(props, '$.id'), json_extract_string(props, '$.k')) AS id, coalesce(json_extract_string(props, '$.title'), event_type) AS title FROM events")
def external_docs(s, d):
    """JSON of unknown shape, mapped by aliases."""
    e = b.table(s, d, "events")
    get = lambda *keys: F.coalesce(*[F.get_json_object("props", f"$.{k}") for k in keys])
    return e.select("event_id", get("id", "key", "k").alias("id"), F.coalesce(get("title", "name"), F.col("event_type")).alias("title"))


_STOP = "['the','a','an','and','or','but','is','in','on','at','to','for','of','with','by','from','as','into','how','what','why','where','when','which','does','do','did','can','could','should','would','will','this','that','these','those','be','been','being','have','has','had','it','its','i','we','you','me','my','about','any','all']"


@query("fn_effective_query", "SELECT conv_id, turn, coalesce(text, '') || CASE WHEN role IS NOT NULL THEN ' ' || role ELSE '' END || CASE WHEN turn > 0 THEN ' t' || turn ELSE '' END AS effective FROM conversations")
def effective_query(s, d):
    """A question with the must and should terms of its plan behind it; here the role, and the turn after the first."""
    t = b.table(s, d, "conversations")
    return t.select("conv_id", "turn", F.concat_ws(" ", F.coalesce("text", F.lit("")), "role", F.when(F.col("turn") > 0, F.concat(F.lit("t"), F.col("turn").cast("string")))).alias("effective"))


@query("fn_model_hint", "SELECT repo, mem_type, CASE WHEN count(*) >= 3 THEN 'cheap' WHEN count(*) >= 1 THEN 'standard' ELSE 'strong' END AS hint FROM v_memories WHERE scope = 'branch' GROUP BY repo, mem_type")
def model_hint(s, d):
    """How strong a model a question asks for, by how many memories answer it already."""
    m = b.memories(s, d).where("scope = 'branch'").groupBy("repo", "mem_type").agg(F.count(F.lit(1)).alias("n"))
    return m.select("repo", "mem_type", F.when(F.col("n") >= 3, "cheap").when(F.col("n") >= 1, "standard").otherwise("strong").alias("hint"))


_RAW = f"list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w))"
_CUT = "regexp_replace(w, '(ings|ing|ers|ed|es|s)$', '')"


@query("fn_query_words", f"""SELECT item_id, list_sort(list_distinct(list_transform({_RAW}, lambda w: CASE WHEN length(w) > 6 AND length({_CUT}) >= 4 AND {_CUT} <> w
THEN CASE WHEN ends_with({_CUT}, 'll') THEN {_CUT}[:-2] ELSE {_CUT} END ELSE w END))) AS words FROM benchmark""")
def query_words(s, d):
    return b.table(s, d, "benchmark").select("item_id", F.array_sort(text.query_words(F.col("text"))).alias("words"))


@query("vector_mean_pool", "SELECT label, list_transform(range(1, 65), lambda i: round(list_sum(list_transform(v, lambda x: x[i]::DOUBLE)) / len(v), 6)) AS pooled FROM (SELECT label, list(embedding ORDER BY vec_id) AS v FROM embeddings GROUP BY label)")
def mean_pool(s, d):
    """The mean of each component over the vectors of a label, summed a component at a time, so that no list of vectors is gathered."""
    e = b.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    m = e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("pooled"))

"""The engine's inputs (graph, memories, traces, corpus), derived from the given tables. Each view is a DataFrame that reads
only the columns it needs; DUCK holds the same definitions in SQL for the oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types and the intents that they stand for.
INTENT_OF = {"click": "trace", "error": "debug", "purchase": "refactor", "signup": "general", "view": "explore"}
MEM_TYPES = ("file", "func", "flow", "decision")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, col: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each symbol: modules, namespaces, classes, structs, functions and methods."""
    t = lambda n: table(spark, sf_dir, n)
    s = lambda c: F.col(c).cast("string")
    line = lambda c: (F.col(c) % 1000 + 1).cast("int")
    place = t("nation").select(F.col("n_nationkey").alias("nk"), "n_name", F.concat(F.lit("world/"), s("n_regionkey"), F.lit("/"), s("n_nationkey")).alias("dir"))

    def row(df, kind, key, name, qname, path, language, start, signature, docstring, exported):
        return df.select(
            _key(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qname.alias("qualified_name"), path.alias("file_path"), F.lit(language).alias("language"),
            start.alias("start_line"), (start + 9).alias("end_line"), signature.alias("signature"), docstring.alias("docstring"), exported.alias("is_exported"),
        )

    none, one = F.lit(None).cast("string"), F.lit(1)
    test = F.when(F.col("p_size") % 7 == 0, F.lit("test_")).otherwise(F.lit(""))
    parts = [
        row(t("region"), "module", "r_regionkey", F.col("r_name"), F.col("r_name"), F.concat(F.lit("world/"), s("r_regionkey"), F.lit("/mod.go")), "go", one, none, none, F.lit(True)),
        row(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")), "namespace", "n_nationkey", F.col("n_name"), F.concat_ws(".", "r_name", "n_name"),
            F.concat(F.lit("world/"), s("n_regionkey"), F.lit("/"), s("n_nationkey"), F.lit("/ns.go")), "go", one, none, none, F.lit(True)),
        row(t("customer").join(F.broadcast(place), F.col("c_nationkey") == F.col("nk")), "class", "c_custkey", F.col("c_name"), F.concat_ws(".", "n_name", "c_name"),
            F.concat("dir", F.lit("/c"), (F.col("c_custkey") % 20).cast("string"), F.lit(".java")), "java", line("c_custkey"), none, F.col("c_mktsegment"), F.col("c_acctbal") > 0),
        row(t("supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("nk")), "struct", "s_suppkey", F.col("s_name"), F.concat_ws(".", "n_name", "s_name"),
            F.concat("dir", F.lit("/s"), (F.col("s_suppkey") % 10).cast("string"), F.lit(".go")), "go", line("s_suppkey"), none, none, F.col("s_acctbal") > 0),
        row(t("part"), "function", "p_partkey", F.col("p_name"), F.concat_ws(".", "p_brand", "p_name"),
            F.concat(F.lit("parts/"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("/"), test, F.lit("t"), s("p_size"), F.lit(".py")), "python", line("p_partkey"), F.col("p_type"), F.col("p_brand"), F.col("p_size") % 2 == 0),
        row(t("orders"), "method", "o_orderkey", F.concat(F.lit("order_"), s("o_orderkey")), F.concat(F.lit("c"), s("o_custkey"), F.lit(".order_"), s("o_orderkey")),
            F.concat(F.lit("orders/"), F.date_format("o_orderdate", "yyyy/MM"), F.lit(".java")), "java", line("o_orderkey"), F.col("o_orderpriority"), none, F.col("o_orderstatus") == "F"),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("contains", "calls", "references")) -> DataFrame:
    """Directed multigraph. Only the tables of the asked kinds are read."""
    t = lambda n: table(spark, sf_dir, n)
    parts = []

    def contains(df, a, ka, b, kb):
        return df.select(_key(a, ka).alias("source"), _key(b, kb).alias("target"), F.lit("contains").alias("kind"), F.lit(1).alias("line"))

    if "contains" in kinds:
        parts += [
            contains(t("nation"), "module", "n_regionkey", "namespace", "n_nationkey"), contains(t("customer"), "namespace", "c_nationkey", "class", "c_custkey"),
            contains(t("supplier"), "namespace", "s_nationkey", "struct", "s_suppkey"), contains(t("orders"), "class", "o_custkey", "method", "o_orderkey"),
        ]
    if "calls" in kinds:
        parts.append(t("lineitem").select(_key("method", "l_orderkey").alias("source"), _key("function", "l_partkey").alias("target"), F.lit("calls").alias("kind"), F.col("l_linenumber").cast("int").alias("line")))
    if "references" in kinds:
        pairs = t("lineitem").select("l_partkey", "l_suppkey").distinct()
        parts.append(pairs.select(_key("function", "l_partkey").alias("source"), _key("struct", "l_suppkey").alias("target"), F.lit("references").alias("kind"), F.lit(1).alias("line")))
    return reduce(DataFrame.unionByName, parts)


def nation_dep(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """(source, target): each customer nation's top supplier nations by revenue; sparse and cyclic."""
    from pyspark.sql import Window

    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("rev"))
    per_order = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rev = per_order.groupBy("o_custkey", "l_suppkey").agg(F.sum("rev").alias("rev"))
    rev = rev.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    by = rev.groupBy(F.col("c_nationkey").cast("long").alias("source"), F.col("s_nationkey").cast("long").alias("target")).agg(F.sum("rev").alias("rev")).where("source <> target")
    best = Window.partitionBy("source").orderBy(F.desc("rev"), "target")
    return by.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= top).select("source", "target")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, href, pos): links of each page, in order."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("pos", "href"))
    return p


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    kind = F.element_at(F.array(*[F.lit(m) for m in MEM_TYPES]), (F.col("vec_id") % 4 + 1).cast("int"))
    source = F.when(F.col("vec_id") % 3 == 0, "agent").when(F.col("vec_id") % 3 == 1, "auto").otherwise("import")
    return e.select(
        F.concat(F.lit("mem:"), F.col("vec_id").cast("string")).alias("key"), "vec_id", kind.alias("mem_type"), F.concat(F.lit("r"), F.col("label").cast("string")).alias("repo"),
        F.when(F.col("vec_id") % 5 == 0, "branch").otherwise("global").alias("scope"), source.alias("source"), "embedding", F.concat(F.lit("src/"), (F.col("vec_id") % 50).cast("string"), F.lit(".go")).alias("file"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each query event, with the counters that its feedback reports."""
    e = table(spark, sf_dir, "events")
    intent = F.element_at(F.create_map(*[F.lit(x) for kv in INTENT_OF.items() for x in kv]), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", "ts", intent.alias("intent"), F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo"), "user_id", "event_type",
        F.coalesce(k % 8, F.lit(0)).alias("additional_files"), (F.col("user_id") % 3).alias("revisits"), F.floor(F.col("value") * 100).cast("long").alias("prompt_tokens"), F.coalesce(k, F.lit(0)).alias("k"),
    )


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with their raw reward."""
    from glyphmill.functions.score import raw_reward

    return traces(spark, sf_dir).withColumn("raw", raw_reward(F.col("additional_files"), F.col("prompt_tokens"), F.col("revisits"), F.lit(0)))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("name"), "doc_id", F.col("lang").alias("decision_type"), F.col("source").alias("scope"), F.concat(F.lit("r"), (F.col("doc_id") % 10).cast("string")).alias("repo"),
        F.array(F.concat(F.lit("src/"), (F.col("doc_id") % 50).cast("string")), F.concat(F.lit("lib/"), (F.col("doc_id") % 30).cast("string"))).alias("files"),
        F.when(F.col("doc_id") % 7 == 0, (F.col("doc_id") - 7).cast("string")).alias("supersedes"),
        F.when(F.col("doc_id") % 11 == 0, "superseded").otherwise("active").alias("status"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


# The same views for DuckDB; names are prefixed with v_ so that they don't meet the tables.
_PLACE = "'world/' || n_regionkey || '/' || n_nationkey"
DUCK_VIEWS = {
    "v_nodes": f"""
SELECT 'module:' || r_regionkey AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name, 'world/' || r_regionkey || '/mod.go' AS file_path, 'go' AS language,
  1 AS start_line, 10 AS end_line, NULL::VARCHAR AS signature, NULL::VARCHAR AS docstring, true AS is_exported FROM region
UNION ALL SELECT 'namespace:' || n_nationkey, 'namespace', n_name, r_name || '.' || n_name, {_PLACE} || '/ns.go', 'go', 1, 10, NULL, NULL, true FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'class:' || c_custkey, 'class', c_name, n_name || '.' || c_name, {_PLACE} || '/c' || (c_custkey % 20) || '.java', 'java', (c_custkey % 1000 + 1)::INTEGER, (c_custkey % 1000 + 10)::INTEGER, NULL, c_mktsegment, c_acctbal > 0
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'struct:' || s_suppkey, 'struct', s_name, n_name || '.' || s_name, {_PLACE} || '/s' || (s_suppkey % 10) || '.go', 'go', (s_suppkey % 1000 + 1)::INTEGER, (s_suppkey % 1000 + 10)::INTEGER, NULL, NULL, s_acctbal > 0
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'function:' || p_partkey, 'function', p_name, p_brand || '.' || p_name, 'parts/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '/' || CASE WHEN p_size % 7 = 0 THEN 'test_' ELSE '' END || 't' || p_size || '.py',
  'python', (p_partkey % 1000 + 1)::INTEGER, (p_partkey % 1000 + 10)::INTEGER, p_type, p_brand, p_size % 2 = 0 FROM part
UNION ALL SELECT 'method:' || o_orderkey, 'method', 'order_' || o_orderkey, 'c' || o_custkey || '.order_' || o_orderkey, 'orders/' || strftime(o_orderdate, '%Y/%m') || '.java', 'java', (o_orderkey % 1000 + 1)::INTEGER, (o_orderkey % 1000 + 10)::INTEGER,
  o_orderpriority, NULL, o_orderstatus = 'F' FROM orders""",
    "v_edges": """
SELECT 'module:' || n_regionkey AS source, 'namespace:' || n_nationkey AS target, 'contains' AS kind, 1 AS line FROM nation
UNION ALL SELECT 'namespace:' || c_nationkey, 'class:' || c_custkey, 'contains', 1 FROM customer
UNION ALL SELECT 'namespace:' || s_nationkey, 'struct:' || s_suppkey, 'contains', 1 FROM supplier
UNION ALL SELECT 'class:' || o_custkey, 'method:' || o_orderkey, 'contains', 1 FROM orders
UNION ALL SELECT 'method:' || l_orderkey, 'function:' || l_partkey, 'calls', l_linenumber FROM lineitem
UNION ALL SELECT 'function:' || l_partkey, 'struct:' || l_suppkey, 'references', 1 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""",
    "v_nation_dep": """
SELECT source, target FROM (
  SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY rev DESC, target) AS rn FROM (
    SELECT c_nationkey::BIGINT AS source, s_nationkey::BIGINT AS target, sum(round(l_extendedprice * 100)::BIGINT) AS rev
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)) WHERE rn <= 3""",
    "v_routes": """SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages)""",
    "v_memories": """
SELECT 'mem:' || vec_id AS key, vec_id, ['file','func','flow','decision'][(vec_id % 4 + 1)::INTEGER] AS mem_type, 'r' || label AS repo, CASE WHEN vec_id % 5 = 0 THEN 'branch' ELSE 'global' END AS scope,
  CASE vec_id % 3 WHEN 0 THEN 'agent' WHEN 1 THEN 'auto' ELSE 'import' END AS source, embedding, 'src/' || (vec_id % 50) || '.go' AS file FROM embeddings""",
    "v_traces": """
SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'trace' WHEN 'error' THEN 'debug' WHEN 'purchase' THEN 'refactor' WHEN 'signup' THEN 'general' WHEN 'view' THEN 'explore' END AS intent,
  'r' || (user_id % 10) AS repo, user_id, event_type, coalesce(json_extract(props, '$.k')::BIGINT % 8, 0) AS additional_files, user_id % 3 AS revisits, floor(value * 100)::BIGINT AS prompt_tokens,
  coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k FROM events""",
    "v_rewards": """
SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - 0.15::DOUBLE * additional_files - 0.00002::DOUBLE * prompt_tokens - 0.05::DOUBLE * revisits)) AS raw FROM v_traces""",
    "v_decisions": """
SELECT doc_id::VARCHAR AS name, doc_id, lang AS decision_type, source AS scope, 'r' || (doc_id % 10) AS repo, ['src/' || (doc_id % 50), 'lib/' || (doc_id % 30)] AS files,
  CASE WHEN doc_id % 7 = 0 THEN (doc_id - 7)::VARCHAR END AS supersedes, CASE WHEN doc_id % 11 = 0 THEN 'superseded' ELSE 'active' END AS status FROM documents""",
}


def duck(sql: str) -> str:
    """sql with the views that it names put before it, those that they need first."""
    used: list[str] = []

    def need(text: str) -> None:
        for name, body in DUCK_VIEWS.items():
            if name in text and name not in used:
                need(body)
                if name not in used:
                    used.append(name)

    need(sql)
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({DUCK_VIEWS[v]})" for v in used)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = body.split(None, 2 if recursive else 1)[-1]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body}"
    return f"WITH {head} {body}"

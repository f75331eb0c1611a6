"""Import and resolution queries over source files that are put together from the given tables: one file for each order,
with an import for each of its lines, and one file for each size class of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import source
from glyphmill.operators import resolution
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

N = "v_nodes"
LANGUAGES = ("javascript", "python", "java")
_LANGUAGE = "CASE l_orderkey % 3 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' ELSE 'java' END"
_LINES = f"(SELECT l_orderkey, l_linenumber, l_partkey, {_LANGUAGE} AS language FROM lineitem)"


def order_files(s, d) -> DataFrame:
    """(path, language, content): imports of the parts that an order calls, among comments and strings that look like some."""
    li = b.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ln"), F.col("l_partkey").cast("string").alias("p"), (F.col("l_partkey") % 50).cast("string").alias("m"))
    kind = F.col("l_orderkey") % 3
    n = F.col("ln").cast("string")
    js = F.concat(F.lit("import { part_"), "p", F.lit(" as p"), n, F.lit(" } from '../parts/t"), "m", F.lit("'; // import { ghost } from './none'"))
    py = F.concat(F.lit("from parts.t"), "m", F.lit(" import part_"), "p", F.lit(" as p"), n, F.lit("  # from ghost import it"))
    java = F.concat(F.lit("import parts.t"), "m", F.lit(".part_"), "p", F.lit(";"))
    line = F.when(kind == 0, js).when(kind == 1, py).otherwise(java)
    # an order has few lines, so that its file is small whatever the scale
    body = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", line.alias("x")))), lambda e: e["x"]), "\n").alias("body"))
    head = F.when(kind == 0, "/* import ghost from './a'\n * end */\nconst s = \"// import\";\n").when(kind == 1, '"""\nfrom ghost import docs\n"""\ns = "# no comment"\n').otherwise("/*\nimport ghost.A;\n*/\nString s = \"/* no\";\n")
    ext = F.when(kind == 0, ".js").when(kind == 1, ".py").otherwise(".java")
    language = F.when(kind == 0, "javascript").when(kind == 1, "python").otherwise("java")
    return body.select(F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"), ext).alias("path"), language.alias("language"), F.concat(head, "body").alias("content"))


def part_files(s, d) -> DataFrame:
    """(path): where the imports can lead; each third class is a folder with an index, and none has a Java file."""
    m = b.table(s, d, "part").select((F.col("p_partkey") % 50).alias("m")).distinct()
    base = F.concat(F.lit("parts/t"), F.col("m").cast("string"))
    js = F.when(F.col("m") % 3 == 0, F.concat(base, F.lit("/index.ts"))).when(F.col("m") % 3 == 1, F.concat(base, F.lit(".ts"))).otherwise(F.concat(base, F.lit(".js")))
    return m.select(F.explode(F.array(js, F.when(F.col("m") % 2 == 0, F.concat(base, F.lit(".py"))).otherwise(F.concat(base, F.lit("/__init__.py"))))).alias("path"))


_PATH = "'orders/o' || l_orderkey || CASE language WHEN 'javascript' THEN '.js' WHEN 'python' THEN '.py' ELSE '.java' END"


@query("scan_strip_comments", f"SELECT DISTINCT {_PATH} AS path, false AS has_ghost, true AS keeps_string FROM {_LINES}")
def strip_comments(s, d):
    """Nothing of a comment is left, what a string holds is, and offsets stay: the length is that of the source."""
    f = order_files(s, d)
    clean = F.when(F.col("language") == LANGUAGES[0], source.without_comments(F.col("content"), LANGUAGES[0]))
    for lang in LANGUAGES[1:]:
        clean = clean.when(F.col("language") == lang, source.without_comments(F.col("content"), lang))
    f = f.withColumn("clean", clean)
    string = F.when(F.col("language") == "javascript", "// import").when(F.col("language") == "python", "# no comment").otherwise("/* no")
    return f.select("path", F.contains("clean", F.lit("ghost")).alias("has_ghost"), (F.contains("clean", string) & (F.length("clean") == F.length("content"))).alias("keeps_string"))


@query("resolve_import_mappings", f"""
SELECT {_PATH} AS path, CASE WHEN language = 'java' THEN 'part_' || l_partkey ELSE 'p' || l_linenumber END AS local, 'part_' || l_partkey AS exported,
  CASE language WHEN 'javascript' THEN '../parts/t' ELSE 'parts.t' END || (l_partkey % 50) AS source FROM {_LINES}""")
def import_mappings(s, d):
    return resolution.import_mappings(order_files(s, d), LANGUAGES).select("path", "local", "exported", "source")


@query("resolve_import_paths", f"""
SELECT DISTINCT {_PATH} AS path, CASE language WHEN 'javascript' THEN '../parts/t' ELSE 'parts.t' END || m AS source,
  CASE language WHEN 'javascript' THEN 'parts/t' || m || CASE m % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.ts' ELSE '.js' END WHEN 'python' THEN 'parts/t' || m || CASE m % 2 WHEN 0 THEN '.py' ELSE '/__init__.py' END END AS target
FROM (SELECT *, l_partkey % 50 AS m FROM {_LINES})""")
def import_paths(s, d):
    found = resolution.import_mappings(order_files(s, d), LANGUAGES)
    return resolution.resolved_imports(found, part_files(s, d)).select("path", "source", "target")


@query("resolve_reexports", """
WITH RECURSIVE ex AS (SELECT source, min(target) AS target FROM v_nation_dep GROUP BY source), walk(file, here, hops) AS (
  SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation UNION SELECT file, target, hops + 1 FROM walk JOIN ex ON source = here WHERE hops < 8)
SELECT file, arg_min(here, (hops, here)) AS at_file, min(hops)::INTEGER AS hops FROM walk WHERE here % 4 = 0 GROUP BY file""")
def reexports(s, d):
    """Each nation imports one name that every fourth defines; the others give it on from the first nation that they depend on."""
    nation = b.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("file"), F.lit("it").alias("name"))
    ex = b.nation_dep(s, d).groupBy(F.col("source").alias("file")).agg(F.min("target").alias("target")).withColumns({"local": F.lit("*"), "exported": F.lit("*")})
    return resolution.through_reexports(nation, ex, nation.where("file % 4 = 0")).select("file", "at_file", "hops")


@query("resolve_chain_calls", """
WITH RECURSIVE up AS (SELECT DISTINCT source, target FROM v_nation_dep WHERE source < target), walk(t, owner, hops) AS (
  SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation UNION SELECT t, target, hops + 1 FROM walk JOIN up ON source = owner WHERE hops < 4),
own AS (SELECT DISTINCT s_nationkey::BIGINT AS owner, s_suppkey % 7 AS member FROM supplier), c AS (SELECT DISTINCT c_nationkey::BIGINT AS t, c_custkey % 7 AS member FROM customer)
SELECT c.t AS "type", c.member, arg_min(walk.owner, (hops, walk.owner)) AS owner, min(hops)::INTEGER AS hops FROM c JOIN walk ON walk.t = c.t JOIN own ON own.owner = walk.owner AND own.member = c.member GROUP BY ALL""")
def chain_calls(s, d):
    calls = b.table(s, d, "customer").select(F.col("c_nationkey").cast("long").alias("type"), (F.col("c_custkey") % 7).alias("member"))
    members = b.table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("owner"), (F.col("s_suppkey") % 7).alias("member"))
    above = b.nation_dep(s, d).where("source < target").select(F.col("source").alias("sub"), F.col("target").alias("super"))
    return resolution.inherited_members(calls, members, above)


_SHARED = "least(80, 15 * CASE WHEN a.p1 <> z.p1 THEN 0 WHEN a.p2 <> z.p2 THEN 1 ELSE 2 END)"


@query("resolve_qualified_nearest", f"""
WITH n AS (SELECT id, name, string_split(file_path, '/')[1] AS p1, string_split(file_path, '/')[2] AS p2, file_path FROM {N} WHERE kind = 'function'),
z AS (SELECT name, file_path, p1, p2, min(id) AS target FROM n GROUP BY ALL),
j AS (SELECT a.id AS ref, z.target, {_SHARED} AS points FROM n a JOIN z ON a.name = z.name)
SELECT ref, arg_min(target, (-points, target)) AS target, max(points)::INTEGER AS points FROM j GROUP BY ref""")
def qualified_nearest(s, d):
    """Of the definitions of a name, that in the closest folder; definitions of a file count once."""
    n = b.nodes(s, d).where("kind = 'function'").select("id", "name", "file_path")
    return resolution.nearest_by_folder(n.select(F.col("id").alias("ref"), "name", "file_path"), n.withColumnRenamed("id", "target"), ["name"])


@query("resolve_file_path_match", f"""
WITH f AS (SELECT DISTINCT file_path, string_split(file_path, '/')[-1] AS base FROM {N}), k AS (SELECT base, count(*) AS n FROM f GROUP BY base),
r AS (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN file_path WHEN 1 THEN regexp_replace(file_path, '^[^/]*/', '') ELSE base END AS ref FROM f JOIN part ON file_path = 'parts/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '/' || CASE WHEN p_size % 7 = 0 THEN 'test_' ELSE '' END || 't' || p_size || '.py'),
j AS (SELECT ref, file_path, CASE WHEN file_path = ref THEN 0.95::DOUBLE WHEN contains(ref, '/') AND ends_with(file_path, '/' || ref) THEN 0.85::DOUBLE WHEN n = 1 THEN 0.7::DOUBLE END AS confidence FROM r JOIN f ON base = string_split(ref, '/')[-1] JOIN k USING (base))
SELECT ref, arg_min(file_path, (-confidence, file_path)) AS target, max(confidence) AS confidence FROM j WHERE confidence IS NOT NULL GROUP BY ref""")
def file_path_match(s, d):
    """A reference by path: the exact file, then one that ends with it, then the only file of its name."""
    n = b.nodes(s, d)
    files = n.select("file_path").distinct().withColumn("base", F.element_at(F.split("file_path", "/"), -1))
    alone = files.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    part = n.where("kind = 'function'").select("file_path", F.regexp_extract("file_path", "t(\\d+)\\.py$", 1).cast("int").alias("size")).distinct()
    ref = F.when(F.col("size") % 3 == 0, F.col("file_path")).when(F.col("size") % 3 == 1, F.regexp_replace("file_path", "^[^/]*/", "")).otherwise(F.element_at(F.split("file_path", "/"), -1))
    refs = part.select(ref.alias("ref")).distinct().withColumn("base", F.element_at(F.split("ref", "/"), -1))
    j = refs.join(files, "base").join(alone, "base")
    tail = F.contains("ref", F.lit("/")) & F.endswith(F.col("file_path"), F.concat(F.lit("/"), "ref"))
    sure = F.when(F.col("file_path") == F.col("ref"), 0.95).when(tail, 0.85).when(F.col("n") == 1, 0.7)
    best = j.withColumn("c", sure).where("c is not null").groupBy("ref").agg(F.min(F.struct((-F.col("c")).alias("less"), "file_path")).alias("m"))
    return best.select("ref", F.col("m.file_path").alias("target"), (-F.col("m.less")).alias("confidence"))

"""Files to symbols: guards, change detection and pattern extractors. Patterns are data; one operator applies them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

MAX_FILE_BYTES = 1 << 20
#: Folders that are never scanned.
IGNORED_DIRS = ("node_modules", ".git", "dist", "build", "target", "vendor", "__pycache__", ".venv", "out", "coverage")
#: Framework, kind of node, pattern with the name in its first group.
PATTERNS = (
    ("express", "route", "\\b(?:app|router)\\.(?:get|post|put|delete|patch|use|all)\\(\\s*['\"]([^'\"]+)['\"]"), ("flask", "route", "@\\w+\\.(?:route|get|post|put|delete|patch)\\(\\s*['\"]([^'\"]+)['\"]"),
    ("django", "route", "\\b(?:path|re_path|url)\\(\\s*r?['\"]([^'\"]+)['\"]"), ("spring", "route", "@(?:Request|Get|Post|Put|Delete|Patch)Mapping\\(\\s*(?:value\\s*=\\s*)?['\"]([^'\"]+)['\"]"),
    ("rails", "route", "\\b(?:get|post|put|patch|delete)\\s+['\"]([^'\"]+)['\"]\\s*,\\s*to:"), ("laravel", "route", "Route::(?:get|post|put|patch|delete|any|resource)\\(\\s*['\"]([^'\"]+)['\"]"),
    ("go", "route", "\\.(?:GET|POST|PUT|DELETE|PATCH|Handle|HandleFunc)\\(\\s*['\"]([^'\"]+)['\"]"), ("rust", "route", "#\\[(?:get|post|put|delete|patch)\\(\\s*['\"]([^'\"]+)['\"]"),
    ("aspnet", "route", "(?:\\[Http(?:Get|Post|Put|Delete|Patch)\\(|\\.Map(?:Get|Post|Put|Delete|Patch)\\()\\s*['\"]([^'\"]+)['\"]"), ("react", "route", "<Route[^>]*\\bpath=['\"]([^'\"]+)['\"]"),
    ("html", "link", "<a[^>]*\\bhref=\"([^\"]+)\""), ("html", "script", "<script[^>]*\\bsrc=\"([^\"]+)\""), ("html", "call", "\\b([A-Za-z_]\\w*)\\(\\d+\\)"),
    ("python", "function", "(?m)^\\s*(?:async\\s+)?def\\s+(\\w+)"), ("python", "class", "(?m)^class\\s+(\\w+)"), ("go", "function", "(?m)^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)"), ("java", "class", "\\bclass\\s+([A-Z]\\w+)\\s*(?:extends|implements|\\{)"),
    ("js", "import", "\\bimport\\s+[^'\"]*['\"]([^'\"]+)['\"]"), ("js", "import", "\\brequire\\(\\s*['\"]([^'\"]+)['\"]\\)"), ("python", "import", "(?m)^from\\s+([\\w.]+)\\s+import"), ("c", "import", "(?m)^#include\\s+[<\"]([^>\"]+)[>\"]"),
    ("fastapi", "route", "@\\w+\\.(?:api_route|websocket)\\(\\s*['\"]([^'\"]+)['\"]"), ("play", "route", "(?m)^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)[ \\t]+(/\\S*)[ \\t]+[\\w.@]+"),
    ("drupal", "route", "(?m)^[ \\t]+path:[ \\t]*['\"]?(/[^'\"\\s]*)"), ("drupal", "hook", "(?m)^function[ \\t]+(\\w+_(?:menu|theme|form_alter|entity_\\w+|node_\\w+|preprocess\\w*|install|cron))\\("),
    ("nestjs", "message", "@(?:MessagePattern|EventPattern|SubscribeMessage)\\(\\s*['\"]([^'\"]+)['\"]"), ("spring", "constant", "@Value\\(\\s*['\"]\\$\\{([^}:'\"]+)"), ("spring", "constant", "@ConfigurationProperties\\(\\s*(?:prefix\\s*=\\s*)?['\"]([^'\"]+)['\"]"),
    ("actix", "route", "\\b(?:web::resource|\\.route)\\(\\s*['\"]([^'\"]+)['\"]"), ("vapor", "route", "\\b(?:app|routes|grouped)\\.(?:get|post|put|delete|patch)\\(\\s*['\"]([^'\"]+)['\"]"),
    ("react", "component", "(?m)^[ \\t]*(?:export[ \\t]+)?(?:default[ \\t]+)?function[ \\t]+([A-Z]\\w*)[ \\t]*\\("), ("react", "component", "(?m)^[ \\t]*(?:export[ \\t]+)?const[ \\t]+([A-Z]\\w*)[ \\t]*(?::[^=\\n]+)?=[ \\t]*(?:\\([^)\\n]*\\)|\\w+)[ \\t]*=>"), ("react", "function", "\\b(?:function|const)[ \\t]+(use[A-Z]\\w*)"),
    ("swiftui", "component", "\\bstruct[ \\t]+(\\w+)[ \\t]*:[ \\t]*(?:\\w+,[ \\t]*)*(?:View|App)\\b"), ("uikit", "class", "\\bclass[ \\t]+(\\w+)[ \\t]*:[ \\t]*UI\\w*(?:ViewController|View)\\b"), ("react-native", "method", "\\bRCT_EXPORT_METHOD\\(\\s*(\\w+)"),
    ("expo", "method", "\\b(?:Async)?Function\\(\\s*['\"]([^'\"]+)['\"]"), ("fabric", "property", "@ReactProp\\(\\s*name\\s*=\\s*['\"]([^'\"]+)['\"]"), ("razor", "route", "(?m)^@page[ \\t]+['\"]([^'\"]+)['\"]"), ("razor", "component", "(?m)^@(?:inject|model)[ \\t]+([\\w.]+)"),
    ("liquid", "import", "\\{%-?[ \\t]*(?:include|render|section|layout)[ \\t]+['\"]([^'\"]+)['\"]"), ("mybatis", "method", "<(?:select|insert|update|delete)[^>]*\\bid=['\"](\\w+)['\"]"), ("mybatis", "class", "<mapper[^>]*\\bnamespace=['\"]([\\w.]+)['\"]"),
    ("dfm", "component", "(?mi)^[ \\t]*(?:object|inherited|inline)[ \\t]+(\\w+)[ \\t]*:[ \\t]*\\w+"), ("vue", "component", "<([A-Z]\\w+|[a-z]+-[a-z-]+)[\\s/>]"), ("cargo", "module", "(?m)^members[ \\t]*=[ \\t]*\\[[ \\t\\n]*['\"]([^'\"]+)['\"]"),
)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, size, modified): text files below a folder, without ignored folders, large or non-UTF-8 files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(F.col("length") <= MAX_FILE_BYTES).where(~F.rlike("path", F.lit("/(" + "|".join(d.replace(".", "\\.") for d in IGNORED_DIRS) + ")/")))
    return kept.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def extracted(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, framework, kind, name): every pattern over every file, one row for each hit."""

    def hits(framework: str, kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(F.col(content), F.lit("")), F.lit(pattern), 1), lambda n: F.struct(F.lit(framework).alias("framework"), F.lit(kind).alias("kind"), n.alias("name")))

    found = files.select(F.col(path).alias("path"), F.concat(*[hits(*p) for p in PATTERNS]).alias("all"))
    return found.select("path", F.explode("all").alias("h")).select("path", "h.*")


def prefixed_routes(files: DataFrame, path: str, content: str, owner: str, member: str) -> DataFrame:
    """(path, route): routes of members joined to the prefix of the class before them.

    owner: pattern of a class mark, member: of a member's mark; each has the verb's place in it and the route as its first group. The
    text is cut at class marks, so that a member belongs to the class that it follows; members before any class have no prefix.
    """
    mark = "\u0001"
    parts = F.split(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), owner, f"{mark}$1{mark}"), mark)
    # after the cut, even places hold texts and odd ones the prefix of the text that follows
    pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(F.when(i > 0, F.get(parts, i - 1)).otherwise("").alias("prefix"), F.get(parts, i).alias("body")))
    found = F.flatten(F.transform(pairs, lambda p: F.transform(F.regexp_extract_all(p["body"], F.lit(member), 1), lambda m: F.concat_ws("/", F.nullif(F.trim(p["prefix"], F.lit("/")), F.lit("")), F.nullif(F.trim(m, F.lit("/")), F.lit(""))))))
    return files.select(F.col(path).alias("path"), F.explode(found).alias("route")).select("path", F.concat(F.lit("/"), "route").alias("route"))


#: Marks of controllers with a prefix and of their members.
NEST = ("@Controller\\(\\s*(?:['\"]([^'\"]*)['\"])?\\s*\\)", "@(?:Get|Post|Put|Delete|Patch|All)\\(\\s*(?:['\"]([^'\"]*)['\"])?\\s*\\)")
#: What a resource declaration stands for: verb and the end of the path.
RESOURCE = (("GET", ""), ("GET", "/create"), ("POST", ""), ("GET", "/{id}"), ("GET", "/{id}/edit"), ("PUT", "/{id}"), ("DELETE", "/{id}"))


def resource_routes(names: DataFrame, name: str) -> DataFrame:
    """The routes that a resource declaration (its name) stands for."""
    kinds = F.array(*[F.struct(F.lit(v).alias("verb"), F.lit(p).alias("tail")) for v, p in RESOURCE])
    return names.withColumn("_r", F.explode(kinds)).select(*names.columns, F.col("_r.verb").alias("verb"), F.concat(F.lit("/"), F.col(name), F.col("_r.tail")).alias("route"))


def embedded_blocks(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, block, place, body): script, style and template bodies of single-file components and pages, in order of their kind."""
    text_ = F.coalesce(F.col(content), F.lit(""))

    def bodies(kind: str) -> Column:
        found = F.regexp_extract_all(text_, F.lit(f"<{kind}(?:\\s[^>]*)?>([\\s\\S]*?)</{kind}>"), 1)
        return F.transform(found, lambda x, i: F.struct(F.lit(kind).alias("block"), i.alias("place"), x.alias("body")))

    kinds = F.concat(*[bodies(k) for k in ("script", "style", "template")])
    return files.select(F.col(path).alias("path"), F.explode(kinds).alias("b")).select("path", "b.*")


def changes(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed, by hash. Both have path and hash."""
    a, z = tracked.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(z, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


@query("scan_extract_patterns", "SELECT page_id AS path, 'link' AS kind, count(*)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*\\bhref=\"([^\"]+)\"', 1)) FROM pages) GROUP BY page_id UNION ALL SELECT page_id, 'call', count(*) FROM (SELECT page_id, unnest(regexp_extract_all(html, '\\b([A-Za-z_]\\w*)\\(\\d+\\)', 1)) FROM pages) GROUP BY page_id")
def extract_patterns(s, d):
    hits = extracted(b.table(s, d, "pages").select("page_id", "html"), "page_id", "html")
    return hits.where(F.col("kind").isin("link", "call")).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("scan_embedded_blocks", "SELECT page_id AS path, block, (unnest(p) - 1)::INTEGER AS place, length(unnest(x))::INTEGER AS chars FROM (SELECT page_id, block, x, range(1, len(x) + 1) AS p FROM (SELECT page_id, 'script' AS block, regexp_extract_all(html, '<script(?:\\s[^>]*)?>([\\s\\S]*?)</script>', 1) AS x FROM pages UNION ALL SELECT page_id, 'style', regexp_extract_all(html, '<style(?:\\s[^>]*)?>([\\s\\S]*?)</style>', 1) FROM pages UNION ALL SELECT page_id, 'template', regexp_extract_all(html, '<template(?:\\s[^>]*)?>([\\s\\S]*?)</template>', 1) FROM pages))")
def embedded(s, d):
    out = embedded_blocks(b.table(s, d, "pages").select("page_id", "html"), "page_id", "html")
    return out.select("path", "block", "place", F.length("body").alias("chars"))


@query("scan_resource_routes", "SELECT r.r_name, v.verb, '/' || lower(r.r_name) || '/' || n.n_name || v.tail AS route FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey, (VALUES ('GET', ''), ('GET', '/create'), ('POST', ''), ('GET', '/{id}'), ('GET', '/{id}/edit'), ('PUT', '/{id}'), ('DELETE', '/{id}')) v(verb, tail)")
def resources(s, d):
    """One resource for each nation, below its region."""
    n = b.table(s, d, "nation").join(F.broadcast(b.table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return resource_routes(n.select("r_name", F.concat(F.lower("r_name"), F.lit("/"), "n_name").alias("name")), "name").select("r_name", "verb", "route")


@query("scan_prefixed_routes", "SELECT n_nationkey AS path, '/' || lower(n_name) || '/c' || c_custkey AS route FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT n_nationkey, '/' || lower(n_name) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'")
def prefixed(s, d):
    """A controller file for each customer, put together from its row; the routes of a market segment name it, or the controller alone."""
    c = b.table(s, d, "customer").join(F.broadcast(b.table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("@Get('c"), F.col("c_custkey").cast("string"), F.lit("') one() {}"))).when(F.col("c_mktsegment") == "MACHINERY", "@Post() all() {}").otherwise("none() {}")
    code = F.concat(F.lit("import x\n@Controller('"), F.lower("n_name"), F.lit("')\nexport class C {\n  "), own, F.lit("\n}\n"))
    return prefixed_routes(c.select("n_nationkey", code.alias("content")), "n_nationkey", "content", *NEST)


@query("scan_sync_changes", "WITH old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(old.doc_id, new.doc_id) AS path, CASE WHEN old.h IS NULL THEN 'added' WHEN new.h IS NULL THEN 'removed' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id WHERE old.h IS DISTINCT FROM new.h")
def sync_changes(s, d):
    docs = b.docs(s, d).select(F.col("doc_id").alias("path"), "text")
    old = docs.where("path % 5 <> 0").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    edited = F.when(F.col("path") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return changes(old, docs.where("path % 11 <> 0").select("path", F.sha2(edited.cast("binary"), 256).alias("hash")))


@query("scan_content_store", "SELECT doc_id, sha256(text) AS hash, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) <= 1048576")
def content_store(s, d):
    t = b.docs(s, d).select("doc_id", F.col("text").cast("binary").alias("raw"))
    return t.where(F.octet_length("raw") <= MAX_FILE_BYTES).select("doc_id", F.sha2("raw", 256).alias("hash"), F.octet_length("raw").cast("long").alias("bytes"))


@query("scan_detect_language", "SELECT file_path, CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' ELSE 'unknown' END AS language FROM (SELECT DISTINCT file_path FROM v_nodes)")
def detect_language(s, d):
    return b.nodes(s, d).select("file_path").distinct().withColumn("language", text.language_of(F.col("file_path")))


@query("scan_stale_files", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND md5(text) <> md5(text || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END)")
def stale_files(s, d):
    t = b.docs(s, d).where("doc_id % 3 = 0")
    return t.where(F.md5("text") != F.md5(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("")))).select("doc_id")

"""Routes by file names, over a tree with a few files for each page."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import fileroutes
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

_BEFORE = ("src/routes/+layout.server.ts", "src/routes/(site)/+layout.ts", "middleware/auth.global.ts", "middleware/named.ts", "src/lib/x.ts", "pages/readme.md")


@query("scan_file_routes", """
WITH p AS (SELECT page_id, page_id % 6 AS form, page_id % 7 AS h, 'h' || (page_id % 7) || '/p' || page_id AS at_page FROM pages),
site AS (SELECT *, 'src/routes/+layout.server.ts,src/routes/(site)/+layout.ts' || CASE WHEN h % 2 = 0 THEN ',src/routes/(site)/h' || h || '/+layout.server.js' ELSE '' END AS mw FROM p)
SELECT 'src/routes/(site)/' || at_page || '/[slug]/+page.svelte' AS path, 'page' AS kind, NULL::VARCHAR AS method, '/' || at_page || '/:slug' AS route, mw AS middleware FROM site WHERE form = 0
UNION ALL SELECT 'src/routes/api/' || at_page || '/+server.ts', 'server', NULL, '/api/' || at_page, 'src/routes/+layout.server.ts' FROM p WHERE form = 1
UNION ALL SELECT 'pages/' || at_page || '/index.vue', 'page', NULL, '/' || at_page, 'middleware/auth.global.ts' FROM p WHERE form = 2
UNION ALL SELECT 'pages/' || at_page || '/[...rest].vue', 'page', NULL, '/' || at_page || '/*rest', 'middleware/auth.global.ts' FROM p WHERE form = 3
UNION ALL SELECT 'server/api/' || at_page || '.get.ts', 'api', 'GET', '/api/' || at_page, '' FROM p WHERE form = 4
UNION ALL SELECT 'src/routes/(site)/' || at_page || '/[[lang]]/[id=int]/+page.server.ts', 'page-load', NULL, '/' || at_page || '/:lang?/:id', mw FROM site WHERE form = 5
UNION ALL SELECT DISTINCT 'src/routes/(site)/h' || h || '/+layout.server.js', 'layout', NULL, '/h' || h, 'src/routes/+layout.server.ts,src/routes/(site)/+layout.ts' FROM p WHERE h % 2 = 0
UNION ALL VALUES ('src/routes/+layout.server.ts', 'layout', NULL, '/', ''), ('src/routes/(site)/+layout.ts', 'layout', NULL, '/', 'src/routes/+layout.server.ts')""")  # fmt: skip
def scan_file_routes(s, d):
    k, h = F.col("page_id").cast("string"), (F.col("page_id") % 7).cast("string")
    at = lambda head, tail: F.concat(F.lit(f"{head}h"), h, F.lit("/p"), k, F.lit(tail))
    forms = F.array(
        at("src/routes/(site)/", "/[slug]/+page.svelte"), at("src/routes/api/", "/+server.ts"), at("pages/", "/index.vue"), at("pages/", "/[...rest].vue"), at("server/api/", ".get.ts"), at("src/routes/(site)/", "/[[lang]]/[id=int]/+page.server.ts")
    )
    page = b.table(s, d, "pages").select("page_id")
    own = page.select(F.element_at(forms, (F.col("page_id") % 6 + 1).cast("int")).alias("path"))
    layouts = page.where("page_id % 7 % 2 = 0").select(F.concat(F.lit("src/routes/(site)/h"), h, F.lit("/+layout.server.js")).alias("path"))
    return fileroutes.file_routes(own.unionByName(layouts).unionByName(s.createDataFrame([(x,) for x in _BEFORE], "path string")))

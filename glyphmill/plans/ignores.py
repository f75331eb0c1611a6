"""Ignore files over the paths of symbols and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators.ignores import ignored
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

#: The root's rules, and those of each region's and each brand's folder.
ROOT = ("# what tools leave", "*.tmp", "/orders/**/0?.java", "!/orders/1995/0[1-3].java", "site/*/en/", "!vendor/", "**/t1?.py", "!/parts/brand11/**")
REGION = ("c1*.java", "!c1[!0-5].java", "/3/")
BRAND = ("test_*", "!test_t7.py", "\\#x", "/build/t2?.py  ")


def paths(s, d):
    """Files of symbols, some within a build folder, and pages below one folder for each host, some of them in folders of tools."""
    files = b.nodes(s, d).select("file_path").distinct()
    files = files.select(F.when(F.rlike("file_path", F.lit("^parts/.*5\\.py$")), F.regexp_replace("file_path", "^(parts/[^/]+)/", "$1/build/")).otherwise(F.col("file_path")).alias("path"))
    tool = F.element_at(F.array(*[F.lit(x) for x in ("", "dist/", "vendor/", "a/node_modules/b/")]), (F.col("page_id") % 4 + 1).cast("int"))
    rest = F.regexp_replace(F.regexp_replace("url", "^[^:]*://", ""), "[?#].*$", "")
    site = b.table(s, d, "pages").where("url is not null").select(F.concat(F.lit("site/"), tool, F.regexp_replace(F.regexp_replace(rest, "/+", "/"), "/$", ""), F.when(F.col("page_id") % 10 == 0, ".tmp").otherwise("")).alias("path"))
    return files.unionByName(site)


def ignore_lines(s, d):
    """(folder, nth, line): one file at the root, in each region's folder and in each brand's."""
    listed = lambda rows, lines: rows.select("folder", F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("nth", "line"))
    regions = b.table(s, d, "region").select(F.concat(F.lit("world/"), F.col("r_regionkey").cast("string")).alias("folder"))
    brands = b.table(s, d, "part").select(F.concat(F.lit("parts/"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")).alias("folder")).distinct()
    root = s.createDataFrame([("",)], "folder string")
    return listed(root, ROOT).unionByName(listed(regions, REGION)).unionByName(listed(brands, BRAND))


_RULES = """(VALUES
  ('', 0, 1, '(^|/)[^/]*\\.tmp$', false, false), ('', 0, 2, '^orders/(.*/)?0[^/]\\.java$', false, false), ('', 0, 3, '^orders/1995/0[1-3]\\.java$', false, true), ('', 0, 4, '^site/[^/]*/en$', true, false),
  ('', 0, 5, '(^|/)vendor$', true, true), ('', 0, 6, '^(.*/)?t1[^/]\\.py$', false, false), ('', 0, 7, '^parts/brand11/.+$', false, true), ('', 0, 0, '(^|/)(dist|node_modules|build|vendor)$', true, false),
  ('^world/[0-9]+$', 2, 0, '(^|/)c1[^/]*\\.java$', false, false), ('^world/[0-9]+$', 2, 1, '(^|/)c1[^0-5]\\.java$', false, true), ('^world/[0-9]+$', 2, 2, '^3$', true, false),
  ('^parts/brand[0-9]+$', 2, 0, '(^|/)test_[^/]*$', false, false), ('^parts/brand[0-9]+$', 2, 1, '(^|/)test_t7\\.py$', false, true), ('^parts/brand[0-9]+$', 2, 3, '^build/t2[^/]\\.py$', false, false)
) r(folder, depth, nth, regex, dirs_only, takes_back)"""


@query("filter_ignored_paths", f"""
WITH files AS (SELECT DISTINCT CASE WHEN regexp_matches(file_path, '^parts/.*5\\.py$') THEN regexp_replace(file_path, '^(parts/[^/]+)/', '\\1/build/') ELSE file_path END AS path FROM v_nodes),
sites AS (SELECT 'site/' || ['', 'dist/', 'vendor/', 'a/node_modules/b/'][(page_id % 4 + 1)::INTEGER]
  || regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', ''), '/+', '/', 'g'), '/$', '') || CASE WHEN page_id % 10 = 0 THEN '.tmp' ELSE '' END AS path FROM pages WHERE url IS NOT NULL),
own AS (SELECT path, string_split(path, '/') AS seg FROM (SELECT path FROM files UNION SELECT path FROM sites)),
entries AS (SELECT path, array_to_string(seg[1:n], '/') AS entry, n < len(seg) AS is_dir FROM (SELECT *, unnest(range(1, len(seg) + 1)) AS n FROM own)),
judged AS (SELECT DISTINCT entry, is_dir FROM entries),
hits AS (SELECT entry, is_dir, takes_back, row_number() OVER (PARTITION BY entry, is_dir ORDER BY depth DESC, nth DESC) AS rn FROM judged JOIN {_RULES}
  ON (is_dir OR NOT dirs_only) AND (depth = 0 OR regexp_matches(array_to_string(string_split(entry, '/')[1:depth], '/'), folder)) AND len(string_split(entry, '/')) > depth
  AND regexp_matches(array_to_string(string_split(entry, '/')[depth + 1:], '/'), regex)),
gone AS (SELECT entry, is_dir FROM hits WHERE rn = 1 AND NOT takes_back)
SELECT path, bool_or(gone.entry IS NOT NULL) AS ignored FROM entries LEFT JOIN gone ON gone.entry = entries.entry AND gone.is_dir = entries.is_dir GROUP BY path""")  # fmt: skip
def filter_ignored_paths(s, d):
    return ignored(paths(s, d), ignore_lines(s, d))

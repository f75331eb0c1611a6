"""Which paths a tree's ignore files leave out: rules of every folder above a path, root first, of which the last that matches wins.

Paths meet rules by folder and name, never each with each: directories are judged once, however many files lie below them; plain names meet by
equality, and only patterns with wildcards are tried, those of one folder as one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that are left out unless a rule takes them back.
DEFAULT_DIRS = (
    "node_modules", "bower_components", "jspm_packages", "web_modules", ".yarn", ".pnpm-store", ".next", ".nuxt", ".svelte-kit", ".turbo", ".vite", ".parcel-cache", ".angular",
    ".docusaurus", "storybook-static", ".vinxi", ".nitro", "out-tsc", ".vercel", ".netlify", ".wrangler", "dist", "build", "out", ".output", "coverage", ".nyc_output",
    "__pycache__", "__pypackages__", ".venv", "venv", ".pixi", ".pdm-build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".hypothesis",
    ".ipynb_checkpoints", ".eggs", "target", ".gradle", "obj", "vendor", ".build", "Pods", "Carthage", "DerivedData", ".swiftpm", ".dart_tool", ".pub-cache",
    ".cxx", ".externalNativeBuild", "vcpkg_installed", ".bloop", ".metals", "lua_modules", ".luarocks", "__history", "__recovery", ".cache",
)
DEFAULT_PATTERNS = (*(f"{d}/" for d in DEFAULT_DIRS), "*.egg-info/", "cmake-build-*/", "bazel-*/")

_TOKENS = "\\\\.|^\\*\\*/|/\\*\\*/|/\\*\\*$|\\*+|\\?|\\[[!^]?\\]?[^\\]/]*\\]|[^\\\\]|\\\\$"


def _regex(glob: Column) -> Column:
    """The pattern of a glob: stars stay within a folder, a double one between slashes stands for any number of folders."""

    def one(t: Column) -> Column:
        inside = F.regexp_replace(F.regexp_replace(t, "^\\[[!^]", "[^"), "(?<!^)\\[", "\\\\[")
        last = F.right(t, F.lit(1))
        return (
            F.when(t == "**/", "(?:.*/)?").when(t == "/**/", "/(?:.*/)?").when(t == "/**", "/.+").when(F.startswith(t, F.lit("*")), "[^/]*").when(t == "?", "[^/]")
            .when((F.length(t) > 1) & F.startswith(t, F.lit("[")), inside).otherwise(F.concat(F.lit("\\Q"), last, F.lit("\\E")))
        )

    return F.concat(F.lit("^"), F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(_TOKENS), 0), one), ""), F.lit("$"))


def parsed(lines: DataFrame) -> DataFrame:
    """(folder, nth, takes_back, dirs_only, anchored, glob, plain) from (folder, nth, line) of ignore files. Blank lines and comments go; folders have no slash at their ends.

    A rule with a slash before its end is anchored to its folder, another holds for names at any depth.
    """
    line = F.regexp_replace(F.regexp_replace("line", "\\r$", ""), "(?<!\\\\)[ \\t]+$", "")
    rows = lines.select("folder", "nth", line.alias("line")).where("line <> '' AND line NOT LIKE '#%' AND folder is not null")
    back = F.startswith("line", F.lit("!"))
    rows = rows.select("folder", "nth", back.alias("takes_back"), F.when(back, F.substring("line", 2, 1 << 30)).otherwise(F.col("line")).alias("rule"))
    only = F.endswith("rule", F.lit("/")) & ~F.endswith("rule", F.lit("\\/"))
    rows = rows.select("folder", "nth", "takes_back", only.alias("dirs_only"), F.when(only, F.regexp_replace("rule", "/+$", "")).otherwise(F.col("rule")).alias("rule")).where("rule <> ''")
    glob = F.regexp_replace("rule", "^/", "")
    rows = rows.select("folder", "nth", "takes_back", "dirs_only", F.contains("rule", F.lit("/")).alias("anchored"), glob.alias("glob")).where("glob <> ''")
    return rows.withColumn("plain", ~F.rlike("glob", F.lit("[*?\\[\\\\]")))


def _above(entry: Column) -> Column:
    """All folders above an entry, the root as an empty text first."""
    parts = F.split(entry, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _left_out(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(entry) of those entries (entry, is_dir) that their last matching rule leaves out: rules of deeper folders come later, in a folder in their order."""
    name = F.element_at(F.split("entry", "/"), -1)
    below = entries.select("entry", "is_dir", name.alias("name"), F.explode(_above(F.col("entry"))).alias("folder"))
    below = below.withColumn("within", F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substring("entry", F.length("folder") + 2, F.lit(1 << 30))))
    told = lambda rows: rows.select("entry", F.struct(F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))).alias("depth"), "nth", "takes_back").alias("hit"))
    fits = ~F.col("dirs_only") | F.col("is_dir")
    plain = rules.where("plain").select("folder", "nth", "takes_back", "dirs_only", "anchored", "glob")
    by_name = told(below.join(plain.where("NOT anchored").withColumnRenamed("glob", "name"), ["folder", "name"]).where(fits))
    by_path = told(below.join(plain.where("anchored").withColumnRenamed("glob", "within"), ["folder", "within"]).where(fits))
    tried = rules.where("NOT plain").groupBy("folder").agg(F.collect_list(F.struct("nth", "takes_back", "dirs_only", "anchored", _regex(F.col("glob")).alias("regex"))).alias("rules"))
    matches = lambda r: (~r["dirs_only"] | F.col("is_dir")) & F.when(r["anchored"], F.rlike("within", r["regex"])).otherwise(F.rlike("name", r["regex"]))
    found = F.filter("rules", matches)
    last = F.array_max(F.transform(found, lambda r: F.struct(r["nth"].alias("nth"), r["takes_back"].alias("takes_back"))))
    by_pattern = told(below.join(tried, "folder").withColumn("last", last).where("last is not null").select("entry", "folder", "last.nth", "last.takes_back"))
    hits = by_name.unionByName(by_path).unionByName(by_pattern)
    return hits.groupBy("entry").agg(F.max("hit").alias("hit")).where("NOT hit.takes_back").select("entry")


def ignored(paths: DataFrame, lines: DataFrame, defaults: tuple[str, ...] = DEFAULT_PATTERNS) -> DataFrame:
    """(path, ignored): each distinct path, relative and with slashes. lines: folder, nth and line of ignore files; the root's folder is an empty text.

    The defaults come before all rules, so that a file can take them back. What lies in a folder that is left out is left out, whatever rules there are below. A null path is dropped.
    """
    spark = paths.sparkSession
    first = spark.createDataFrame([("", i - len(defaults), p) for i, p in enumerate(defaults)], "folder string, nth int, line string")
    rules = parsed(lines.select("folder", F.col("nth").cast("int").alias("nth"), "line").unionByName(first))
    own = paths.select("path").where("path is not null").distinct()
    folders = own.select(F.explode(F.filter(_above(F.col("path")), lambda f: f != "")).alias("entry")).distinct()
    gone_dirs = _left_out(folders.withColumn("is_dir", F.lit(True)), rules)
    gone = _left_out(own.select(F.col("path").alias("entry"), F.lit(False).alias("is_dir")), rules).select(F.col("entry").alias("path"))
    in_gone = own.select("path", F.explode(_above(F.col("path"))).alias("entry")).join(gone_dirs, "entry", "left_semi").select("path")
    out = gone.unionByName(in_gone).distinct().withColumn("ignored", F.lit(True))
    return own.join(out, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))

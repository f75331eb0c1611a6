"""Routes that a tree's file names tell, and what runs before each: folders become path segments, and middleware holds for its folder and all below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern of a route file, with the app's folder, the folders of the route and what kind of file it is.
_KIT = "^((?:.*?/)?routes)/(?:(.*)/)?\\+(page|server|layout|error)((?:\\.server)?)\\.(?:svelte|ts|js)$"
_PAGE, _API = "^((?:.*?/)?pages)/(.*)\\.vue$", "^((?:.*?/)?server/api)/(.*)\\.(?:ts|js|mjs)$"
_KIT_BEFORE, _GLOBAL = "^(.*?)/?\\+layout(?:\\.server)?\\.(?:ts|js)$", "^((?:.*?/)?)middleware/[^/]+\\.global\\.(?:ts|js)$"
_METHOD = "\\.(get|head|post|put|patch|delete|options)$"


def _route(folders: Column) -> Column:
    """`/a/:b/*rest` of `a/(group)/[b]/[...rest]`: groups go, double brackets are optional, and what a parameter must match doesn't show."""

    def one(s: Column) -> Column:
        inner = F.regexp_extract(s, "^\\[+(?:\\.\\.\\.)?([^\\]=]*)", 1)
        named = F.when(F.startswith(s, F.lit("[...")) | F.startswith(s, F.lit("[[...")), F.concat(F.lit("*"), inner)).when(F.startswith(s, F.lit("[[")), F.concat(F.lit(":"), inner, F.lit("?")))
        return named.when(F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]")), F.concat(F.lit(":"), inner)).otherwise(s)

    kept = F.filter(F.split(folders, "/"), lambda s: (s != "") & ~F.rlike(s, F.lit("^\\(.*\\)$")))
    return F.concat(F.lit("/"), F.array_join(F.transform(kept, one), "/"))


def file_routes(files: DataFrame) -> DataFrame:
    """(path, kind, method, route, middleware) of files (path): kind is page, page-load, server, layout, error or api, method is null where the name tells none, and middleware lists the
    files that run before it, from the top down, in the order of their names within a folder. A path that tells no route has no row, a null one neither; repeated paths are there once.
    """
    own = files.select("path").where("path is not null").distinct()
    part = lambda pattern, i: F.regexp_extract("path", pattern, i)
    kit = own.where(F.rlike("path", F.lit(_KIT)))
    loads = (part(_KIT, 3) == "page") & ~F.endswith("path", F.lit(".svelte"))
    kit = kit.select("path", F.when(loads, "page-load").otherwise(part(_KIT, 3)).alias("kind"), F.lit(None).cast("string").alias("method"), _route(part(_KIT, 2)).alias("route"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.lit("kit").alias("side"))
    pages = own.where(F.rlike("path", F.lit(_PAGE)))
    pages = pages.select("path", F.lit("page").alias("kind"), F.lit(None).cast("string").alias("method"), _route(F.regexp_replace(part(_PAGE, 2), "(^|/)index$", "")).alias("route"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.lit("page").alias("side"))
    api = own.where(F.rlike("path", F.lit(_API)))
    verb = F.nullif(F.upper(F.regexp_extract(part(_API, 2), _METHOD, 1)), F.lit(""))
    told = F.regexp_replace(F.regexp_replace(part(_API, 2), _METHOD, ""), "(^|/)index$", "")
    api = api.select("path", F.lit("api").alias("kind"), verb.alias("method"), F.regexp_replace(F.concat(F.lit("/api"), _route(told)), "/$", "").alias("route"), F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.lit("api").alias("side"))
    routes = kit.unionByName(pages).unionByName(api)

    # what runs before meets routes by folder: each route asks the folders above it, which are as many as its path is deep
    layouts = own.where(F.rlike("path", F.lit(_KIT_BEFORE)) & F.contains("path", F.lit("routes/"))).select(F.regexp_extract("path", _KIT_BEFORE, 1).alias("above"), F.lit("kit").alias("side"), F.col("path").alias("before"))
    everywhere = own.where(F.rlike("path", F.lit(_GLOBAL))).select(F.regexp_replace(F.regexp_extract("path", _GLOBAL, 1), "/$", "").alias("above"), F.lit("page").alias("side"), F.col("path").alias("before"))
    steps = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    asked = routes.select("path", "side", F.explode(above).alias("above")).join(layouts.unionByName(everywhere), ["above", "side"]).where("before <> path")
    order = F.struct(F.length("above").alias("n"), "before")
    met = asked.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_set(order)), lambda x: x["before"]), ",").alias("middleware"))
    return routes.join(met, "path", "left").select("path", "kind", "method", "route", F.coalesce("middleware", F.lit("")).alias("middleware"))

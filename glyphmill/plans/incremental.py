"""A graph of files that is built once and then follows its sources, over files that are put together from parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators.incremental import FileGraph
from glyphmill.operators.storage import shared_path
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query


def extract(files):
    """Names after `def` and after `use`."""
    names = lambda word: files.select("path", F.explode(F.regexp_extract_all("content", F.lit(f"(?m)^{word} (\\w+)$"), 1)).alias("name"))
    return names("def"), names("use")


def _texts(rows, path, line):
    return rows.groupBy(path.alias("path")).agg(F.array_join(F.sort_array(F.collect_set(line)), "\n").alias("content"))


def sources(s, d, later: bool):
    """(path, content): a file for each order that uses its parts, and one for each brand and size that defines them. Later, some orders are gone, some use one part
    more, some sizes have lost their even parts and one file defines some of them again."""
    part, line = b.table(s, d, "part"), b.table(s, d, "lineitem")
    if later:
        part = part.where("p_size % 7 <> 0 OR p_partkey % 2 = 1")
        line = line.where("l_orderkey % 5 <> 0")
    name = lambda c: F.concat(F.lit("part_"), F.col(c).cast("string"))
    defined = _texts(part, F.concat(F.lit("parts/"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), F.lit("/t"), F.col("p_size").cast("string")), F.concat(F.lit("def "), name("p_partkey")))
    path = F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"))
    use = F.concat(F.lit("use "), name("l_partkey"))
    if not later:
        return defined.unionByName(_texts(line, path, use))
    more = line.where("l_orderkey % 9 = 1").select("l_orderkey", F.lit(1).cast("long").alias("l_partkey"))
    again = _texts(b.table(s, d, "part").where("p_size % 7 = 0 AND p_partkey % 10 = 0"), F.lit("parts/again"), F.concat(F.lit("def "), name("p_partkey")))
    return defined.unionByName(_texts(line.select("l_orderkey", "l_partkey").unionByName(more), path, use)).unionByName(again)


@query("scan_incremental_graph", """
WITH defs AS (
  SELECT p_partkey, 'parts/' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '/t' || p_size AS path FROM part WHERE p_size % 7 <> 0 OR p_partkey % 2 = 1
  UNION ALL SELECT p_partkey, 'parts/again' FROM part WHERE p_size % 7 = 0 AND p_partkey % 10 = 0),
uses AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey % 5 <> 0 UNION SELECT l_orderkey, 1 FROM lineitem WHERE l_orderkey % 5 <> 0 AND l_orderkey % 9 = 1)
SELECT 'orders/o' || l_orderkey AS path, 'part_' || l_partkey AS name, min(defs.path) AS target FROM uses JOIN defs ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey""")  # fmt: skip
def incremental_graph(s, d):
    """The links after an update, of which most were taken over; the SQL builds them anew."""
    graph = FileGraph(s, shared_path(s, "file-graph"), extract)
    graph.update(sources(s, d, False))
    graph.update(sources(s, d, True))
    return graph.links.read(graph.version)

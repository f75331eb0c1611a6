"""Links across events, tags, state and bases, over source files that are put together from orders and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import symbols, synthesis
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

LANGUAGES = ("javascript",)


def ui_files(s, d):
    """(path, language, content): a view for each order that calls on its suppliers' events, a panel with handlers for each supplier, and what they share."""
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    line = b.table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", (F.col("l_partkey") % 500).alias("m"))
    o, k, m = F.col("l_orderkey"), F.col("l_suppkey"), F.col("m")
    calls = F.array_join(F.sort_array(F.collect_set(text("  bus.emit('s", k, "_", m, "', 1); // bus.emit('ghost')\n"))), "")
    tags = F.array_join(F.sort_array(F.collect_set(text("<Box_", F.col("l_linenumber"), " />"))), "")
    views = line.groupBy("l_orderkey").agg(calls.alias("calls"), tags.alias("tags"))
    views = views.select(text("ui/o", o, ".js").alias("path"), text("function send_", o, "() {\n", F.col("calls"), "}\nfunction View_", o, "() {\n  return <div>", F.col("tags"), "<Missing/></div>;\n}\n").alias("content"))
    takes = F.array_join(F.sort_array(F.collect_set(text("function take_", k, "_", m, "(x) { return x; }\nbus.on('s", k, "_", m, "', take_", k, "_", m, ");\n"))), "")
    panels = line.groupBy("l_suppkey").agg(takes.alias("takes"))
    panels = panels.select(
        text("ui/s", k, ".js").alias("path"),
        text("class Panel_", k, " extends Base_", k % 3, " {\n  render() {\n    return null;\n  }\n  change() {\n    this.setState({ a: 1 });\n  }\n  rest() {\n    return 1;\n  }\n}\n", F.col("takes")).alias("content"),
    )
    shared = "".join(f"class Base_{i} {{\n  render() {{ return 0; }}\n  rest() {{ return 0; }}\n}}\n" for i in range(3)) + "".join(f"function Box_{i}() {{\n  return null;\n}}\n" for i in range(1, 8))
    return views.unionByName(panels).unionByName(s.createDataFrame([("ui/a.js", shared)], "path string, content string")).withColumn("language", F.lit("javascript"))


@query("resolve_synthesised_links", """
WITH li AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS k, l_partkey % 500 AS m FROM lineitem), few AS (SELECT k, m FROM li GROUP BY k, m HAVING count(*) <= 6),
at_line AS (SELECT k, m, 11 + 2 * row_number() OVER (PARTITION BY k ORDER BY 'function take_' || k || '_' || m || '(x)') AS line FROM (SELECT DISTINCT k, m FROM li)),
events AS (SELECT k, m, 'ui/s' || k || '.js:' || line AS wired FROM at_line)
SELECT 'ui/o' || o || '.js' AS source_path, 'send_' || o AS source, 'ui/s' || k || '.js' AS target_path, 'take_' || k || '_' || m AS target, 'event-emitter' AS made_by, 's' || k || '_' || m AS via, wired AS wired_at
FROM li JOIN few USING (k, m) JOIN events USING (k, m)
UNION ALL SELECT DISTINCT 'ui/o' || l_orderkey || '.js', 'View_' || l_orderkey, 'ui/a.js', 'Box_' || l_linenumber, 'jsx-render', 'Box_' || l_linenumber, 'ui/o' || l_orderkey || '.js:' || (n + 4)
FROM lineitem JOIN (SELECT o, count(*) AS n FROM li GROUP BY o) ON o = l_orderkey
UNION ALL SELECT DISTINCT 'ui/s' || k || '.js', 'change', 'ui/s' || k || '.js', 'render', 'react-render', 'setState', 'ui/s' || k || '.js:2' FROM li
UNION ALL SELECT DISTINCT 'ui/a.js', 'Base_' || (k % 3) || '.render', 'ui/s' || k || '.js', 'Panel_' || k || '.render', 'interface-impl', 'render', 'ui/s' || k || '.js:2' FROM li
UNION ALL SELECT DISTINCT 'ui/a.js', 'Base_' || (k % 3) || '.rest', 'ui/s' || k || '.js', 'Panel_' || k || '.rest', 'interface-impl', 'rest', 'ui/s' || k || '.js:8' FROM li""")  # fmt: skip
def synthesised_links(s, d):
    files = ui_files(s, d)
    return synthesis.synthesised(symbols.symbols(files, LANGUAGES)[0], files, LANGUAGES)

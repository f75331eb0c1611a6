"""Symbols with spans, their parents and the calls within them, over source files that are put together from orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import symbols
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

LANGUAGES = ("java", "python", "go")


def source_files(s, d):
    """(path, language, content): a Java class for each order, a Python class for each brand and size of parts, a Go type with its methods for each supplier."""
    text = lambda *x: F.concat(*[c.cast("string") if not isinstance(c, str) else F.lit(c) for c in x])
    listed = lambda order, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), x.alias("x")))), lambda e: e["x"]), "")
    key = F.col("l_orderkey")
    # lines are gathered as numbers; texts of equal numbers are in order of their parts
    method = lambda e: F.concat(F.lit("  public int line_"), e["n"].cast("string"), F.lit("(int a) {\n    if (a > 0) { part_"), e["p"], F.lit("(\"{ ghost(\"); }\n    // void no() {\n    return supply(a);\n  }\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("string").alias("p"))))
    java = b.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(lines, method), "").alias("body"))
    java = java.select(text("orders/o", key, ".java").alias("path"), F.lit("java").alias("language"), text("/* class Ghost { */\npublic class Order_", key, " {\n", F.col("body"), "  interface Part { void find(int a); }\n}\n").alias("content"))
    member = text("    def part_", F.col("p_partkey"), "(self, a):\n        if a:\n            size_", F.col("p_size"), "(a)\n\n        return \"def ghost():\"\n")
    python = b.table(s, d, "part").groupBy("p_brand", "p_size").agg(listed("p_partkey", member).alias("body"))
    place = text(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", ""), "/t", F.col("p_size"))
    python = python.select(text("parts/", place, ".py").alias("path"), F.lit("python").alias("language"), text('"""\nclass Ghost:\n"""\nclass Size_', F.col("p_size"), ":\n", F.col("body"), "\nstart()\n").alias("content"))
    k = F.col("s_suppkey")
    go = b.table(s, d, "supplier").select(text("supply/s", k, ".go").alias("path"), F.lit("go").alias("language"), text("package supply\n\ntype S", k, " struct {\n\tname string\n}\n\nfunc (s *S", k, ") Name() string {\n\tfunc() {\n\t\tnation_", F.col("s_nationkey"), "()\n\t}()\n\treturn `}`\n}\n").alias("content"))
    return java.unionByName(python).unionByName(go)


_LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
_PARTS = "(SELECT *, 'parts/' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '/t' || p_size || '.py' AS path, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS i FROM part)"
_SYMBOLS = f"""
SELECT DISTINCT 'orders/o' || l_orderkey || '.java' AS path, 'class' AS kind, 'Order_' || l_orderkey AS name, 2::INTEGER AS start_line, (5 * n + 4)::INTEGER AS end_line, NULL::VARCHAR AS parent, NULL::INTEGER AS parent_line FROM {_LINES}
UNION ALL SELECT 'orders/o' || l_orderkey || '.java', 'method', 'line_' || l_linenumber, (3 + 5 * i)::INTEGER, (7 + 5 * i)::INTEGER, 'Order_' || l_orderkey, 2 FROM {_LINES}
UNION ALL SELECT DISTINCT 'orders/o' || l_orderkey || '.java', 'interface', 'Part', (5 * n + 3)::INTEGER, (5 * n + 3)::INTEGER, 'Order_' || l_orderkey, 2 FROM {_LINES}
UNION ALL SELECT DISTINCT 'orders/o' || l_orderkey || '.java', 'method', 'find', (5 * n + 3)::INTEGER, (5 * n + 3)::INTEGER, 'Part', (5 * n + 3)::INTEGER FROM {_LINES}
UNION ALL SELECT path, 'class', 'Size_' || p_size, 4, (4 + 5 * count(*))::INTEGER, NULL, NULL FROM {_PARTS} GROUP BY path, p_size
UNION ALL SELECT path, 'function', 'part_' || p_partkey, (5 + 5 * i)::INTEGER, (9 + 5 * i)::INTEGER, 'Size_' || p_size, 4 FROM {_PARTS}
UNION ALL SELECT 'supply/s' || s_suppkey || '.go', 'struct', 'S' || s_suppkey, 3, 5, NULL, NULL FROM supplier
UNION ALL SELECT 'supply/s' || s_suppkey || '.go', 'method', 'Name', 7, 12, NULL, NULL FROM supplier"""


@query("scan_symbols", _SYMBOLS)
def scan_symbols(s, d):
    return symbols.symbols(source_files(s, d), LANGUAGES)[0].drop("level")


@query("scan_symbol_calls", f"""
SELECT 'orders/o' || l_orderkey || '.java' AS path, 'part_' || l_partkey AS name, (4 + 5 * i)::INTEGER AS line, 'line_' || l_linenumber AS owner, (3 + 5 * i)::INTEGER AS owner_line FROM {_LINES}
UNION ALL SELECT 'orders/o' || l_orderkey || '.java', 'supply', (6 + 5 * i)::INTEGER, 'line_' || l_linenumber, (3 + 5 * i)::INTEGER FROM {_LINES}
UNION ALL SELECT path, 'size_' || p_size, (7 + 5 * i)::INTEGER, 'part_' || p_partkey, (5 + 5 * i)::INTEGER FROM {_PARTS}
UNION ALL SELECT path, 'start', (6 + 5 * count(*))::INTEGER, NULL, NULL FROM {_PARTS} GROUP BY path
UNION ALL SELECT 'supply/s' || s_suppkey || '.go', 'nation_' || s_nationkey, 9, 'Name', 7 FROM supplier""")  # fmt: skip
def scan_symbol_calls(s, d):
    """Calls with the innermost symbol around them."""
    return symbols.symbols(source_files(s, d), LANGUAGES)[1]


@query("graph_symbol_contains", f"WITH s AS ({_SYMBOLS}) SELECT path, parent AS source, name AS target, start_line FROM s WHERE parent IS NOT NULL")
def symbol_contains(s, d):
    """Links from a symbol to those right within it."""
    own = symbols.symbols(source_files(s, d), LANGUAGES)[0]
    return own.where("parent is not null").select("path", F.col("parent").alias("source"), F.col("name").alias("target"), "start_line")

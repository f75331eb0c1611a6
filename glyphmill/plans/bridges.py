"""Selectors in calls that orders make, answered by Swift declarations of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import bridges
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

_PARTS = "(SELECT p_partkey, 'part' || p_partkey AS name, 'swift/t' || p_size || '.swift' AS path, p_partkey % 8 AS form FROM part)"


@query("resolve_bridged_names", f"""
WITH d AS (SELECT *, CASE form WHEN 0 THEN name WHEN 1 THEN name || ':' WHEN 2 THEN name || 'WithSong:' WHEN 3 THEN name || ':by:' WHEN 4 THEN 'do' || p_partkey || ':' WHEN 5 THEN name
    WHEN 6 THEN 'set' || upper(name[1]) || name[2:] || ':' END AS exact, CASE form WHEN 7 THEN 'hidden' || p_partkey ELSE name || 'ForKey:' END AS loose FROM {_PARTS}),
asked AS (SELECT DISTINCT p_partkey, l_linenumber % 2 = 0 AS loosely FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT CASE WHEN loosely THEN loose ELSE exact END AS selector, path, name, CASE WHEN loosely THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM asked JOIN d USING (p_partkey) WHERE form < 7""")  # fmt: skip
def bridged_names(s, d):
    """Every other line calls by the declaration's own selector, the others by one that only leads to its base name. Parts of one form aren't exposed."""
    text = lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    k, form = F.col("p_partkey"), F.col("p_partkey") % 8
    name = text("part", k)
    pick = lambda *of: F.element_at(F.array(*of), (form + 1).cast("int"))
    part = b.table(s, d, "part")
    declaration = pick(
        text("@objc func ", name, "() -> Int {"), text("@objc public func ", name, "(_ a: Int) {"), text("@objc func ", name, "(song s: Song) {"), text("@objc func ", name, "(_ a: Int, by b: [Int: Int]) {"),
        text("@objc(do", k, ":) func ", name, "(_ a: Int) {"), text("@objc var ", name, ": Int"), text("@objc let ", name, ": Int = 1"), text("@nonobjc func ", name, "() {"),
    )
    declarations = part.select(text("swift/t", F.col("p_size"), ".swift").alias("path"), declaration.alias("declaration"))
    own = pick(name, text(name, ":"), text(name, "WithSong:"), text(name, ":by:"), text("do", k, ":"), name, text("setPart", k, ":"), text("hidden", k))
    calls = b.table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_linenumber").join(part.select("p_partkey"), "p_partkey")
    return bridges.bridged(calls.select(F.when(F.col("l_linenumber") % 2 == 0, F.when(form == 7, text("hidden", k)).otherwise(text(name, "ForKey:"))).otherwise(own).alias("selector")), declarations)

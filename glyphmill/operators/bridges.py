"""Names across languages: which selector a Swift declaration has in Objective-C, and which Swift names a selector may mean. Candidates are generated for each name and
meet by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that join a base name to its first label in selectors.
PREPOSITIONS = ("With", "For", "By", "In", "On", "At", "From", "To", "Of", "As")
#: Confidence of a selector that is just the declaration's, and of one that only its base name meets.
EXACT, BY_BASE = 0.9, 0.6

_upper_first = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
_lower_first = lambda x: F.concat(F.lower(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def declared(declarations: DataFrame, text: str) -> DataFrame:
    """declarations with kind (func, init or var), name, labels and inner (outer and inner names of the parameters, `_` where there is no label) and custom, the selector that is written
    out. Only what is exposed counts: `@objc` in the text, and no `@nonobjc`. A declaration is one text; a null one goes."""
    told = F.col(text)
    head = "\\b(?:(func|var|let)\\s+(\\w+)|(init)\\b)"
    kind = F.regexp_extract(told, head, 1)
    rows = declarations.where(F.rlike(text, F.lit("@objc\\b")) & ~F.rlike(text, F.lit("@nonobjc\\b")) & F.rlike(text, F.lit(head)))
    rows = rows.withColumns({
        "kind": F.when(kind == "", "init").when(kind == "let", "var").otherwise(kind), "name": F.when(kind == "", "init").otherwise(F.regexp_extract(told, head, 2)),
        "custom": F.nullif(F.regexp_extract(told, "@objc\\s*\\(\\s*([^)\\s]+)\\s*\\)", 1), F.lit("")), "_list": F.regexp_extract(told, "\\b(?:func\\s+\\w+|init[?!]?)\\s*(?:<[^>]*>)?\\(([^)]*)\\)", 1),
    })
    params = F.filter(F.transform(F.split("_list", ","), F.trim), lambda p: p != "")
    names = F.transform(params, lambda p: F.split(F.trim(F.regexp_replace(p, ":.*$", "")), "\\s+"))
    return rows.withColumns({"labels": F.transform(names, lambda n: n[0]), "inner": F.transform(names, lambda n: F.element_at(n, -1))}).drop("_list")


def selectors() -> Column:
    """The selectors of a declared() row: one, or a getter and a setter."""
    first, rest = F.get("labels", F.lit(0)), F.slice("labels", 2, F.greatest(F.size("labels") - 1, F.lit(0)))
    none = first == "_"
    joined = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat(p, F.lit(":"))), "")
    method = F.when(F.size("labels") == 0, F.col("name")).otherwise(
        F.concat("name", F.when(none, ":").otherwise(F.concat(F.lit("With"), _upper_first(first), F.lit(":"))), joined(F.transform(rest, lambda p: F.when(p == "_", "").otherwise(p))))
    )
    # an initialiser without a label takes the inner name
    own = F.zip_with("labels", "inner", lambda a, b: F.when(a == "_", b).otherwise(a))
    made = F.when(F.size("labels") == 0, "init").otherwise(F.concat(F.lit("initWith"), _upper_first(F.get(own, F.lit(0))), F.lit(":"), joined(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))))))
    getter = F.coalesce("custom", "name")
    whole = F.coalesce("custom", F.when(F.col("kind") == "init", made).otherwise(method))
    return F.when(F.col("kind") == "var", F.array(getter, F.concat(F.lit("set"), _upper_first(getter), F.lit(":")))).otherwise(F.array(whole))


def base_names(selector: Column) -> Column:
    """Swift names that a selector may mean: its first word, `init`, what stands before a preposition, and the property that a setter sets."""
    words = F.split(F.regexp_replace(selector, ":+$", ""), ":")
    first = words[0]
    before = F.regexp_extract(first, f"^([a-z][a-zA-Z0-9]*?)(?:{'|'.join(PREPOSITIONS)})[A-Z]", 1)
    setter = (F.size(words) == 1) & F.rlike(first, F.lit("^set[A-Z]")) & F.endswith(selector, F.lit(":"))
    found = F.array(first, F.when(F.startswith(first, F.lit("initWith")), "init"), before, F.when(setter, _lower_first(F.substring(first, 4, 1 << 30))))
    return F.array_distinct(F.filter(found, lambda n: n.isNotNull() & (n != "")))


def bridged(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """(selector, path, name, confidence) for each distinct selector of calls that a declaration (path, declaration) answers: the one whose selector it is, else one whose base name it
    may mean; of several that with the least path, then name. Null selectors and paths are dropped."""
    known = declared(declarations.where("path is not null"), "declaration")
    asked = calls.select("selector").where("selector <> ''").distinct()
    least = lambda rows, key: rows.groupBy(key).agg(F.min(F.struct("path", "name")).alias("m"))
    exact = asked.join(least(known.select("path", "name", F.explode(selectors()).alias("selector")), "selector"), "selector").withColumn("confidence", F.lit(EXACT))
    left = asked.join(exact, "selector", "left_anti")
    by_base = left.select("selector", F.explode(base_names(F.col("selector"))).alias("base")).join(least(known.select("path", "name", F.col("name").alias("base")), "base"), "base")
    by_base = by_base.groupBy("selector").agg(F.min("m").alias("m")).withColumn("confidence", F.lit(BY_BASE))
    return exact.unionByName(by_base).select("selector", "m.path", "m.name", "confidence")

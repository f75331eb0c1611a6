"""Links that no call in the source shows: what registers a name on a channel meets what calls on it, each channel within a bound.

Sites are found by patterns and belong to the innermost symbol around them. Each link tells what made it and where it was wired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.source import without_comments
from glyphmill.operators.storage import materialised
from glyphmill.operators.symbols import enclosing

#: Handlers or dispatchers of an event at most, links of a class or channel, and children of a component.
EVENT_FANOUT, CALLBACKS, JSX_CHILDREN = 6, 40, 30
#: Patterns of registrations (event, then handler), of calls on an event, of state changes, and of component tags.
ON, EMIT = "\\.(?:on|once|addListener)\\(\\s*['\"]([^'\"]+)['\"]\\s*,\\s*(?:function\\s+|this\\.)?(\\w+)", "\\.(?:emit|fire|dispatchEvent)\\(\\s*['\"]([^'\"]+)['\"]"
SET_STATE, JSX_TAG = "this\\.(setState)\\s*\\(", "<([A-Z][A-Za-z0-9_]*)[\\s/>]"
_BASES = "\\bclass\\s+(\\w+)[^{;]*?\\b(?:extends|implements)\\s+([\\w.]+(?:\\s*,\\s*[\\w.]+)*)"
_LINK = ["source_path", "source", "target_path", "target", "made_by", "via", "wired_at"]


def _sites(lines: DataFrame, pattern: str, *groups: str) -> DataFrame:
    """(path, line, *groups): matches within a line."""
    found = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), i).alias(g) for i, g in enumerate(groups, 1)])
    return lines.select("path", "line", F.explode(found).alias("m")).select("path", "line", *[F.col(f"m.{g}").alias(g) for g in groups])


def _owned(symbols: DataFrame, sites: DataFrame, *kinds: str) -> DataFrame:
    """Sites with owner and owner_line of the innermost symbol of these kinds that their line meets; others go."""
    rows = symbols.where(F.col("kind").isin(*kinds))
    # of symbols on one line, those further in begin later and end earlier
    place = lambda line, within: F.col(line).cast("long") * 2048 + within
    own = F.least(F.col("level"), F.lit(1000))
    spans = rows.select("path", F.struct("start_line", "name").alias("name"), place("start_line", own).alias("at"), place("end_line", 2047 - own).alias("end_at"))
    points = sites.select("path", place("line", F.lit(1023)).alias("at"), F.struct(F.col("line").alias("start_line"), F.lit("").alias("name")).alias("name"), F.struct(*sites.columns).alias("site"))
    met = enclosing(spans, points)[1].where("owner is not null")
    return met.select("site.*", F.col("owner.name.name").alias("owner"), F.col("owner.name.start_line").alias("owner_line"))


def _first_named(symbols: DataFrame, *kinds: str) -> DataFrame:
    """(name, target_path, target_line): of symbols that share a name the one with the least path, then line."""
    own = symbols.where(F.col("kind").isin(*kinds)).groupBy("name").agg(F.min(F.struct("path", "start_line")).alias("m"))
    return own.select("name", F.col("m.path").alias("target_path"), F.col("m.start_line").alias("target_line"))


def _capped(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")


def _link(rows: DataFrame, made_by: str, source: Column, target: Column, via: Column, wired: Column) -> DataFrame:
    return rows.select(F.col("source_path"), source.alias("source"), F.col("target_path"), target.alias("target"), F.lit(made_by).alias("made_by"), via.alias("via"), wired.alias("wired_at")).distinct()


def event_links(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """From a function that calls on an event to each handler of it, where neither side has more than EVENT_FANOUT members."""
    handlers = _sites(lines, ON, "event", "name").join(_first_named(symbols, "function", "method"), "name")
    handlers = handlers.groupBy("event", "name", "target_path", "target_line").agg(F.min(F.concat_ws(":", "path", F.col("line").cast("string"))).alias("wired"))
    callers = _owned(symbols, _sites(lines, EMIT, "event"), "function", "method", "component").select("event", F.col("path").alias("source_path"), "owner", "owner_line").distinct()
    few = lambda rows: rows.groupBy("event").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= EVENT_FANOUT).select("event")
    met = callers.join(few(callers), "event").join(handlers.join(few(handlers), "event"), "event")
    other = ~((F.col("source_path") == F.col("target_path")) & (F.col("owner_line") == F.col("target_line")) & (F.col("owner") == F.col("name")))
    return _link(met.where(other), "event-emitter", F.col("owner"), F.col("name"), F.col("event"), F.col("wired"))


def jsx_links(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """From a component to those whose tags it renders, the first JSX_CHILDREN by name."""
    tags = _owned(symbols, _sites(lines, JSX_TAG, "name"), "function", "method", "component").select("path", "owner", "owner_line", "name", "line")
    tags = tags.groupBy("path", "owner", "owner_line", "name").agg(F.min("line").alias("line"))
    met = tags.join(_first_named(symbols, "component", "function", "class"), "name").where("owner <> name").withColumnRenamed("path", "source_path")
    met = _capped(met, ["source_path", "owner", "owner_line"], ["name"], JSX_CHILDREN)
    return _link(met, "jsx-render", F.col("owner"), F.col("name"), F.col("name"), F.concat_ws(":", "source_path", F.col("line").cast("string")))


def render_links(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """From a method that changes the state to its class's render, CALLBACKS of a class at most."""
    renders = symbols.where("kind = 'method' AND name = 'render' AND parent is not null").select("path", "parent", "parent_line", F.col("start_line").alias("render_line"))
    changes = _owned(symbols, _sites(lines, SET_STATE, "what"), "method").select("path", F.col("owner").alias("name"), F.col("owner_line").alias("start_line")).distinct()
    methods = symbols.where("kind = 'method' AND name <> 'render'").join(changes, ["path", "name", "start_line"], "left_semi").select("path", "name", "start_line", "parent", "parent_line")
    met = _capped(methods.join(renders, ["path", "parent", "parent_line"]), ["path", "parent", "parent_line"], ["start_line", "name"], CALLBACKS)
    return _link(met.withColumns({"source_path": F.col("path"), "target_path": F.col("path")}), "react-render", F.col("name"), F.lit("render"), F.lit("setState"), F.concat_ws(":", "path", F.col("render_line").cast("string")))


def override_links(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """From a method of a base to that of the same name in a class which extends or implements it, CALLBACKS of a class and base at most."""
    heads = _sites(lines, _BASES, "class", "bases").select("path", "line", "class", F.explode(F.split("bases", "\\s*,\\s*")).alias("base"))
    heads = heads.select("path", "line", "class", F.element_at(F.split("base", "\\."), -1).alias("name"))
    bases = _first_named(symbols, "class", "interface", "struct", "trait", "protocol")
    methods = symbols.where("kind = 'method' AND parent is not null").select("path", "name", "start_line", "parent", "parent_line")
    told = heads.join(bases, "name").select(F.col("path").alias("target_path"), F.col("line").alias("own_line"), "class", F.col("name").alias("base"), F.col("target_path").alias("source_path"), F.col("target_line").alias("base_line"))
    told = told.where(~((F.col("source_path") == F.col("target_path")) & (F.col("own_line") == F.col("base_line"))))
    mine = methods.select(F.col("path").alias("target_path"), "name", F.col("parent").alias("class"), F.col("parent_line").alias("own_line"), F.col("start_line").alias("to_line"))
    theirs = methods.select(F.col("path").alias("source_path"), "name", F.col("parent").alias("base"), F.col("parent_line").alias("base_line"), F.col("start_line").alias("from_line"))
    met = told.join(mine, ["target_path", "class", "own_line"]).join(theirs, ["source_path", "base", "base_line", "name"])
    met = _capped(met, ["target_path", "class", "own_line", "source_path", "base", "base_line"], ["from_line", "to_line", "name"], CALLBACKS)
    return _link(met, "interface-impl", F.concat_ws(".", "base", "name"), F.concat_ws(".", "class", "name"), F.col("name"), F.concat_ws(":", "target_path", F.col("to_line").cast("string")))


def synthesised(symbols: DataFrame, files: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(source_path, source, target_path, target, made_by, via, wired_at) from symbols as symbols.symbols() gives them and files (path, language, content).

    Comments don't count, strings do, as they hold the events' names. A match lies within a line. A null text has no site; equal links are there once.
    """
    clean = [files.where((F.col("language") == x) & F.col("path").isNotNull()).select("path", without_comments(F.col("content"), x).alias("code")) for x in languages]
    lines = reduce(DataFrame.unionByName, clean).select("path", F.posexplode(F.split("code", "\n")).alias("i", "text"))
    lines = materialised(lines.select("path", (F.col("i") + 1).alias("line"), "text"), "lines")
    symbols = materialised(symbols, "symbols")
    return reduce(DataFrame.unionByName, [f(symbols, lines) for f in (event_links, jsx_links, render_links, override_links)]).select(*_LINK)

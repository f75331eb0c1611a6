"""Expressions over source text: comments blanked out in place, import clauses, and paths that an import can mean."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOUBLE, _SINGLE = '"[^"\\\\\\n]*+(?:\\\\.[^"\\\\\\n]*+)*+"?', "'[^'\\\\\\n]*+(?:\\\\.[^'\\\\\\n]*+)*+'?"
_CHAR = "'(?:\\\\[^\\n]{1,8}?|[^'\\\\\\n])'"
_TICKS = "`[^`\\\\]*+(?:\\\\[\\s\\S][^`\\\\]*+)*+`?"
_LINE, _HASH, _BLOCK = "//[^\\n]*+", "#[^\\n]*+", "/\\*[\\s\\S]*?(?:\\*/|\\z)"
_DOCS = "\"\"\"[\\s\\S]*?(?:\"\"\"|\\z)", "'''[\\s\\S]*?(?:'''|\\z)"
_C_LIKE = ((_BLOCK, _LINE), (_DOUBLE, _SINGLE, _TICKS), "[^\"'`/]++")
#: By language: what is blanked, what is kept whole, and runs that hold neither.
LEXICON = {
    **dict.fromkeys(("javascript", "typescript", "tsx", "go"), _C_LIKE),
    **dict.fromkeys(("java", "csharp", "swift", "rust", "kotlin", "scala", "c", "cpp"), ((_BLOCK, _LINE), (_DOUBLE, _CHAR), "[^\"'/]++")),
    "python": ((*_DOCS, _HASH), (_DOUBLE, _SINGLE), "[^\"'#]++"),
    "php": ((_BLOCK, _LINE, "#(?!\\[)[^\\n]*+"), (_DOUBLE, _SINGLE, "#\\["), "[^\"'/#]++"),
    "ruby": (("(?m:^)=begin\\b[\\s\\S]*?(?:\\n=end[^\\n]*+|\\z)", _HASH), (_DOUBLE, _SINGLE), "[^\"'#=]++"),
}


def _blanked(x: Column, language: str, strings: bool) -> Column:
    text = F.coalesce(x, F.lit(""))
    if language not in LEXICON:
        return text
    blank, keep, other = LEXICON[language]
    tokens = F.regexp_extract_all(text, F.lit("|".join((*blank, *keep, other, "[\\s\\S]"))), 0)
    is_blank = F.lit("\\A(?:" + "|".join((*blank, *keep) if strings else blank) + ")\\z")
    return F.array_join(F.transform(tokens, lambda t: F.when(F.rlike(t, is_blank), F.regexp_replace(t, "[^\\n]", " ")).otherwise(t)), "")


def without_comments(x: Column, language: str) -> Column:
    """The text with comments (and Python's triple-quoted strings) turned into spaces, so that offsets and lines stay.

    One pass of one pattern cuts the text into comments, strings and other runs. A comment mark within a string is text.
    Nested block comments end at the first end mark. A null text is empty; an unknown language keeps its text.
    """
    return _blanked(x, language, False)


def code_only(x: Column, language: str) -> Column:
    """without_comments(), with strings turned into spaces as well, quotes included: what is left is code."""
    return _blanked(x, language, True)


def _all(x: Column, pattern: str, *groups: int) -> list[Column]:
    return [F.regexp_extract_all(x, F.lit(pattern), g) for g in groups]


def _row(local: Column, exported: Column, source: Column) -> Column:
    return F.struct(local.alias("local"), exported.alias("exported"), source.alias("source"))


def _single(local: Column, source: Column, exported: str) -> Column:
    return F.zip_with(local, source, lambda a, z: _row(a, F.lit(exported), z))


def _listed(clauses: Column, sources: Column, rename: str) -> Column:
    """Comma-separated names, each perhaps renamed, with their source."""

    def parts(clause: Column, source: Column) -> Column:
        names = F.filter(F.transform(F.split(clause, ","), lambda n: F.regexp_replace(F.trim(F.regexp_replace(n, "\\s+", " ")), "^type ", "")), lambda n: n != "")
        pair = lambda n: F.split(n, rename)
        return F.transform(names, lambda n: _row(F.element_at(pair(n), -1), F.element_at(pair(n), 1), source))

    return F.flatten(F.zip_with(clauses, sources, parts))


def imports_of(x: Column, language: str) -> Column:
    """array<struct<local, exported, source>> of a text without comments. `*` stands for a whole module, `default` for its default."""
    quoted, name = "['\"]([^'\"\\n]+)['\"]", "([A-Za-z_$][\\w$]*)"
    if language in ("javascript", "typescript", "tsx"):
        named, named_from = _all(x, f"\\bimport\\s+(?:type\\s+)?(?:[\\w$]+\\s*,\\s*)?\\{{([^}}]*)\\}}\\s*from\\s*{quoted}", 1, 2)
        own, own_from = _all(x, f"\\bimport\\s+{name}\\s*(?:,\\s*(?:\\{{[^}}]*\\}}|\\*\\s*as\\s+[\\w$]+)\\s*)?from\\s*{quoted}", 1, 2)
        space, space_from = _all(x, f"\\bimport\\s+(?:[\\w$]+\\s*,\\s*)?\\*\\s*as\\s+{name}\\s+from\\s*{quoted}", 1, 2)
        needed, needed_from = _all(x, f"\\b(?:const|let|var)\\s+{name}\\s*=\\s*require\\(\\s*{quoted}\\s*\\)", 1, 2)
        taken, taken_from = _all(x, f"\\b(?:const|let|var)\\s+\\{{([^}}]*)\\}}\\s*=\\s*require\\(\\s*{quoted}\\s*\\)", 1, 2)
        return F.concat(
            _listed(named, named_from, " as "), _single(own, own_from, "default"), _single(space, space_from, "*"), _single(needed, needed_from, "*"), _listed(taken, taken_from, "\\s*:\\s*"),
        )
    if language == "python":
        source, wrapped, plain = _all(x, "(?m)^[ \\t]*from\\s+([\\w.]+)\\s+import\\s+(?:\\(([^)]*)\\)|([^\\n(]+))", 1, 2, 3)
        clauses = F.zip_with(wrapped, plain, lambda a, z: F.concat(a, z))
        module, alias = _all(x, "(?m)^[ \\t]*import\\s+([\\w.]+)(?:[ \\t]+as[ \\t]+(\\w+))?[ \\t]*$", 1, 2)
        whole = F.zip_with(module, alias, lambda m, a: _row(F.when(a == "", F.substring_index(m, ".", 1)).otherwise(a), F.lit("*"), m))
        return F.concat(_listed(clauses, source, " as "), whole)
    if language == "go":
        one = "(?:([\\w.]+)[ \\t]+)?\"([^\"\\n]+)\""
        lines = F.concat(F.lit("\n"), F.array_join(F.concat(*_all(x, "(?m)^import[ \\t]+((?:[\\w.]+[ \\t]+)?\"[^\"\\n]+\")", 1), *_all(x, "(?m)^import\\s*\\(([^)]*)\\)", 1)), "\n"))
        alias, source = _all(lines, one, 1, 2)
        return F.zip_with(alias, source, lambda a, z: _row(F.when(a == "", F.element_at(F.split(z, "/"), -1)).otherwise(a), F.lit("*"), z))
    if language in ("java", "kotlin", "scala"):
        full = _all(x, "(?m)^[ \\t]*import\\s+(?:static\\s+)?([\\w.]+(?:\\.\\*)?)[ \\t]*;?[ \\t]*$", 1)[0]
        last = lambda q: F.element_at(F.split(q, "\\."), -1)
        return F.transform(full, lambda q: _row(last(q), last(q), F.regexp_replace(q, "\\.[^.]*$", "")))
    if language == "php":
        full, alias = _all(x, "(?m)^[ \\t]*use\\s+\\\\?([\\w\\\\]+)(?:\\s+as\\s+(\\w+))?\\s*;", 1, 2)
        last = lambda q: F.element_at(F.split(q, "\\\\"), -1)
        return F.zip_with(full, alias, lambda q, a: _row(F.when(a == "", last(q)).otherwise(a), last(q), q))
    if language in ("c", "cpp"):
        return F.transform(_all(x, "(?m)^[ \\t]*#[ \\t]*include[ \\t]+[<\"]([^>\"\\n]+)[>\"]", 1)[0], lambda q: _row(F.element_at(F.split(q, "/"), -1), F.lit("*"), q))
    return F.array().cast("array<struct<local:string,exported:string,source:string>>")


def reexports_of(x: Column) -> Column:
    """array<struct<local, exported, source>> of `export … from`: local is the name given on; `*` gives on all."""
    quoted = "['\"]([^'\"\\n]+)['\"]"
    clauses, sources = _all(x, f"\\bexport\\s+(?:type\\s+)?\\{{([^}}]*)\\}}\\s*from\\s*{quoted}", 1, 2)
    star = _all(x, f"\\bexport\\s+\\*\\s*from\\s*{quoted}", 1)[0]
    return F.concat(_listed(clauses, sources, " as "), F.transform(star, lambda q: _row(F.lit("*"), F.lit("*"), q)))


def joined_path(folder: Column, relative: Column) -> Column:
    """A path with `.` and `..` taken out; steps above the root are lost."""
    steps = F.split(F.concat_ws("/", folder, relative), "/")
    start = F.array().cast("array<string>")
    up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    return F.array_join(F.aggregate(steps, start, lambda a, s: F.when(s == "..", up(a)).when(s.isin("", "."), a).otherwise(F.concat(a, F.array(s)))), "/")


#: What may follow an import's path, in the order in which it is tried.
SUFFIXES = {
    **dict.fromkeys(("javascript", "typescript", "tsx"), ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")),
    "python": (".py", "/__init__.py"), "java": (".java", ".kt"), "php": (".php",), "c": ("", ".h", ".hpp"), "cpp": ("", ".h", ".hpp"),
}


def import_candidates(folder: Column, source: Column, language: str, aliases: Sequence[tuple[str, str]] = ()) -> Column:
    """array<string>: files that an import may mean, best first. aliases: (prefix, folder) pairs, the first that fits holds."""
    if language in ("javascript", "typescript", "tsx", "c", "cpp"):
        base = F.when(F.rlike(source, F.lit("^\\.{1,2}(/|$)")), joined_path(folder, source))
        for prefix, target in aliases:
            base = base.when(F.startswith(source, F.lit(prefix)), joined_path(F.lit(target), F.substring(source, F.lit(len(prefix) + 1), F.length(source))))
        if language in ("c", "cpp"):
            base = base.otherwise(joined_path(folder, source))
    elif language == "python":
        dots = F.length(F.regexp_extract(source, "^(\\.*)", 1))
        rest = F.translate(F.regexp_replace(source, "^\\.+", ""), ".", "/")
        base = F.when(dots > 0, joined_path(folder, F.concat(F.repeat(F.lit("../"), dots - 1), rest))).otherwise(rest)
    else:
        base = F.translate(source, ".\\", "//")
    return F.when(base.isNotNull(), F.transform(F.array(*[F.lit(s) for s in SUFFIXES.get(language, ("",))]), lambda s: F.concat(base, s)))

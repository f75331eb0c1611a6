"""Symbols with their spans from source text: a file is read by patterns in its own row, and whole batches of files are put in order at once, so that no part of a file is shuffled.

Braced languages: braces, semicolons and line ends are found with their places; depth and line are running sums within the file, and an opener's
partner is the next brace of its depth. Indented languages: a block ends before the next line of no greater indent. What encloses what
follows from how many spans are open at a place: the parent is the last one opened a level above. A file, of MAX_FILE_BYTES at most, is the largest row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.source import code_only

_NOT_A_TYPE = "(?!(?:return|new|throw|else|case|await|yield|delete|typeof|goto|in|of|do|import|package|using|class|interface|enum|record)\\b)"
_TYPE, _NOT_CONTROL = "[\\w<>\\[\\],.?&*:]+", "(?!(?:if|for|while|switch|catch|return|function|new|else|do|try|throw|super|this|when|synchronized|using|lock|foreach)\\b)"
_METHOD = f"(?m)(?:^|(?<=[{{;}}]))[ \\t]*(?:@\\w+(?:\\([^)\\n]*\\))?[ \\t]+)*(?:{_NOT_A_TYPE}{_TYPE}[ \\t]+)+{_NOT_CONTROL}(\\w+)[ \\t]*\\("
_C_FUNCTION = f"(?m)^(?:{_NOT_A_TYPE}{_TYPE}[ \\t*&]+)+{_NOT_CONTROL}(\\w+)[ \\t]*\\([^;{{}}]*\\)(?=\\s*\\{{)"
_JS = (
    ("class", "\\bclass\\s+(\\w+)"), ("function", "\\bfunction\\b\\*?\\s+(\\w+)"), ("function", "\\b(?:const|let|var)\\s+(\\w+)\\s*(?::[^=\\n]+)?=\\s*(?:async\\s*)?(?:\\([^)\\n]*\\)|\\w+)\\s*(?::[^=\\n]+)?=>"),
    ("method", f"(?m)(?:^[ \\t]+|(?<=[{{;}}])[ \\t]*)(?:(?:public|private|protected|static|async|readonly|override|get|set)[ \\t]+)*{_NOT_CONTROL}([\\w$]+)[ \\t]*\\([^)\\n]*\\)[ \\t]*(?::[^{{\\n]+)?(?=\\{{)"),
)
#: By language: kind of symbol, and a pattern that ends at or before its body, with the name in the first group.
BRACED = {
    "java": (("class", "\\b(?:class|record)\\s+(\\w+)"), ("interface", "\\binterface\\s+(\\w+)"), ("enum", "\\benum\\s+(\\w+)"), ("method", _METHOD)),
    "csharp": (("class", "\\b(?:class|record)\\s+(\\w+)"), ("struct", "\\bstruct\\s+(\\w+)"), ("interface", "\\binterface\\s+(\\w+)"), ("enum", "\\benum\\s+(\\w+)"), ("namespace", "\\bnamespace\\s+([\\w.]+)"), ("method", _METHOD)),
    "kotlin": (("class", "\\b(?:class|object)\\s+(\\w+)"), ("interface", "\\binterface\\s+(\\w+)"), ("function", "\\bfun\\s+(?:<[^>\\n]*>\\s*)?(?:\\w+\\.)?(\\w+)")),
    "swift": (("class", "\\b(?:class|extension)\\s+(\\w+)"), ("struct", "\\bstruct\\s+(\\w+)"), ("protocol", "\\bprotocol\\s+(\\w+)"), ("enum", "\\benum\\s+(\\w+)"), ("function", "\\bfunc\\s+(\\w+)")),
    "go": (("function", "(?m)^func\\s+(\\w+)"), ("method", "(?m)^func\\s+\\([^)\\n]*\\)\\s*(\\w+)"), ("struct", "(?m)^type\\s+(\\w+)(?=\\s+struct\\b)"), ("interface", "(?m)^type\\s+(\\w+)(?=\\s+interface\\b)")),
    "rust": (("function", "\\bfn\\s+(\\w+)"), ("struct", "\\bstruct\\s+(\\w+)"), ("enum", "\\benum\\s+(\\w+)"), ("trait", "\\btrait\\s+(\\w+)"), ("module", "\\bmod\\s+(\\w+)"), ("impl", "\\bimpl(?:<[^>\\n]*>)?\\s+(?:[\\w:<>]+\\s+for\\s+)?(\\w+)")),
    "php": (("class", "\\bclass\\s+(\\w+)"), ("interface", "\\binterface\\s+(\\w+)"), ("trait", "\\btrait\\s+(\\w+)"), ("function", "\\bfunction\\s+&?(\\w+)")),
    "c": (("struct", "\\bstruct\\s+(\\w+)(?=\\s*\\{)"), ("enum", "\\benum\\s+(\\w+)(?=\\s*\\{)"), ("function", _C_FUNCTION)),
    "cpp": (("class", "\\bclass\\s+(\\w+)(?=[^;{}()]*\\{)"), ("struct", "\\bstruct\\s+(\\w+)(?=[^;{}()]*\\{)"), ("namespace", "\\bnamespace\\s+(\\w+)"), ("function", _C_FUNCTION)),
    "javascript": _JS,
    "typescript": (*_JS, ("interface", "\\binterface\\s+(\\w+)"), ("enum", "\\benum\\s+(\\w+)")),
}
#: Of indented languages: kind, and a pattern for one line with indent and name as groups.
INDENTED = {"python": (("function", "^(\\s*)(?:async\\s+)?def\\s+(\\w+)"), ("class", "^(\\s*)class\\s+(\\w+)"))}
#: Words before a bracket that are no calls.
NO_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "fun", "def", "class", "new", "else", "do", "try", "throw", "when", "match", "and", "or", "not", "in",
    "synchronized", "using", "lock", "foreach", "sizeof", "typeof", "await", "yield", "lambda", "elif", "except", "with", "assert", "print", "super", "this", "self",
)
_CALL = "\\b(\\w+)[ \\t]*\\("

_SO_FAR = (Window.unboundedPreceding, 0)


_TOLD = {
    "symbols": ("path string, kind string, name string, start_line int, end_line int, parent string, parent_line int, level int", [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]),
    "calls": ("path string, name string, line int, owner string, owner_line int", [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]),
}


def _hits(pattern: str) -> Column:
    """array<struct<n, name>>: each match of a pattern in `code`, and how many characters lie between the end of the last one and its own."""
    # one pass marks what is found and its name; `code` holds no such marks
    marked = F.split(F.regexp_replace("code", F.lit(pattern), F.lit("$0\0$1\x01")), "\x01")
    row = lambda p: F.struct(F.length(F.substring_index(p, "\0", 1)).alias("n"), F.substring_index(p, "\0", -1).alias("name"))
    return F.transform(F.filter(marked, lambda p: F.contains(p, F.lit("\0"))), row)


def _lines(language: str) -> Column:
    """array<struct<ink, indent, heads, calls>> of the lines of an indented language; heads: a name or '' by kind."""

    def row(t: Column) -> Column:
        no_head = lambda n: ~n.isin(*NO_CALLS) & ~F.rlike(t, F.concat(F.lit("^\\s*(?:async\\s+)?(?:def|class)\\s+"), n, F.lit("\\b")))
        heads = F.array(*[F.regexp_extract(t, p, 2) for _, p in INDENTED[language]])
        calls = F.filter(F.regexp_extract_all(t, F.lit(_CALL), 1), no_head)
        return F.struct(F.rlike(t, F.lit("\\S")).alias("ink"), F.length(F.regexp_extract(t, "^(\\s*)", 1)).alias("indent"), heads.alias("heads"), calls.alias("calls"))

    return F.transform(F.split("code", "\n"), row)


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each value, values)."""
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), n), lists.flatten()


def _sums(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums within groups that lie together."""
    total = np.cumsum(x)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    base = np.where(starts > 0, total[starts - 1], 0) if len(starts) else starts
    return total - np.repeat(base, np.diff([*starts, len(x)]))


def _braced(batch: pa.RecordBatch, kinds: list[str]) -> tuple[dict, dict]:
    """(spans, calls) of files of one braced language, as columns of equal length; file: the row of the batch."""
    code = batch.column("code")
    offsets = np.frombuffer(code.buffers()[1], dtype=np.int32)[code.offset : code.offset + len(code) + 1].astype(np.int64)
    data = np.frombuffer(code.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    where = np.flatnonzero((data == 10) | (data == 59) | (data == 123) | (data == 125))  # \n ; { }
    file = np.searchsorted(offsets, where, side="right") - 1
    at = where - offsets[file] + 1
    if len(data) and data.max() > 127:  # places are counted in characters
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = chars[where + 1] - chars[offsets[file]]
    ch = data[where]
    ends = (ch == 10).astype(np.int64)
    line = 1 + _sums(ends, file) - ends
    step = (ch == 123).astype(np.int64) - (ch == 125)
    depth = _sums(step, file) + (ch == 125)
    brace = np.flatnonzero(step)
    brace = brace[np.lexsort((at[brace], depth[brace], file[brace]))]
    nxt = np.full(len(where), -1)
    same = (file[brace[:-1]] == file[brace[1:]]) & (depth[brace[:-1]] == depth[brace[1:]])
    nxt[brace[:-1][same]] = brace[1:][same]

    files, ats, names, kind = [], [], [], []
    for i, what in enumerate(kinds):
        f, hits = _flat(batch.column(f"h{i}"))
        files.append(f)
        ats.append(_sums(hits.field("n").to_numpy(zero_copy_only=False).astype(np.int64), f))
        names.append(hits.field("name"))
        kind.append(np.full(len(f), i))
    f, a, k, name = np.concatenate(files), np.concatenate(ats), np.concatenate(kind), pa.concat_arrays(names)
    width = int(max(at.max(initial=0), a.max(initial=0))) + 2
    marks, key = file * width + at, f * width + a
    # what comes next in the file: its line, and where a body or statement ends
    after = np.searchsorted(marks, key, side="right")
    stops = np.flatnonzero((ch == 123) | (ch == 59))
    stop = np.searchsorted(marks[stops], key, side="right")
    pick = lambda x, i, ok: np.where(ok, x[np.where(ok, i, 0)] if len(x) else 0, -1)
    own_line = pick(line, after, after < len(where))
    has = stop < len(stops)
    s = pick(stops, stop, has)
    has &= pick(file, s, has) == f
    body = has & (pick(ch, s, has) == 123)
    end = np.where(body, pick(nxt, s, has), s)
    has &= end >= 0
    # without an end, a symbol ends where it is named
    end_at, end_line = np.where(has, pick(at, end, has), a), np.where(has, pick(line, end, has), own_line)
    call = k == len(kinds) - 1
    drop = call & pc.is_in(name, value_set=pa.array(NO_CALLS)).to_numpy(zero_copy_only=False)
    # of the names before brackets on a definition's line, the first that is its own is no call
    word = pc.dictionary_encode(name).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((a, call, word, own_line, f))
    order = order[~drop[order]]
    place = np.stack([f, own_line, word])[:, order]
    follows = np.zeros(len(order), dtype=bool)
    follows[1:] = (place[:, 1:] == place[:, :-1]).all(axis=0) & call[order][1:] & ~call[order][:-1]
    drop[order[follows]] = True
    spans, calls = np.flatnonzero(~call), np.flatnonzero(call & ~drop)
    kinds_ = pa.array(kinds).take(pa.array(k[spans]))
    return (
        {"file": f[spans], "at": a[spans], "end_at": end_at[spans], "start": own_line[spans], "end": end_line[spans], "name": name.take(pa.array(spans)), "kind": kinds_},
        {"file": f[calls], "at": a[calls], "line": own_line[calls], "name": name.take(pa.array(calls))},
    )


def _indented(batch: pa.RecordBatch, kinds: list[str]) -> tuple[dict, dict]:
    spans, calls = [], []
    for file, lines in enumerate(batch.column("lines")):
        open_: list[int] = []
        levels: list[int] = []
        last = 0
        for i, t in enumerate(lines.as_py() or (), 1):
            if not t["ink"]:
                continue
            # a line ends the blocks of every indent that is no less than its own
            while open_ and levels[-1] >= t["indent"]:
                spans[open_.pop()][3] = last
                levels.pop()
            for kind, name in zip(kinds, t["heads"], strict=True):
                if name:
                    open_.append(len(spans))
                    levels.append(t["indent"])
                    spans.append([file, kind, i, i, name])
            calls += [(file, i, name) for name in t["calls"]]
            last = i
        for o in open_:
            spans[o][3] = last
    column = lambda rows, i: np.array([r[i] for r in rows], dtype=np.int64)
    start, end, line = column(spans, 2), column(spans, 3), column(calls, 1)
    text = lambda rows, i: pa.array([r[i] for r in rows], type=pa.string())
    return (
        {"file": column(spans, 0), "at": 2 * start, "end_at": 2 * end + 1, "start": start, "end": end, "name": text(spans, 4), "kind": text(spans, 1)},
        {"file": column(calls, 0), "at": 2 * line, "line": line, "name": text(calls, 2)},
    )


def _nested(spans: dict, points: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level of each span, its parent, owner of each point): as enclosing() does it, for files of a batch; -1 at the top."""
    n, m = len(spans["file"]), len(points["file"])
    file = np.concatenate([spans["file"], spans["file"], points["file"]])
    at = np.concatenate([spans["at"], spans["end_at"], points["at"]])
    step = np.concatenate([np.ones(n, np.int64), -np.ones(n, np.int64), np.zeros(m, np.int64)])
    order = np.lexsort((-step, at, file))
    level = np.empty(len(file), np.int64)
    level[order] = _sums(step[order], file[order])
    own, asked = level[:n], level[2 * n :]
    deep, wide = int(level.max(initial=0)) + 2, int(at.max(initial=0)) + 1
    key = lambda f, lev, a: (f * deep + lev) * wide + a
    given = key(spans["file"], own, spans["at"])
    rank = np.argsort(given, kind="stable")

    def last(f: np.ndarray, lev: np.ndarray, a: np.ndarray) -> np.ndarray:
        i = np.searchsorted(given[rank], key(f, lev, a), side="right") - 1
        got = rank[np.maximum(i, 0)] if n else np.zeros(len(f), np.int64)
        ok = (i >= 0) & (lev > 0)
        if n:
            ok &= (spans["file"][got] == f) & (own[got] == lev)
        return np.where(ok, got, -1)

    return own - 1, last(spans["file"], own - 1, spans["at"]), last(points["file"], asked, points["at"])


def _reader(kinds: list[str], braced: bool, what: str):
    schema = pa.schema([(c.split()[0], t) for c, t in zip(_TOLD[what][0].split(", "), _TOLD[what][1], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, calls = (_braced if braced else _indented)(batch, kinds)
            level, parent, owner = _nested(spans, calls)
            rows, up = (spans, parent) if what == "symbols" else (calls, owner)
            up = pa.array(up, mask=up < 0)
            path, small = batch.column("path").take(pa.array(rows["file"])), lambda x: pa.array(x.astype(np.int32))
            name, line = spans["name"].take(up), pa.array(spans["start"].astype(np.int32)).take(up)
            if what == "symbols":
                yield pa.RecordBatch.from_arrays([path, rows["kind"], rows["name"], small(rows["start"]), small(rows["end"]), name, line, small(level)], schema=schema)
            else:
                yield pa.RecordBatch.from_arrays([path, rows["name"], small(rows["line"]), name, line], schema=schema)

    return run


def enclosing(spans: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """spans and points, each with `level`, how many spans hold it, and `owner`: place and name of the innermost of these, null at the top. Spans of a file nest or are apart.

    How many spans are open at a place is a running sum of their ends; the innermost is the last one opened at that level.
    """
    opens = spans.select("path", "at", F.lit(1).alias("step"), F.struct("at", "name").alias("own"), F.lit(True).alias("is_span"))
    closes = spans.select("path", F.col("end_at").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast(opens.schema["own"].dataType).alias("own"), F.lit(None).cast("boolean").alias("is_span"))
    asks = points.select("path", "at", F.lit(0).alias("step"), F.struct("at", "name").alias("own"), F.lit(False).alias("is_span")).distinct()
    w = Window.partitionBy("path").orderBy("at", F.desc("step")).rowsBetween(*_SO_FAR)
    placed = opens.unionByName(closes).unionByName(asks).withColumn("level", F.sum("step").over(w)).where("own is not null")
    gives = placed.where("is_span").select("path", "level", "at", F.col("own").alias("given"), F.lit(None).cast(opens.schema["own"].dataType).alias("own"), "is_span")
    wants = placed.select("path", (F.col("level") - F.when(F.col("is_span"), 1).otherwise(0)).alias("level"), "at", F.lit(None).cast(opens.schema["own"].dataType).alias("given"), "own", "is_span")
    last = Window.partitionBy("path", "level").orderBy("at", F.col("given").isNull()).rowsBetween(*_SO_FAR)
    met = gives.unionByName(wants).withColumn("owner", F.last("given", ignorenulls=True).over(last)).where("own is not null AND level >= 0")
    met = met.withColumn("owner", F.when(F.col("level") > 0, F.col("owner"))).select("path", F.col("own.at").alias("at"), F.col("own.name").alias("name"), "owner", F.col("level").cast("int").alias("level"), "is_span")
    of = lambda what: met.where("is_span" if what else "NOT is_span").drop("is_span")
    return spans.join(of(True), ["path", "at", "name"], "left"), points.join(of(False), ["path", "at", "name"], "left")


def symbols(files: DataFrame, languages: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(symbols, calls) of files (path, language, content).

    Symbols: path, kind, name, start_line, end_line, parent (the enclosing symbol's name, null at the top), parent_line and level (how many enclose it). Calls: path, name, line, owner and owner_line of the
    innermost symbol around them. Comments and strings are blanked first. A null text has none, an unknown language neither; paths are taken to be unique.
    An unclosed body ends where it is named. Null paths are dropped.
    """
    def read(language: str, what: str) -> DataFrame:
        code = code_only(F.col("content"), language)
        rows = files.where((F.col("language") == language) & F.col("path").isNotNull() & F.col("content").isNotNull())
        if language in BRACED:
            patterns = [*BRACED[language], ("call", _CALL)]
            # a row of its own, so that the text is cleaned once and not for each pattern
            rows = rows.select("path", F.explode(F.array(F.concat(F.translate(code, "\0\x01", "\x02\x02"), F.lit("\n")))).alias("code"))
            rows = rows.select("path", "code", *[_hits(p).alias(f"h{i}") for i, (_, p) in enumerate(patterns)])
        else:
            patterns = INDENTED[language]
            rows = rows.select("path", F.explode(F.array(code)).alias("code")).select("path", _lines(language).alias("lines"))
        return rows.mapInArrow(_reader([kind for kind, _ in patterns], language in BRACED, what), _TOLD[what][0])

    return tuple(reduce(DataFrame.unionByName, [read(x, what) for x in languages]) for what in ("symbols", "calls"))

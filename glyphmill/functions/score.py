"""Score, reward and policy expressions. All are columns, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bonus of a symbol kind in search ranking; other kinds have none.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4, "property": 3, "field": 3,
    "variable": 2, "constant": 3, "import": 1, "export": 1, "parameter": 0, "namespace": 4, "file": 0, "protocol": 9, "enum_member": 3,
}
#: Reward weights of an extra file, a prompt token, a revisit and the trim overlap.
EXTRA_FILE, TOKEN, REVISIT, OVERLAP = 0.15, 2e-5, 0.05, 0.2
#: Knobs of a profile with default, least and most, and what intents set instead.
KNOBS = (
    ("max_trace", 5, 3, 8), ("caller_hops", 2, 0, 3), ("max_upstream", 10, 3, 25), ("max_downstream", 5, 2, 15), ("max_importers", 10, 3, 20), ("max_methods", 8, 3, 20),
    ("max_siblings", 15, 3, 30), ("max_snippets", 10, 1, 10), ("max_impact", 15, 5, 30), ("max_symbols", 20, 3, 25), ("max_primary_ctx", 10, 3, 25), ("max_decisions", 5, 3, 10),
)
KNOBS_OF = {
    "debug": {"max_upstream": 20, "max_downstream": 10, "max_snippets": 7}, "explore": {"max_siblings": 25, "max_upstream": 5, "max_downstream": 3},
    "trace": {"max_upstream": 20, "max_downstream": 10, "max_importers": 15}, "refactor": {"max_impact": 25, "max_importers": 15, "max_methods": 12},
}
#: Most of a knob from so many memories with a file on; the last that holds counts.
SHRUNK = (
    ("max_symbols", 1, 5), ("max_snippets", 1, 2), ("max_siblings", 1, 5), ("max_trace", 2, 3), ("caller_hops", 2, 1),
    ("max_trace", 3, 2), ("max_snippets", 3, 1), ("max_siblings", 3, 3), ("max_symbols", 3, 3),
)


def profile_knob(knob: str, intent: Column) -> Column:
    """A knob's value for an intent, within its bounds."""
    _, default, least, most = next(k for k in KNOBS if k[0] == knob)
    out = F.lit(default)
    for name, own in KNOBS_OF.items():
        if knob in own:
            out = F.when(intent == name, own[knob]).otherwise(out)
    return F.greatest(F.lit(least), F.least(F.lit(most), out))


def shrunk_knob(knob: str, value: Column, memories: Column) -> Column:
    """Less of a knob where memories that point at files were found."""
    for own, least, most in SHRUNK:
        if own == knob:
            value = F.when(memories >= least, F.least(value, F.lit(most))).otherwise(value)
    return value


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def raw_reward(extra: Column, tokens: Column, revisits: Column, overlap: Column) -> Column:
    d = lambda c: c.cast("double")
    return clip(F.lit(1.0) - F.lit(EXTRA_FILE) * d(extra) - F.lit(TOKEN) * d(tokens) - F.lit(REVISIT) * d(revisits) - F.lit(OVERLAP) * d(overlap))


def implicit_reward(similarity: Column) -> Column:
    """A near repeat of a query says that the last answer failed; null where none fires."""
    return F.when(similarity > 0.95, 0.0).when(similarity > 0.70, 0.4)


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_BONUS.items() for x in kv]), kind), F.lit(0))


def term_idf(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(8.0), F.log1p(F.lit(1000.0) / (n + 1))))


def surface_weight(surface: Column) -> Column:
    return F.when(surface == "name", 1.0).when(surface == "path", 0.7).otherwise(0.4)


def context_boost(path: Column, hints: list[str]) -> Column:
    """1, 2 or 3 times by how many hints the path holds."""
    found = sum((F.contains(F.lower(path), F.lit(h.lower())).cast("int") for h in hints), F.lit(0))
    return F.least(found + 1, F.lit(3)).cast("double")


def name_match_bonus(name: Column, query: str) -> Column:
    """80 exact, 60 one of the words, 10 to 40 by how much of the name a prefix covers, 15 all words, 10 contained."""
    q = query.lower()
    words = [w for w in q.split() if len(w) >= 2]
    low = F.lower(name)
    flat = F.lit(q.replace(" ", ""))
    prefix = F.floor(F.lit(10) + F.lit(30.0) * F.length(flat) / F.length(low) + 0.5).cast("int")
    every = F.lit(bool(words))
    for w in words:
        every = every & F.contains(low, F.lit(w))
    return (
        F.when(low == flat, 80).when(low.isin(words), 60).when(F.startswith(low, flat), prefix).when(every & F.lit(len(words) > 1), 15).when(F.contains(low, flat), 10).otherwise(0)
    )


def path_relevance(path: Column, words: list[str]) -> Column:
    """For each word 10 in the file's name, 5 in a directory's, else 3 anywhere in the path; 15 less for tests."""
    low = F.lower(path)
    base, folder = F.element_at(F.split(low, "/"), -1), F.regexp_replace(low, "/?[^/]*$", "")
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(base, F.lit(w)), 10).when(F.contains(folder, F.lit(w)), 5).when(F.contains(low, F.lit(w)), 3).otherwise(0)
    return total - F.when(is_test_path(path), 15).otherwise(0)


#: What makes a path one of tests or of other non-production code. File names first, then folders.
TEST_PATH = "|".join((
    "(?i:(^|/)test[_.][^/]*$)", "(?i:[._-](test|tests|spec|specs)\\.[a-z0-9]+$)", "(Test|Tests|TestCase|Tester|Spec|Specs)\\.[A-Za-z0-9]+$",
    "(?i:/(tests|test|__tests__|spec|specs|testlib|testing)/)", "(?i:^(test|tests|spec|specs)/)", "(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/",
    "(?i:(^|/)(integration|sample|samples|example|examples|fixture|fixtures|benchmark|benchmarks|demo|demos)/)",
))
#: Names of generated files, by language.
GENERATED_PATH = "|".join((
    "\\.pb\\.go$", "\\.pulsar\\.go$", "_grpc\\.pb\\.go$", "_mock\\.go$", "_mocks\\.go$", "^mock_[^/]+\\.go$", "\\.generated\\.[jt]sx?$", "\\.gen\\.[jt]sx?$", "\\.pb\\.[jt]s$",
    "_pb\\.[jt]s$", "_grpc_pb\\.[jt]s$", "_pb2(_grpc)?\\.py$", "_pb2\\.pyi$", "\\.pb\\.(cc|h)$", "\\.g\\.cs$", "Grpc\\.cs$", "OuterClass\\.java$", "Grpc\\.java$", "\\.pb\\.swift$",
    "\\.g\\.dart$", "\\.freezed\\.dart$", "\\.pb\\.dart$", "\\.pbgrpc\\.dart$", "\\.chopper\\.dart$", "\\.generated\\.rs$",
))
#: Tests that aren't worth naming as a project's main files, over the lower-cased path; generated files are beside them.
LOW_VALUE_PATH = "|".join((
    "(^|/)(tests?|__tests?__|spec)/", "_test\\.go$", "(^|/)test_[^/]+\\.py$", "_test\\.py$", "_spec\\.rb$", "_test\\.rb$", "\\.(test|spec)\\.[jt]sx?$",
    "(test|spec|tests)\\.(java|kt|scala)$", "(tests?|spec)\\.cs$", "tests?\\.swift$", "_test\\.dart$",
))


def is_low_value(path: Column) -> Column:
    return F.rlike(F.lower(path), F.lit(LOW_VALUE_PATH)) | is_generated(path)


def is_test_path(path: Column) -> Column:
    return F.rlike(path, F.lit(TEST_PATH))


def is_generated(path: Column) -> Column:
    return F.rlike(path, F.lit(GENERATED_PATH))


def path_proximity(a: Column, b: Column) -> Column:
    """15 for each leading directory that two paths share, 80 at most."""
    dirs = lambda p: F.split(F.regexp_replace(p, "/?[^/]*$", ""), "/")
    pairs = F.zip_with(dirs(a), dirs(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    state = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, hit: F.struct((s["n"] + F.when(s["on"] & hit, 1).otherwise(0)).alias("n"), (s["on"] & hit).alias("on")))
    return F.least(state["n"] * 15, F.lit(80))


def fp_penalty(similarity: Column, count: Column) -> Column:
    return F.when(similarity >= 0.70, F.lit(0.20) * F.least(count.cast("double") / 3.0, F.lit(1.0)) * similarity).otherwise(F.lit(0.0))


def smoothed_rate(success: Column, fired: Column) -> Column:
    return (success + 1.0) / (fired + 2.0)


def anchor_score(success: Column, fired: Column, g_success: Column, g_fired: Column, keyword: Column) -> Column:
    """The repository's own rate, weighed up over its first three fires, and the global rate; more for known keywords."""
    w = F.lit(0.7) * F.least(fired.cast("double") / 3.0, F.lit(1.0))
    return (w * smoothed_rate(success, fired) + (1 - w) * smoothed_rate(g_success, g_fired)) * (1 + F.lit(0.3) * F.least(keyword, F.lit(1.0)))


def widen_breadth(b: Column, most: int = 15) -> Column:
    return F.least(F.greatest(b + F.floor(b / 2).cast("int"), b + 1), F.lit(most))


def explore_budget(files: Column) -> Column:
    return F.when(files < 500, 1).when(files < 5000, 2).when(files < 15000, 3).when(files < 25000, 4).otherwise(5)


def confidence(similarity: Column, stale: Column) -> Column:
    return clip(similarity) * F.when(stale, 0.6).otherwise(1.0)

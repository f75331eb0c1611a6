"""Ignore files against what their rules say, case by case."""

import pytest

from glyphmill.operators.ignores import ignored

CASES = [  # rules by folder, path, whether it is left out
    ({"": "*.log"}, "a/b.log", True), ({"": "*.log\n!b.log"}, "a/b.log", False), ({"": "!b.log\n*.log"}, "a/b.log", True), ({"": "/b"}, "a/b", False), ({"": "/b"}, "b", True), ({"": "b/"}, "b", False),
    ({"": "b/"}, "a/b/c", True), ({"": "a/b"}, "x/a/b", False), ({"": "a/b"}, "a/b/c", True), ({"": "**/b"}, "x/y/b", True), ({"": "a/**/b"}, "a/b", True), ({"": "a/**/b"}, "a/x/y/b", True), ({"": "a/**"}, "a/x", True),
    ({"": "a/*"}, "a/x/y", True), ({"": "a/*\n!a/x"}, "a/x/y", False), ({"": "a/\n!a/x"}, "a/x", True), ({"": "a?c"}, "abc", True), ({"": "a?c"}, "a/c", False), ({"": "[ab].c"}, "b.c", True), ({"": "[!ab].c"}, "b.c", False),
    ({"": "[!ab].c"}, "d.c", True), ({"": "\\!x"}, "!x", True), ({"": "\\#x"}, "#x", True), ({"": "#x"}, "#x", False), ({"": "x  "}, "x", True), ({"": "x\\ "}, "x ", True), ({"": "a.c"}, "abc", False), ({"": "a+(b)"}, "a+(b)", True),
    ({"a": "x"}, "a/b/x", True), ({"a": "x"}, "b/x", False), ({"a": "/x"}, "a/b/x", False), ({"": "x", "a": "!x"}, "a/x", False), ({"": "!x", "a": "x"}, "a/x", True), ({"a/b": "!x", "a": "x"}, "a/b/x", False), ({"": "[a"}, "[a", True),
    ({}, "p/node_modules/x.js", True), ({}, "node_modules", False), ({}, "p/foo.egg-info/x", True), ({}, "p/bazel-out/x", True), ({"": "!vendor/"}, "vendor/x", False), ({"p": "!dist/"}, "p/dist/x", False), ({"p": "!dist/"}, "dist/x", True),
    ({}, "src/a.go", False), ({}, "distant/a.go", False), ({"": "é*"}, "x/éa", True), ({"": "\n  \n"}, "a", False), ({"": "x\r\ny"}, "x", True),
]


@pytest.mark.parametrize("group", [0, 1])
def test_rules(spark, group):
    """Each case has a tree of its own, below a folder with its number."""
    cases = [*enumerate(CASES)][group::2]
    lines = [(f"t{i}/{f}".rstrip("/"), n, line) for i, (rules, _, _) in cases for f, text in rules.items() for n, line in enumerate(text.split("\n"))]
    paths = spark.createDataFrame([(f"t{i}/{p}",) for i, (_, p, _) in cases] + [(None,), (f"t{cases[0][0]}/{cases[0][1][1]}",)], "path string")
    found = {r["path"]: r["ignored"] for r in ignored(paths, spark.createDataFrame([*lines, (None, 0, "*")], "folder string, nth int, line string")).collect()}
    assert [(c, found[f"t{i}/{c[1]}"]) for i, c in cases] == [(c, c[2]) for _, c in cases] and len(found) == len(cases)

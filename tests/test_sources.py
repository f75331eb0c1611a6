"""Comment blanking, import clauses and import paths against known values."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import source
from glyphmill.operators import resolution


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("language", "text", "clean"),
    [
        ("python", "x = 1  # path('/a')\ny = '# no'", "x = 1" + " " * 14 + "\ny = '# no'"),
        ("python", '"""doc\n\'x\'"""\nz = 2', " " * 6 + "\n" + " " * 6 + "\nz = 2"),
        ("javascript", 'a("//x") // y', 'a("//x")     '), ("javascript", "`/* no */` /* a\nb */ c", "`/* no */`     \n     c"),
        ("java", "char c = '\"'; // x", "char c = '\"';     "), ("go", "s := `// raw` /* open", "s := `// raw`        "),
        ("php", "#[Route('/a')] # gone", "#[Route('/a')]       "), ("ruby", "a\n=begin\nx\n=end\nb == 1 # c", "a\n      \n \n    \nb == 1    "),
        ("none", "# kept", "# kept"), ("python", None, ""), ("javascript", "", ""),
    ],
)
def test_without_comments(spark, language, text, clean):
    assert one(spark, source.without_comments(F.lit(text).cast("string"), language))[0] == clean


def test_long_strings_do_not_overflow(spark):
    long = "'" + "\\n a" * 30_000 + "' # gone"
    out = one(spark, source.without_comments(F.lit(long), "python"))[0]
    assert len(out) == len(long) and "gone" not in out


@pytest.mark.parametrize(
    ("language", "text", "rows"),
    [
        ("javascript", "import D, { a as b, type C, } from './m';\nimport * as ns from \"p/q\";\nconst r = require('r');\nconst { x: y, z } = require('s')",
         {("D", "default", "./m"), ("b", "a", "./m"), ("C", "C", "./m"), ("ns", "*", "p/q"), ("r", "*", "r"), ("y", "x", "s"), ("z", "z", "s")}),
        ("python", "from .a import (b,\n  c as d)\nfrom x.y import z\nimport os.path\nimport numpy as np\n", {("b", "b", ".a"), ("d", "c", ".a"), ("z", "z", "x.y"), ("os", "*", "os.path"), ("np", "*", "numpy")}),
        ("go", 'import "fmt"\nimport (\n\tx "a/b"\n\t"net/http"\n)\n', {("fmt", "*", "fmt"), ("x", "*", "a/b"), ("http", "*", "net/http")}),
        ("java", "import a.b.C;\nimport static a.B.m;\nimport q.*;\n", {("C", "C", "a.b"), ("m", "m", "a.B"), ("*", "*", "q")}),
        ("php", "use A\\B\\C;\nuse D\\E as F;", {("C", "C", "A\\B\\C"), ("F", "E", "D\\E")}), ("c", "#include <a/b.h>\n# include \"c.h\"", {("b.h", "*", "a/b.h"), ("c.h", "*", "c.h")}),
        ("cobol", "import x", set()), ("python", "", set()),
    ],
)
def test_imports(spark, language, text, rows):
    assert {tuple(r) for r in one(spark, source.imports_of(F.lit(text), language))[0]} == rows


def test_reexports_of(spark):
    out = one(spark, source.reexports_of(F.lit("export * from './a'; export { x as y, z } from './b'; export const q = 1")))[0]
    assert {tuple(r) for r in out} == {("*", "*", "./a"), ("y", "x", "./b"), ("z", "z", "./b")}


def test_candidates(spark):
    first = lambda *a: one(spark, source.import_candidates(*a))[0]
    assert first(F.lit("src/a"), F.lit("../b/./c"), "javascript")[:2] == ["src/b/c", "src/b/c.ts"]
    assert first(F.lit("src/a"), F.lit("react"), "javascript") is None
    assert first(F.lit("src/a"), F.lit("@/x"), "typescript", (("@/", "lib"),))[1] == "lib/x.ts"
    assert first(F.lit("p/q"), F.lit("..r.s"), "python") == ["p/r/s.py", "p/r/s/__init__.py"]
    assert first(F.lit("p/q"), F.lit("r.s"), "python")[0] == "r/s.py"


def test_reexport_chains(spark):
    exports = spark.createDataFrame([("a", "*", "b", "*"), ("b", "x", "c", "y"), ("c", "*", "a", "*")], "file string, local string, target string, exported string")
    refs = spark.createDataFrame([("a", "x"), ("a", "none"), ("c", "y")], "file string, name string")
    defined = spark.createDataFrame([("c", "y")], "file string, name string")
    out = {tuple(r) for r in resolution.through_reexports(refs, exports, defined).collect()}
    assert out == {("a", "x", "c", "y", 2), ("c", "y", "c", "y", 0)}
    assert {tuple(r)[:2] for r in resolution.through_reexports(refs, exports, defined, depth=1).collect()} == {("c", "y")}


def test_inherited_members(spark):
    calls = spark.createDataFrame([("d", "m"), ("d", "n"), ("b", "m")], "type string, member string")
    members = spark.createDataFrame([("a", "m"), ("b", "m")], "owner string, member string")
    above = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("a", "d")], "sub string, super string")
    assert {tuple(r) for r in resolution.inherited_members(calls, members, above).collect()} == {("d", "m", "b", 2), ("b", "m", "b", 0)}


def test_resolved_imports(spark):
    files = spark.createDataFrame([("p/a.ts",), ("p/b/index.ts",)], "path string")
    asked = spark.createDataFrame([("p/x.ts", "typescript", "x", "x", s) for s in ("./a", "./b", "./c", "ext")], "path string, language string, local string, exported string, source string")
    out = {r["source"]: r["target"] for r in resolution.resolved_imports(asked, files).collect()}
    assert out == {"./a": "p/a.ts", "./b": "p/b/index.ts", "./c": None, "ext": None}

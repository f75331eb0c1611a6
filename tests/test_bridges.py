"""Known pairs of Swift declarations and selectors, both ways."""

from pyspark.sql import functions as F

from glyphmill.operators import bridges

DECLARED = [
    ("@objc func play()", ["play"]), ("@objc func play(_ song: String)", ["play:"]), ("@objc func play(song: String)", ["playWithSong:"]), ("@objc func play(song s: String, by a: Artist)", ["playWithSong:by:"]),
    ("@objc func play(_ s: String, by a: Artist)", ["play:by:"]), ("@objc init()", ["init"]), ("@objc init(name: String)", ["initWithName:"]), ("@objc init(_ name: String, age: Int)", ["initWithName:age:"]),
    ("@objc init?(coder c: NSCoder)", ["initWithCoder:"]), ("@objc(go:with:) func play(a: Int, b: Int)", ["go:with:"]), ("@objc var name: String", ["name", "setName:"]), ("@objc(title) var name: String", ["title", "setTitle:"]),
    ("@objc static func of<T>(kind: T)", ["ofWithKind:"]),
]
MEANT = [
    ("play", {"play"}), ("play:", {"play"}), ("playWithSong:", {"play", "playWithSong"}), ("play:by:", {"play"}), ("initWithName:age:", {"init", "initWithName"}), ("setName:", {"setName", "name"}), ("setName:for:", {"setName"}),
    ("objectForKey:", {"object", "objectForKey"}), ("tableView:didSelectRowAtIndexPath:", {"tableView"}), ("settle:", {"settle"}), ("Format:", {"Format"}),
]


def test_pairs(spark):
    df = spark.createDataFrame([(d,) for d, _ in DECLARED] + [("func hidden()",), ("@objc @nonobjc func no()",), ("@objc class A",), (None,)], "declaration string")
    found = {r["declaration"]: r["s"] for r in bridges.declared(df, "declaration").withColumn("s", bridges.selectors()).collect()}
    assert found == dict(DECLARED)
    asked = spark.createDataFrame([(s,) for s, _ in MEANT], "selector string")
    assert {r[0]: set(r[1]) for r in asked.select("selector", bridges.base_names(F.col("selector"))).collect()} == {s: m | ({"init"} if s.startswith("initWith") else set()) for s, m in MEANT}


def test_exact_before_base(spark):
    declared = spark.createDataFrame([("b.swift", "@objc func play(song: Int)"), ("a.swift", "@objc func play()"), ("c.swift", "@objc func play(song: Int)"), (None, "@objc func lost()")], "path string, declaration string")
    calls = spark.createDataFrame([("playWithSong:",), ("playWithSong:",), ("playForKey:",), ("lost",), ("none:",), (None,), ("",)], "selector string")
    assert sorted(map(tuple, bridges.bridged(calls, declared).collect())) == [("playForKey:", "a.swift", "play", 0.6), ("playWithSong:", "b.swift", "play", 0.9)]

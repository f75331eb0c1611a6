"""The cascade on a small tree, and streams with state against the same rows one by one."""

import json

from pyspark.sql import functions as F

from glyphmill.operators import cascade
from glyphmill.plans import bindings as b
from glyphmill.streaming import bandit, events

SF = "/root/testdata/sf0.001"
SYMBOL = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean"
REF = "ref string, name string, ref_kind string, language string, file string, line int"


def found(spark, symbols, refs, imports=None):
    s, r = spark.createDataFrame(symbols, SYMBOL), spark.createDataFrame(refs, REF)
    i = None if imports is None else spark.createDataFrame(imports, "file string, local string, target string, confidence double")
    return {x["ref"]: (x["target"], x["confidence"], x["strategy"]) for x in cascade.cascade(r, s, i).collect()}


def test_tiers(spark):
    symbols = [
        ("c1", "class", "Store", "Store", "a/b/Store.java", "java", 1, True), ("m1", "method", "save", "Store::save", "a/b/Store.java", "java", 5, True),
        ("m2", "method", "save", "Other::save", "x/Other.java", "java", 5, True), ("f1", "function", "get", "get", "v/views.py", "python", 1, True),
        ("f2", "function", "near", "near", "a/b/N.java", "java", 1, False), ("f3", "function", "near", "near", "z/N.java", "java", 1, True),
        ("k1", "class", "Bar", "com.x::Bar", "p/Bar.kt", "kotlin", 1, True), ("k2", "class", "Bar", "com.x::Bar", "a/b/Bar.kt", "kotlin", 1, True),
    ]
    at = "a/b/Main.java"
    refs = [
        ("direct", "Store.save", "calls", "java", at, 1), ("capital", "store.save", "calls", "java", at, 1), ("words", "my_Other.save", "calls", "java", at, 1),
        ("near", "near", "calls", "java", at, 1), ("abroad", "get", "calls", "java", at, 1), ("view", "get", "calls", "python", "v/urls.py", 1),
        ("package", "com.x.Bar", "imports", "java", at, 1), ("builtin", "append", "calls", "python", "v/urls.py", 1), ("std", "fmt.Println", "calls", "go", "m.go", 1),
        ("react", "useState", "calls", "tsx", "m.tsx", 1), ("unknown", "nothing", "calls", "java", at, 1), ("bound", "alias", "calls", "java", at, 1), ("null", None, "calls", "java", at, 1),
    ]
    got = found(spark, symbols, refs, [(at, "alias", "c1", 0.9)])
    assert got == {
        "direct": ("m1", 0.85, "method"), "capital": ("m1", 0.8, "method"), "words": ("m2", 0.65, "method"), "near": ("f2", 0.7, "exact"), "abroad": ("f1", 0.5, "exact"),
        "view": ("f1", 0.9, "exact"), "package": ("k2", 0.95, "package"), "bound": ("c1", 0.9, "import"),
    }


def test_type_stays_in_its_family(spark):
    symbols = [("s1", "class", "Battery", "Battery", "a/Battery.js", "javascript", 1, True)]
    assert found(spark, symbols, [("r", "Battery", "references", "java", "a/M.java", 1)]) == {}
    assert found(spark, symbols, [("r", "Battery", "references", "tsx", "a/M.tsx", 1)]) == {"r": ("s1", 0.5, "exact")}


def test_empty(spark):
    assert found(spark, [], []) == {}


def test_source_bandit_stream_is_rows_one_by_one(spark):
    got = {r["event_id"]: (r["action"], r["source"], r["breadth"]) for r in events.source_bandit(spark, SF).collect()}
    rows = events.traced(b.table(spark, SF, "events")).where("intent is not null").orderBy("ts", "event_id").collect()
    banks, want = {}, {}
    for r in rows:
        key = f"{r['intent']}/{r['repo']}"
        want[r["event_id"]] = banks.setdefault(key, bandit.SourceBandit(key, events.SOURCES)).add(r["raw"])
    assert got == want
    assert {"current", "try", "base"} <= {a for a, _, _ in got.values()}


def test_source_bandit_learns_and_keeps_bounds():
    own = bandit.SourceBandit("k", ("a",))
    seen = set()
    for _ in range(5000):
        live = own.s["live"]
        action, _, served = own.add(1.0 if live and live["value"] > live["from"] else 0.0)
        seen.add(action)
        assert served is None or bandit.SourceBandit.LEAST <= served <= bandit.SourceBandit.MOST
        own = bandit.SourceBandit("k", ("a",), json.dumps(own.s))
    assert "rollback" in seen


def test_feedback_without_a_trace_is_dropped(spark):
    ids = {r[0] for r in b.table(spark, SF, "events").select("event_id").collect()}
    asked = events.traced(b.table(spark, SF, "events")).where("k > 0").select("event_id", (F.col("event_id") - F.col("k")).alias("t")).collect()
    got = {r["event_id"] for r in events.feedback(spark, SF).select("event_id").collect()}
    assert got == {r["event_id"] for r in asked if r["t"] in ids}
    assert len(got) < len(asked)

"""An updated graph equals one built anew, and only the parts that change are written."""

import random

from glyphmill.operators.incremental import FileGraph
from glyphmill.plans.incremental import extract


def frame(spark, files):
    return spark.createDataFrame([*files.items(), (None, "def ghost")], "path string, content string")


def links(files):
    where = {}
    for p, text in files.items():
        for line in (text or "").split("\n"):
            if line.startswith("def "):
                where[line[4:]] = min(p, where.get(line[4:], p))
    return sorted({(p, line[4:], where[line[4:]]) for p, text in files.items() for line in (text or "").split("\n") if line.startswith("use ") and line[4:] in where})


def test_updates(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: "\n".join([*(f"def n{rng.randrange(60)}" for _ in range(rng.randrange(3))), *(f"use n{rng.randrange(60)}" for _ in range(rng.randrange(5)))])
    files = {f"f{i}": text() for i in range(120)} | {"empty": "", "none": None}
    graph = FileGraph(spark, f"{tmp_path}/g", extract, parts=16)
    told = graph.update(frame(spark, files))
    assert told["added"] == 122 and sorted(map(tuple, graph.links.read(0).collect())) == links(files)
    # nothing changes: nothing is written
    told = graph.update(frame(spark, files))
    assert {told[k] for k in ("files", "symbols", "refs", "links", "added", "modified", "removed", "moved")} == {0}
    # a file that defines nothing and uses nothing: one part of each table
    told = graph.update(frame(spark, files | {"empty": "\n"}))
    assert (told["modified"], told["files"], told["links"], told["moved"]) == (1, 1, 1, 0)
    files["empty"] = "\n"
    for _ in range(3):
        for i in rng.sample(range(120), 6):
            files[f"f{i}"] = text()
        files.pop(rng.choice([k for k in files if k.startswith("f")]))
        files[f"g{rng.randrange(1000)}"] = text()
        told = graph.update(frame(spark, files))
        assert sorted(map(tuple, graph.links.read(graph.version).collect())) == links(files)
        assert 0 < told["files"] <= 9 and told["added"] == told["removed"] == 1
    # a name that moves is followed in files that didn't change
    before = graph.version
    files["a"] = "def n1\ndef n2"
    told = graph.update(frame(spark, files))
    assert (told["added"], told["files"]) == (1, 1) and told["moved"] == 2
    assert sorted(map(tuple, graph.links.read(graph.version).collect())) == links(files)
    assert sorted(map(tuple, graph.links.read(before).collect())) == links({k: v for k, v in files.items() if k != "a"})  # an old version can still be read
    # a version that failed before its manifests is written again
    again = FileGraph(spark, f"{tmp_path}/g", extract, parts=16)
    again.version = before
    again.update(frame(spark, files))
    assert sorted(map(tuple, again.links.read(again.version).collect())) == links(files)
    graph.update(frame(spark, {}))
    assert graph.links.read(graph.version).count() == 0 == graph.files.read(graph.version).count()

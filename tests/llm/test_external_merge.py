"""The merge of index runs in passes: memory that doesn't follow the number or length of runs, and one order in the end."""

import random

from glyphmill.llm import warc


def row(key, n, run=None):
    return (key, "2024-01-01T00:00:00Z", n, 1, "d", "response", None, 0, n, *([run] if run else []))


def test_a_merge_holds_few_blocks():
    rng = random.Random(1)
    held = {}
    for length in (500, 5000):
        runs = [sorted((row(f"k{rng.randrange(10**6):06d}", rng.randrange(10**6)) for _ in range(length)), key=warc._order) for _ in range(8)]
        blocks = sorted(((i, run[j : j + 16]) for i, run in enumerate(runs) for j in range(0, length, 16)), key=lambda b: (warc._order(b[1][0]), b[0]))
        merge, out, held[length] = warc.Merge(8), [], 0
        for i, block in blocks:
            out += merge.until(warc._order(block[0]))
            merge.take(i, block)
            held[length] = max(held[length], sum(map(len, merge.rows)))
        out += merge.until(None)
        assert out == sorted((r for run in runs for r in run), key=warc._order)
    assert max(held.values()) <= 8 * 16 * 2


def test_many_runs_in_passes(spark, monkeypatch):
    """500 runs, eight at once: three passes before the last, over several ranges, one key among them that many rows share."""
    monkeypatch.setattr(warc, "FAN_IN", 8)
    monkeypatch.setattr(warc, "BLOCK_ROWS", 4)
    monkeypatch.setattr(warc, "RANGE_ROWS", 900)
    passes, written = [], warc.written
    monkeypatch.setattr(warc, "written", lambda df, name: passes.append(name) or written(df, name))
    rng = random.Random(2)
    rows = [row("hot" if rng.random() < 0.4 else f"é{rng.randrange(300)}", None if i % 97 == 0 else rng.randrange(10**5), f"file-{i % 500}") for i in range(3000)]
    out = [tuple(r) for r in warc.histories(spark.createDataFrame(rows, warc._INDEX)).collect()]
    assert sorted(out, key=str) == sorted(rows, key=str) and passes.count("warc-merged") == 2 + (500 > 8**3)
    keys = [warc._order(r) for r in out]
    assert keys == sorted(keys)
    assert warc.histories(spark.createDataFrame([], warc._INDEX)).count() == 0

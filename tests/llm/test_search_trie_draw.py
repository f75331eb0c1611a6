"""The block matrix join, the prefix trie and the resampling against brute force, on nulls, ties, repeated rows, hot keys and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import blockjoin, common, queries, resampling, trie

EXTRA = "row int, id string, score string, block int, part int, rank string, key string, n int, w int, m string, depth string, stripe int, x string, nameless string"


def clashing(df):
    return df.withColumns({name: F.lit("1").cast(kind) for name, kind in (c.split() for c in EXTRA.split(", ")) if name not in df.columns})


def plain_sum(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=False):
        out += x * y
    return out


@pytest.mark.parametrize("sizes", [(8192, 65536), (7, 50)])
def test_nearest(spark, sizes):
    rng = np.random.default_rng(3)
    vec = lambda scale=1.0: [float(np.float32(v)) for v in rng.normal(0, scale, 6)]
    hot = vec()
    rows = [(i, vec()) for i in range(300)] + [(i, hot) for i in range(300, 420)] + [(20, vec()), (40, hot), (40, hot), (7, vec(1e-30)), (8, vec(1e12)), (9, [3.0]), (600, [0.5, -1.0])]
    rows += [(None, hot), (None, vec(3.0)), (500, None), (501, []), (502, [0.0] * 6), (503, [1.0, None]), (504, [float("nan")] * 6), (505, [float("inf")] * 6)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).repartition(5)
    found = blockjoin.nearest(df, F.col("id") % 20 == 0, query_rows=sizes[0], stripe_rows=sizes[1])
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    want = []
    for n, (q, x) in enumerate(good):
        if q is not None and q % 20 == 0:
            best = sorted((-plain_sum(x, v), i is None, i or 0) for m, (i, v) in enumerate(good) if m != n)[:20]
            want += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(best, 1)]
    key = lambda r: (r[0], r[1], r[3], r[2] or -1)
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()), key=key) == sorted(want, key=key)
    assert found.columns == ["query_id", "rank", "vec_id", "score"] and blockjoin.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_error_bounds_hold():
    """The product in double precision lies within the error of its estimate, over many scales and wide vectors."""
    rng = np.random.default_rng(5)
    for width in (1, 64, 3000):
        x, y = rng.normal(0, 1, (40, width)) * 10.0 ** rng.integers(-8, 8, (40, 1)), rng.normal(0, 1, (50, width)) * 10.0 ** rng.integers(-8, 8, (50, 1))
        near, error = blockjoin.bounds(blockjoin.Codes(x), blockjoin.Codes(y))
        exact = np.array([[math.fsum(a * b) for b in y] for a in x])
        assert (np.abs(exact - near) <= error).all()
        assert (error <= 0.05 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)).all()
    assert blockjoin.products(np.full((1, 3000), 127, dtype=np.int8), np.full((1, 3000), -127, dtype=np.int8))[0, 0] == -127 * 127 * 3000


def test_few_pairs_are_computed_again(monkeypatch):
    rng = np.random.default_rng(7)
    x, seen = rng.normal(0, 1, (4096, 64)), []
    inner = blockjoin.inner
    monkeypatch.setattr(blockjoin, "inner", lambda a, b: seen.append(len(a)) or inner(a, b))
    best = blockjoin.Nearest(x[:32], np.arange(32), 20)
    for i in range(0, 4096, 1024):
        rows = np.arange(i, i + 1024)
        best.meet(x[rows], rows, rows, np.ones(1024, dtype=bool))
    assert sum(seen) < 32 * 4096 // 20
    for q, heap in enumerate(best.heaps):
        assert {-h[3] for h in heap} == set(np.argsort(-(x @ x[q]), kind="stable")[:21]) - {q} or len(heap) == 20


def brute_trie(seqs):
    """seqs: conv_id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    out = []
    for p, convs in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in convs if len(seqs[c]) == len(p))))
        out.append((min(convs), len(p), min(nodes[p[:-1]]) if p else None, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def told(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(df.columns) == sorted(names)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_turns", [1, 3, 4])
def test_trie(spark, block_turns, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HEAVY", 3)  # so that heavy conversations and parents are met
    monkeypatch.setattr(trie, "CHUNK_IDS", 4)
    rng = random.Random(2)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "c" * 50]))
    seqs = {c: [turn() for _ in range(rng.randint(1, 9))] for c in range(-20, 40)}
    seqs |= {c: seqs[1] for c in range(100, 140)} | {c: [*seqs[1][:3], turn(), turn()] for c in range(140, 160)} | {200: [("u", str(i)) for i in range(300)], 201: [("u", str(i)) for i in range(150)]}
    rows = [(c, i, *t) for c, s in seqs.items() for i, t in enumerate(s)]
    rows[0] = (rows[0][0], None, *rows[0][2:])  # null comes first
    rows = [(c, t, None if r == "user" else r, x or None) for c, t, r, x in rows] + [(None, 0, "u", "x")]
    seqs = {c: [("" if r == "user" else r, x) for r, x in s] for c, s in seqs.items()}
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).repartition(6)
    turns = trie.digested(df)
    everyone = turns.select("conv_id").unionByName(spark.createDataFrame([(500,), (501,), (None,)], "conv_id long"))
    assert told(trie.prefix_trie(turns, everyone, block_turns=block_turns)) == brute_trie(seqs | {500: [], 501: []})


def test_trie_of_ties_repeats_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    twice = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, 5, "u", "x"), (2, 5, "a", "y" * 100_000)]
    found = told(trie.prefix_trie(trie.digested(spark.createDataFrame(twice, schema))))
    assert found == told(trie.prefix_trie(trie.digested(spark.createDataFrame(twice[::-1], schema)))) and found[0][3] == 2
    assert found[0][:2] == (1, 0) and sum(f[4] == 0 for f in found) == 2
    none = trie.digested(spark.createDataFrame([], schema))
    assert told(trie.prefix_trie(none)) == []
    alone = spark.createDataFrame([(3,)], "conv_id long")
    assert told(trie.prefix_trie(none, alone)) == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_rebuilt_conversations(spark, tmp_path):
    """The registered query over a table with negative ids, gaps, nulls and absent bases."""
    rng = random.Random(4)
    turns = {c: [(t, rng.choice("ua"), rng.choice(["x", "y", "zé"])) for t in range(rng.randint(1, 12))] for c in [*range(-13, 30), 101, 104, 107]}
    rows = [(c, t, r, x) for c, own in turns.items() for t, r, x in own]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        seqs[c] = [(r, x) for _, r, x in [*turns.get(base, [])[:h], *own[h:]]]
    assert told(queries.op12_prefix_trie(spark, str(tmp_path))) == brute_trie(seqs)


def test_running_sums(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), i, rng.randint(-5, 5), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, at long, v long, part long").repartition(7)
    out = common.running_sums(df, ["key"], [F.col("at")], ["v"], "test-sums")
    so_far, want = defaultdict(int), []
    for k, i, v, p in rows:
        so_far[k] += v
        want.append((k, i, so_far[k], p))
    assert sorted(map(tuple, out.collect())) == sorted(want) and out.columns == df.columns
    assert [r["v"] for r in common.running_sums(df, [], [F.col("at")], ["v"], "test-sums").orderBy("at").collect()] == list(np.cumsum([r[2] for r in rows]))
    assert common.running_sums(df.limit(0), ["key"], [F.col("at")], ["v"], "test-sums").count() == 0


def brute_draw(docs, target, seed, longest, min_words, n_buckets=10_000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    feats = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = defaultdict(int), defaultdict(int)
    for of, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for f in feats(x):
                of[bucket(f)] += 1
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + n_buckets) / ((s[b] + 1.0) * (t_all + n_buckets))))
    out = []
    for doc, text in docs:
        own = feats(text)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    can = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(can[: 10 * len(can) // 100], 1):
        r[4] = i
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_draw(spark, longest, monkeypatch):
    monkeypatch.setattr(resampling, "PIVOTS", 3)
    monkeypatch.setattr(resampling, "MEMORY", 50)
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["Alpha", "beta", "élan", "x1", "GAMMA", "\x00", "ß", "_"]) for _ in range(rng.randint(1, 60)))
    docs = [(i, text()) for i in range(400)] + [(500, None), (501, ""), (None, text() + " beta" * 30), (None, text() + " x1" * 40), (502, "beta " * 20_000)]
    docs += [docs[3]] * 40 + [(7, "beta " * 25)]  # rows that repeat all, or the id alone
    target = ["beta élan beta", None, "x1 ß"]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    found = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), seed=11, longest=longest)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert sorted(map(tuple, found.collect()), key=str) == brute_draw(docs, target, 11, longest, 20)
    none = df.limit(0)
    assert resampling.resample(none, none).count() == 0
    assert [r["rank"] for r in resampling.resample(df.where("doc_id BETWEEN 10 AND 15"), none).collect()] == [None] * 6


def test_kth_key(spark):
    """Each place is found exactly, whatever the pivots, over scores that are nearly all equal."""
    rows = [(5 if i % 3 else i % 7, 0, i // 2, 4, i) for i in range(200)]
    keys = spark.createDataFrame(rows, "score long, nameless int, doc_id long, n_features long, row long")
    want = sorted(rows, key=lambda r: (-r[0], *r[1:]))
    for k in (1, 2, 77, 199, 200):
        assert resampling.kth_key(keys, k, seed=k) == want[k - 1]
    assert resampling.kth_key(keys, 0, 1) is None and resampling.kth_key(keys, 201, 1) is None

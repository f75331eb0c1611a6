"""Brute-force versions that share no code with the operators, and the inputs that have broken them before."""

import gzip
import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import digest, linededup, minhash, mixing, quality, queries, sharding, topk, url_terms, urls, warc

SF = "/root/testdata/sf0.01"
CLASHING = "id long, key long, size long, score double, row int, hash long, text_hash string, __doc_id int, n_lines string, part int, mark string, doc string, srcs int, taken int, place int, host string"


def clashing(df):
    """df with columns named like those that the operators make for themselves."""
    return df.withColumns({name: F.lit("1").cast(kind) for name, kind in (c.split() for c in CLASHING.split(", ")) if name not in df.columns})


def test_topk_of_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(100, [3e6, -2e6, 1.0, 0.0]), (101, [0.0, 0.0, 4e9, 1.0]), (200, [1e-3, 0.0, 0.0, -1.0]), (200, [0.5] * 4)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.impact_topk(df, F.col("id") % 100 == 0, block_rows=20).collect())
    ints = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    want = []
    for n, (q, x) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for m, (i, v) in enumerate(ints) if m != n)[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert found == sorted(want)
    far = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.impact_topk(far, F.col("id") % 100 == 0).collect()


def test_a_line_repeated_in_one_document(spark):
    rows = [(1, "x\n" * 20_000 + "y"), (2, "x\nz"), (3, "z")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r for r in linededup.dedup_lines(df, min_docs=2).collect()}
    assert {k: (r["text"], r["n_dropped"]) for k, r in found.items()} == {1: ("y", 20_000), 2: ("", 2), 3: ("", 1)}
    assert found[1]["text_hash"] == "1" and found[1]["__doc_id"] == 1


def test_url_vocabulary(spark):
    terms = spark.createDataFrame([("casino", "strict", None), ("free", "soft", 0.5), ("bets", "soft", 1.0), ("win", "soft", 9.0), ("free", "soft", 0.25), ("", "soft", 1.0), (None, "strict", 1.0)], "term string, kind string, weight double")
    own = urls.vocabulary(terms)
    verdict = lambda u, t=own, n=2: urls.UrlFilter((), t, n).judge(u)[3]
    assert [verdict(u) for u in ("http://a/casino", "http://a/free-bets", "http://a/win-bets", "http://a/win-win", "http://a/casinoé", "http://a/écasino")] == ["block", "allow", "block", "allow", "allow", "allow"]
    assert verdict("http://a/bets", n=1) == "block" and verdict("http://a/free", n=1) == "allow" and verdict("http://a/casino", ()) == "allow"
    pages = clashing(spark.createDataFrame([(None, "http://a.com/en/casino" + "x" * 200_000), (1, None), (1, None)], "page_id long, url string"))
    assert [r["verdict"] for r in urls.filter_urls(pages, queries.URL_RULES, terms=()).collect()] == ["block", "allow", "allow"]


def test_url_terms_are_weighed():
    """What the table's weights are for: a word of a topic needs another, and those that sell need more."""
    terms = url_terms.entries()
    assert len({t for t, *_ in terms}) > 200 and {x[3] for x in terms} == {"en", "de", "fr", "es"} and all((w * 8).is_integer() and (w < 1) == (k == "soft") for _, k, w, _, _ in terms)
    assert len(urls.WEIGHTS) == len({t for t, *_ in urls.WEIGHTS}), "a term has one kind and one weight"
    verdict = lambda u: urls.UrlFilter((), urls.WEIGHTS).judge(u)[3]
    blocked = ("http://casino.a/x", "http://free-bets.a", "http://cheap-pills.a/", "http://a/wetten/gratis", "http://a/paris?apuestas=oferta", "http://singles.a/flirt", "http://a/best-free-deals-now")
    kept = ("http://bets.a", "http://a/free-win", "http://a/diet", "http://a/casinos1x", "http://essex.a/sextant/free", "http://a/free/free/free/free", "http://de.a/treffen")
    assert [verdict(u) for u in blocked + kept] == ["block"] * len(blocked) + ["allow"] * len(kept)


def test_nnpu_against_a_numeric_minimum():
    """The fitted weights have no higher risk than nearby ones, by a risk written out row by row."""
    rng = np.random.default_rng(4)
    n = quality.N_FEATURES
    good, bad = rng.uniform(0.4, 1, (200, n)), rng.uniform(0, 0.6, (300, n))
    p, u = good[:100], np.vstack([good[100:], bad])
    prior = 0.25
    model = quality.fit_nnpu(p, u, prior, steps=3000, rate=0.02, decay=0.0)

    def risk(weight, bias):
        z = lambda x: [float(((np.append(r, np.sqrt(r)) - model.mean) / model.scale) @ weight + bias) for r in x]
        loss = lambda zs, y: sum(np.logaddexp(0, -y * v) for v in zs) / len(zs)
        zp, zu = z(p), z(u)
        return prior * loss(zp, 1) + max(0.0, loss(zu, -1) - prior * loss(zp, -1))

    least = risk(model.weight, model.bias)
    assert least < risk(np.zeros(2 * n), 0.0) / 2
    for _ in range(30):
        step = rng.normal(0, 0.05, 2 * n)
        assert risk(model.weight + step, model.bias + rng.normal(0, 0.05)) > least - 0.02
    scores = model.score(np.vstack([good[100:], bad]))
    assert (scores[:100] >= 0.5).mean() > 0.95 and (scores[100:] < 0.5).mean() > 0.95


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_class_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(int(prior * 10))
    n = quality.N_FEATURES
    draw = lambda good, k: rng.normal(0.55 if good else 0.35, 0.15, (k, n)).clip(0, 1)  # noqa: E731  one feature tells little
    for n_p, n_u in ((1000, 3000), (3000, 6000)):
        k = int(prior * n_u)
        found = quality.class_prior(draw(True, n_p), rng.permutation(np.vstack([draw(True, k), draw(False, n_u - k)])))
        assert abs(found - prior) < 0.05, found
    assert quality.class_prior(draw(True, 1), draw(True, 1)) == 0.5


def test_quality_of_a_repeated_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chosen = labels.where("quality = 1").where(~quality.held_out(F.col("doc_id"))).select("doc_id").orderBy("doc_id").limit(1)
    repeated = docs.join(chosen, "doc_id").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).select("doc_id", F.concat_ws(" ", F.substring("text", 1, 20), "n").alias("text"))
    a, b = quality.train(docs, labels), quality.train(docs.unionByName(repeated), labels)
    assert np.abs(a.weight - b.weight).max() < 1.0  # one of 10,000 rows counts, and none of the others is pushed out
    some = clashing(docs.limit(5).unionByName(spark.createDataFrame([(None, None), (7, ""), (7, "")], "doc_id long, text string")))
    out = quality.classify(some, labels)
    assert out.count() == 8 and {"id", "hash", "row"} <= set(out.columns) and all(0 <= r["score"] <= 1 for r in out.collect())


def slow_digest(text):
    """The fingerprint, a byte at a time."""
    raw, counts = text.encode(), [0] * 256
    for i in range(len(raw)):
        a, b, c = (raw[(i + o) % len(raw)] for o in (0, 5, 11))
        h = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        h = ((h ^ h >> 15) * 0x27D4EB2F) & 0xFFFFFFFF
        counts[h >> 24] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    codes = [sum(x > y for y in q) for x in counts]
    length = 0
    while raw and length < 254 and 1.25 ** (length + 1) <= len(raw):
        length += 1
    head = length + 1 if raw else 0
    return f"{head:02x}" + "".join(f"{64 * codes[i] + 16 * codes[i + 1] + 4 * codes[i + 2] + codes[i + 3]:02x}" for i in range(0, 256, 4))


def test_digest_byte_by_byte():
    rng = random.Random(6)
    words = [" ".join("".join(rng.choice("abcdefghié") for _ in range(5)) for _ in range(n)) for n in (0, 1, 2, 3, 40, 400)]
    for t in [*words, "a", "ab" * 5, "abcdefghijk", "abcdefghijkl"]:
        assert digest.digest(t) == slow_digest(t), t
    text = words[-1]
    for n in (40, 62, 63, 64, 65, 66, 127, 128):
        assert digest.likeness(digest.digest(text[:n]), digest.digest(text[: n + 1])) > 0.65, n


def test_fingerprints_of_one_hot_id(spark):
    df = clashing(spark.createDataFrame([(None, f"text {i % 7}") for i in range(300)] + [(1, "a"), (2, None)], "doc_id long, text string").repartition(7))
    out = digest.compare_with_next(df).collect()
    assert len(out) == 302 and sum(r["near_next"] == 1.0 and r["doc_id"] is None for r in out) >= 290
    assert all(r["edited_sha256"] == hashlib.sha256(b"").hexdigest() for r in out if r["doc_id"] == 2)


def cheapest(patterns, targets, costs):
    """Least cost of a largest flow, one token at a time, by Bellman-Ford over all arcs."""
    arcs = []

    def arc(a, b, room, cost):
        arcs.append([a, b, room, cost, len(arcs) + 1])
        arcs.append([b, a, 0, -cost, len(arcs) - 1])

    for p, n in patterns.items():
        for c in costs:
            arc("start", ("p", p), n, c)
        for s in p:
            if s in targets:
                arc(("p", p), ("s", s), 10**6, 0)
    for s, t in targets.items():
        arc(("s", s), "end", t, 0)
    flow = cost = 0
    while True:
        far, via = defaultdict(lambda: 10**9, {"start": 0}), {}
        for _ in range(len(patterns) + len(targets) + 3):
            for i, (a, b, room, c, _) in enumerate(arcs):
                if room and far[a] + c < far[b]:
                    far[b], via[b] = far[a] + c, i
        if far["end"] >= 10**9:
            return flow, cost
        node = "end"
        while node != "start":
            i = via[node]
            arcs[i][2] -= 1
            arcs[arcs[i][4]][2] += 1
            node = arcs[i][0]
        flow, cost = flow + 1, cost + far["end"]


def test_route_against_a_plain_solver():
    rng = random.Random(11)
    for _ in range(25):
        sources = "abcd"[: rng.randint(2, 4)]
        patterns = {}
        for _ in range(rng.randint(1, 5)):
            patterns[tuple(sorted(rng.sample(sources, rng.randint(1, len(sources)))))] = rng.randint(1, 9)
        targets = {s: rng.randint(0, 14) for s in sources}
        costs = mixing.repeat_costs(rng.choice([1, 2, 3, 5]))
        found = mixing.route(patterns, {s: float(t) for s, t in targets.items()}, costs)
        sent, into = defaultdict(float), defaultdict(float)
        for (p, s), n in found.items():
            assert s in p and n >= 0
            sent[p] += n
            into[s] += n
        assert all(into[s] <= t + 1e-6 for s, t in targets.items()) and all(sent[p] <= n * len(costs) + 1e-6 for p, n in patterns.items())
        cost = sum(c * max(0.0, min(patterns[p], n - k * patterns[p])) for p, n in sent.items() for k, c in enumerate(costs))
        flow, least = cheapest(patterns, targets, costs)
        assert abs(sum(sent.values()) - flow) < 1e-6 and abs(cost - least) < 1e-6, (patterns, targets, costs)


def test_mix_repeats_beyond_three(spark):
    rows = [(i, "w " * 10, "small") for i in range(1)] + [(100 + i, "w " * 10, "big") for i in range(20)] + [(None, None, None), (5, "", "big"), (6, "long " * 50_000, "big")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    out = mixing.mix(df, most=5, weights=(1, 1, 1)).collect()
    assert len(out) == len(rows) and all(r["taken"] <= 5 * r["size"] for r in out)
    small = next(r for r in out if r["source"] == "small")
    assert small["target"] == 50 and small["taken"] == 50 and {"id", "doc", "srcs", "hash"} <= set(out[0].asDict())


def test_mix_comes_near_its_targets(spark):
    """Each source's words against targets worked out apart, at a distance below one document's size."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], len((r["text"] or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")) - (r["text"] or " ").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ").count(""), r["source"]) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:  # water filling, one source at a time
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        unit = left / sum(w for s, w in weight.items() if s not in full)
        target = {s: 3 * sizes[s] if s in full else unit * w for s, w in weight.items()}
        above = [s for s in order if s not in full and target[s] > 3 * sizes[s]]
        if not above:
            break
        full |= set(above)
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * target[r["source"]] + 1e-6 and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - target[s]) <= max(30, 0.002 * target[s]) for s in order), {s: taken[s] - target[s] for s in order}


def test_shards_keep_groups_and_sizes(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    out = sharding.shard(docs).collect()
    loads, shards, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    for r in out:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
        loads[r["shard"]] += r["size"]
        shards[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == [*range(len(s))] for s in slots.values())
    sizes = sorted((r["size"] for r in out), reverse=True)  # a plain greedy deal of single documents
    best = [0] * 24
    for n in sizes:
        heapq.heappush(best, heapq.heappop(best) + n)
    assert max(loads.values()) <= 1.02 * max(best) and min(loads.values()) >= 0.98 * min(best)


@pytest.mark.parametrize("numbered", [3, 250_000])
def test_shards_split_only_groups_above_an_even_share(spark, numbered, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED_ROWS", numbered)
    rows = [(None, "hot " * 50)] * 200 + [(i, f"text {i}" * 20) for i in range(400)] + [(1000 + i, "pair " * 40) for i in range(6)] + [(2000 + i, None) for i in range(30)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4).collect()
    by = defaultdict(set)
    loads = defaultdict(int)
    slots = defaultdict(list)
    for r in out:
        by[r["text_crc32"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert {len(s) for k, s in by.items() if k != zlib.crc32(b"hot " * 50)} == {1}
    assert max(loads.values()) - min(loads.values()) < 0.05 * sum(loads.values()) / 4
    assert all(sorted(s) == [*range(len(s))] for s in slots.values()) and len(out) == len(rows)


def test_archive_with_a_member_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "first" * 30_000), (2, "http://b/", "é"), (3, "http://b/", "")], "page_id long, url string, html string")
    records = [r[0].encode() + warc.END.encode() for r in warc.records(pages, id_col="page_id", url_col="url", html_col="html", min_revisit_bytes=0).collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "many.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "in" / "one.gz").write_bytes(gzip.compress(b"".join(records)))
    out = warc.index(spark, str(tmp_path / "in")).collect()
    assert sorted((r["page_id"], r["payload_bytes"]) for r in out) == [(1, 150_000)] * 2 + [(2, 2)] * 2 + [(3, 0)] * 2
    for r in out:
        member = next(part for at, part in warc.members((tmp_path / "in" / r["run"]).read_bytes()) if at == r["member"])
        assert f"<urn:page:{r['page_id']}>".encode() in member[r["offset"] :].split(b"\r\n\r\n")[0]
    with pytest.raises(ValueError, match="cut off"):
        [*warc.members(gzip.compress(b"abc" * 100)[:-9])]


def test_histories_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "FILE_BYTES", 300)
    rows = [(i, f"http://h{i % 3}.com/p", f"body {i % 40}") for i in range(150)] + [(None, "http://h1.com/p", "body 1")] * 3 + [(7, "http://h1.com/p", "body 7")]
    out = warc.round_trip(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    keys = [(r["url_key"].encode(), r["captured"], r["page_id"] is not None, r["page_id"] or 0) for r in out]
    assert keys == sorted(keys) and len(out) == len(rows)
    last = {f"body {b}": max(i for i, _, h in rows if h == f"body {b}" and i is not None) for b in range(40)}
    sha = {hashlib.sha1(h.encode()).hexdigest(): h for h in last}
    import base64

    for r in out:
        want = last[sha[base64.b32decode(r["payload_digest"]).hex()]]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == want else ("revisit", want))


@pytest.mark.parametrize("block", [4, 10_000])
def test_large_groups_lose_no_link(spark, block, monkeypatch):
    """One group with a main part, a second cluster, a bridge that no representative need know, and strangers."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "REPRESENTATIVES", 3)
    rng = random.Random(12)
    points = {i: rng.choice([0.0, 10.0, 100.0 + 7 * i, 5.0]) + rng.uniform(0, 1.2) for i in range(60)}
    points |= {100: 2.1, 101: 3.2, 102: 4.2}  # steps of up to 1.5 link 0..1.2 with 5..6.2
    near_of = lambda payload: (lambda i, rest: np.array([abs(float(payload[i]) - float(payload[j])) <= 1.5 for j in rest], dtype=bool))
    df = spark.createDataFrame([(9, len(points), i, str(x).encode()) for i, x in points.items()], "group long, size long, node long, payload binary").repartition(4)
    edges = minhash.linked(df, "payload", near_of)
    label = {i: i for i in points}
    for _ in points:
        for i in points:
            for j in points:
                if abs(points[i] - points[j]) <= 1.5:
                    label[i] = label[j] = min(label[i], label[j])
    found = {r["node"]: r["label"] for r in minhash.components(edges).collect()}
    assert {i: found.get(i, i) for i in points} == label


def test_components_of_hubs_and_paths(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB", 10)
    pairs = [(1000, i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(200)]
    found = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in [1000, *range(50)]) and all(found[2000 + i] == 2000 for i in range(201))

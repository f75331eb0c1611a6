"""Near duplicates by class: ids that repeat over different texts, blocks by weight, hot classes, and both ways to join edges."""

import random
import tracemalloc

import numpy as np
import pytest

from glyphmill.llm import common, minhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_an_id_of_two_texts_joins_no_strangers(spark):
    rng = random.Random(1)
    a, b = words(rng, 100), words(rng, 100)
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join([*a[:50], "zz", *a[51:]])), (9, " ".join(b)), (7, " ".join(a)), (None, " ".join(a)), (8, "")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=3, percent=85)
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in found.collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 5, True), (3, 3, True), (9, 5, False), (7, 3, False), (None, None, True), (8, 8, True)], key=str)


@pytest.mark.parametrize("shingles", [150, 1 << 21])
def test_blocks_by_weight_lose_no_link(spark, shingles, monkeypatch):
    """Chains of near copies of very different lengths, in blocks of few shingles and in one."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "REPRESENTATIVES", 3)
    monkeypatch.setattr(common, "LEAST_HEAVY", 2)
    rng = random.Random(2)
    rows = []
    for n in (12, 60, 400):
        base = words(rng, n)
        for i in range(25):  # each step changes one word, so that the ends of a chain are no near copies
            base = [*base]
            base[rng.randrange(n)] = words(rng, 1)[0]
            rows.append((len(rows), " ".join(base)))
    rows += [(len(rows) + i, rows[i % 3][1]) for i in range(30)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    label = [*range(len(rows))]
    for _ in range(30):
        for i, x in enumerate(sets):
            for j in range(i):
                if 100 * len(x & sets[j]) >= 85 * len(x | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(enumerate(label)) and len(set(label)) > 3


def test_memory_of_a_block():
    """A thousand long texts meet in blocks of BLOCK_SHINGLES; one block's comparison stays far below an executor's memory."""
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2**63, minhash.BLOCK_SHINGLES // 20, dtype=np.uint64)).tobytes() for _ in range(20)]
    tracemalloc.start()
    near = minhash._by_sets(80)(sets)
    assert not near(0, np.arange(1, 20)).any() and near(3, np.array([3])).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_both_ways(spark, few, monkeypatch):
    monkeypatch.setattr(minhash, "HUB", 10)
    monkeypatch.setattr(minhash, "FEW_EDGES", few)
    pairs = [(1000, i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(200)] + [(7, 7)]
    found = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in [1000, *range(50)]) and all(found[2000 + i] == 2000 for i in range(201))
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0

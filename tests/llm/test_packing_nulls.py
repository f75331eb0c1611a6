"""Tails of null and other ids in one bin."""

from collections import Counter

from glyphmill.llm import packing


def test_null_and_other_tails_share_a_bin(spark):
    rows = [(1, "one"), (None, "two"), (2, "three"), (None, "two"), (None, None), (0, "four")]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in rows)
    assert len({r["sequence_id"] for r in found}) == 1
    placed = sorted(found, key=lambda r: r["offset"])
    assert [r["doc_id"] for r in placed] == [0, 1, 2, None, None, None]
    assert [r["offset"] for r in placed] == [sum(p["length"] for p in placed[:i]) for i in range(len(placed))]

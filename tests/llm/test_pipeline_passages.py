"""Passages that unrelated documents share, through the line and near stages."""

import random

import corpus_pipeline as p
from pyspark.sql import functions as F


def test_passage_of_two_unrelated_documents(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, short, edge = words(60), words(49), words(50)
    copied = "\n".join([words(60), words(60), words(60)])
    texts = {
        1: f"{words(200)}\n{passage}\n{short}", 2: f"{words(200)}\n {passage.upper()}\t\n{short}", 3: f"{edge}\n{words(150)}", 4: f"{words(150)}\n{edge}",
        5: copied, 6: copied, 7: copied + " tail", 8: words(120), 9: f"{words(20)}\n{passage}\n{passage}",
    }
    # shorter rows stand in for the rest of a corpus, so that not every key is a heavy one
    texts |= {100 + i: words(60) for i in range(1500)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    rows = p.near_stage(spark, p.line_stage(spark, docs, ""), "").collect()
    found = {r["doc_id"]: r["text"] for r in rows}
    lines = {i: t.split("\n") for i, t in texts.items()}
    want = {i: t for i, t in texts.items() if i not in (6, 7)}
    want |= {2: "\n".join([lines[2][0], lines[2][2]]), 4: lines[4][0], 9: lines[9][0]}
    assert len(rows) == len(found) and found == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

"""Topics in event time: rows out of order over several batches, late rows, nulls, expiry and merging."""

import math
import random

from pyspark.sql import functions as F

from glyphmill.streaming import topics
from glyphmill.streaming.events import drained

SCHEMA = "intent string, repo string, event_id long, ts timestamp, v array<double>"
DAY = 24 * 3600


def streamed(spark, path, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(a, r, e, t, v) for a, r, e, t, v in rows], "intent string, repo string, event_id long, s long, v array<double>")
        df.select("intent", "repo", "event_id", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(f"{path}/{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    with topics.kept_in_rocksdb(spark):
        return sorted((tuple(r) for r in drained(topics.topics_merged(stream), "append").collect()), key=str)


def test_batches_out_of_order_and_late_rows(spark, tmp_path):
    rng = random.Random(1)
    at = lambda a: [math.cos(a), math.sin(a)]
    rows = [("debug" if i % 3 else "trace", f"r{i % 2}", i, 1_700_000_000 + i * 600 + rng.randint(0, 1500), at(rng.choice([0, 1.2, 3.9] if i < 24 else [0.45, 0.75]) + rng.uniform(-0.05, 0.05))) for i in range(240)]
    rows += [(None, "r", 900, 1_700_000_000, at(0)), ("debug", "r0", 901, 1_700_000_000, None), ("debug", "r0", None, 1_700_000_000, at(0))]
    end = [("", "", -1, 1_700_000_000 + 90 * DAY, at(0))]
    shuffled = rows[:100] + rows[240:]
    rng.shuffle(shuffled)
    late = [("debug", "r0", 999, 1_600_000_000, at(0))]  # long before what the watermark has passed
    found = [r for r in streamed(spark, tmp_path, [shuffled, rows[100:170][::-1], rows[170:240], end, late]) if r[2] >= 0]
    states, want = {}, []
    for intent, repo, event, ts, v in sorted(rows[:240], key=lambda r: (r[3], r[2])):
        want.append((intent, repo, event, *states.setdefault((intent, repo), topics.TopicState()).add(v, ts * 1000)))
    assert found == sorted(want, key=str) and any(r[4] is not None for r in found)


def test_topics_are_forgotten_merged_and_bounded():
    s = topics.TopicState()
    assert s.add([1.0, 0.0], 0) == (0, None) and s.add([0.0, 2.0], 1000) == (1, None)
    assert s.add([0.8, 0.6], 2000) == (0, None)  # alike enough to the first: 0.8 and 0.6
    day = topics._DAY
    assert s.add([0.0, 1.0], 1000 + topics.TOPIC_DAYS * day) == (1, None) and set(s.at) == {0, 1}
    assert s.add([0.0, 1.0], 2001 + topics.TOPIC_DAYS * day) == (1, None) and set(s.at) == {1}  # the first is forgotten
    s = topics.TopicState({3: ([1.0, 0.0], 5, 0), 4: ([0.94, math.sqrt(1 - 0.94**2)], 5, 0), 5: ([-1.0, 0.0], 1, 0)})
    assert s.add([1.0, 0.0], 1) == (3, 4) and s.at[3][1] == 11 and set(s.at) == {3, 5}
    many = topics.TopicState()
    for i in range(topics.MAX_TOPICS + 1):  # axes are alike in nothing
        own = many.add([float(j == i) for j in range(40)], i)
    assert own == (0, None) and len(many.at) == topics.MAX_TOPICS
    assert topics.TopicState().add([0.0, 0.0], 0) == (0, None)

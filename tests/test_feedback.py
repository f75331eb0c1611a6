"""Feedback that is applied once: batches against one batch, a batch that runs twice, and the bandits against a plain version with lists."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.functions.score import KNOBS
from glyphmill.plans import bindings as b
from glyphmill.streaming import bandit, feedback
from glyphmill.streaming.events import drained

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def static(spark):
    events = b.table(spark, SF, "events")
    return events, (feedback._traces(events), b.memories(spark, SF), b.table(spark, SF, "embeddings").select("vec_id", "embedding"))


def held(tables):
    out = {n: sorted(map(str, df.drop("epoch").collect())) for n, df in (("rewards", tables.read("rewards")), ("patches", tables.patches()), ("anchors", tables.anchors()), ("steps", tables.read("steps").where("step <> 'state'")))}
    out["fp"] = sorted((r["key"], r["n"], [round(x, 6) for x in r["total"]]) for r in tables.false_positives().collect())
    return out


def test_batches_and_a_batch_that_runs_twice(spark, static, tmp_path):
    events, known = static
    cuts = [r["c"] for r in events.select(F.percentile_approx("ts", [0.3, 0.7]).alias("c")).select(F.explode("c").alias("c")).collect()]
    parts = [events.where(F.col("ts") < cuts[0]), events.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), events.where(F.col("ts") >= cuts[1])]
    one, three = feedback.FeedbackTables(f"{tmp_path}/one", *known, floor=2), feedback.FeedbackTables(f"{tmp_path}/three", *known, floor=2)
    one.apply(events, 0)
    for i, part in enumerate(parts):
        three.apply(part, i)
    want = held(one)
    assert held(three) == want and all(want.values())
    three.apply(parts[1], 1)  # a batch that failed after its writes is run again
    three.apply(parts[2], 2)
    assert held(three) == want
    actions = Counter(r["action"] for r in one.read("rewards").collect())
    assert actions["none"] and actions["base"]


def test_unknown_queries_and_nulls(spark, static, tmp_path):
    _, known = static
    rows = [(1, "2024-01-01 00:00:00", 5, "click", 1.0, '{"k": 3}'), (2, "2024-01-02 00:00:00", 5, None, 1.0, None), (3, "2024-01-03 00:00:00", None, "click", None, "no json")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    tables = feedback.FeedbackTables(f"{tmp_path}/t", *known)
    tables.apply(events, 0)
    tables.apply(events.limit(0), 1)
    found = tables.read("steps").where("step <> 'state'").collect()
    assert all(r["step"] == "query" for r in found) and {r["event_id"] for r in found} <= {1, 3}
    assert tables.read("rewards").count() == tables.patches().count() == tables.anchors().count() == tables.false_positives().count() == 0


class Plain:
    """The profile bandit with lists of rewards, as its rules are told, drawing as the other does."""

    def __init__(self, draws, floor):
        self.draws, self.floor, self.samples, self.knobs, self.live = draws, floor, 0, None, None

    def serve(self, first):
        self.knobs = self.knobs or dict(first)
        name = lambda k: ",".join(f"{x}={k[x]}" for x in sorted(k))
        if self.samples < self.floor or self.draws("serve") >= 0.10:
            return name(self.knobs)
        if not self.live:
            knob, _, low, high = KNOBS[int(self.draws("knob") * len(KNOBS))]
            new = dict(self.knobs)
            new[knob] = max(low, min(high, new[knob] + (-1 if self.draws("side") < 0.5 else 1)))
            if new == self.knobs:
                return name(self.knobs)
            self.live = {"knobs": new, "id": name(new), "base": name(self.knobs), "rewards": [], "others": [], "bad": 0}
        return self.live["id"]

    def reward(self, profile, adjusted, weight):
        self.samples += 1
        c = self.live
        if not c:
            return "none"
        if profile == c["id"]:
            c["rewards"].append(adjusted * weight)
            c["bad"] = c["bad"] + 1 if adjusted < 0.30 else 0
            if c["bad"] == 3:
                self.live = None
                return "rollback"
        elif profile == c["base"]:
            c["others"].append(adjusted * weight)
        else:
            return "stale"
        if len(c["rewards"]) >= 20 and len(c["others"]) >= 5:
            self.live = None
            if sum(c["rewards"]) / len(c["rewards"]) > sum(c["others"]) / len(c["others"]) + 0.05:
                self.knobs = c["knobs"]
                return "promote"
            return "discard"
        return "try" if profile == c["id"] else "base"


def test_profile_bandit_takes_every_way():
    rng, seen = random.Random(1), Counter()
    for key, lift in (("debug/a", 0.3), ("trace/b", 0.0), ("general/c", -0.8)):
        own = bandit.ProfileBandit(key.split("/")[0], key)
        plain = Plain(lambda use: own.draw(use), bandit.SAMPLE_FLOOR)  # noqa: B023  it draws from the state of this round's bandit
        old = None
        for i in range(12_000):
            before = own.saved()
            first = own.s["knobs"]
            profile, served = own.serve()
            now = own.s
            own.s = {**bandit.json.loads(before), "n": now["n"]}  # the plain one draws at the same place
            assert plain.serve(first) == profile
            own.s = now
            asked = old if i % 97 == 0 and old else profile
            if served == "explore":
                old = profile
            adjusted, weight = rng.uniform(0.31, 0.5) + (lift if asked != own.id_of(own.s["knobs"]) else 0), rng.choice([0.5, 1.0])
            action = own.reward(asked, adjusted, weight)
            assert plain.reward(asked, adjusted, weight) == action
            seen.update([served, action])
            own = bandit.ProfileBandit(key.split("/")[0], key, own.saved()) if i % 50 == 0 else own
    assert {"cold", "explore", "try", "base", "none", "stale", "promote", "discard", "rollback"} <= set(seen)


def test_source_bandit_takes_every_way():
    seen, rng = Counter(), random.Random(2)
    for key, lift in (("a", 0.5), ("b", 0.0), ("c", -0.9)):
        own = bandit.SourceBandit(key, ("x", "y"))
        own.less_baseline = lambda raw: raw  # rewards as they are, so that a side can be the better one
        tried = False
        for _ in range(15_000):
            action, source, value = own.add(0.4 + rng.uniform(0, 0.05) + (lift if tried else 0))
            live = own.s["live"]
            own.s["n"] += 1
            tried = bool(live) and own.draw("serve") < bandit.EPSILON
            own.s["n"] -= 1
            seen.update([action])
            assert value is None or own.LEAST <= value <= own.MOST
    assert {"current", "try", "base", "promote", "discard", "rollback"} <= set(seen)


def test_a_micro_batch_that_runs_again_is_there_once(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    assert sorted(r["id"] for r in drained(stream, "append").collect()) == [0, 1, 2, 3, 4]
    empty = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").where("id > 9")
    assert drained(empty, "append").count() == 0

"""Feedback on answered queries, applied once: rewards, patches of traces, the profile bandit, anchors and false positives.

Each micro-batch goes to a folder of its own in every table, written over if the batch runs again, and what depends on the batches before
reads only those with a smaller number. So a batch that is run twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.score import raw_reward
from glyphmill.operators.storage import shared_path
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query
from glyphmill.streaming.bandit import SAMPLE_FLOOR, ProfileBandit
from glyphmill.streaming.events import event_stream

#: Rewards are counted in so many units, so that sums of them are exact.
UNITS = 100_000
#: What an anchored file that was read brings its pattern, in halves, if the answer helped and if not.
HELPED, DIDNT = 2, 1

_STEPS = "step string, intent string, repo string, event_id long, at timestamp, trace_id long, units long, profile string, action string, adjusted double, saved string"
_NAMES = [c.split()[0] for c in _STEPS.split(", ")]


def _traces(events: DataFrame) -> DataFrame:
    """Queries of a table or stream of events: where they belong, what they were answered with, and what their anchors and memories were."""
    intent = F.element_at(F.create_map(*[F.lit(x) for kv in b.INTENT_OF.items() for x in kv]), F.col("event_type"))
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), intent.alias("intent"), F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("repo"), k.alias("k"), "user_id",
        F.floor(F.col("value") * 100).cast("long").alias("prompt_tokens"),
    )


def said(events: DataFrame) -> DataFrame:
    """Feedback: the trace that it is about, the counters, what was read and whether the answer helped."""
    t = _traces(events).where("k > 0")
    extra = F.col("k") % 8
    return t.select("event_id", F.col("ts").alias("at"), (F.col("event_id") - F.col("k")).alias("trace_id"), extra.alias("additional_files"), (F.col("user_id") % 3).alias("revisits"), F.concat(F.lit("src/"), (F.col("user_id") % 50).cast("string")).alias("read"), (extra < 3).alias("helped"))


def _bandit(own: tuple, floor: int, saved: str | None) -> ProfileBandit:
    return ProfileBandit(own[0], "/".join(own), saved, floor)


def bandit_steps(steps: DataFrame, floor: int = SAMPLE_FLOOR) -> DataFrame:
    """Streams each bucket's saved state, queries and feedback in order of time, then id, through its bandit; the new state is the bucket's last row.

    steps: rows of _STEPS whose step is state, query or feedback. A query's profile is remembered until its bucket ends; feedback on a query of an earlier
    batch has its profile with it. A reward is told less the mean of the 50 before it. Memory: one bucket's state and the queries of one batch in it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, bandit, served, out, last = None, None, {}, [], None

        def closed() -> list[tuple]:
            return [("state", *own, None, last, None, None, None, None, None, bandit.saved())] if bandit else []

        for batch in batches:
            for step, intent, repo, event, at, trace, units, profile, saved in batch[["step", "intent", "repo", "event_id", "at", "trace_id", "units", "profile", "saved"]].itertuples(index=False):
                if (intent, repo) != own:
                    out += closed()
                    own, served = (intent, repo), {}
                    bandit = _bandit(own, floor, saved if step == "state" else None)
                last = at
                if step == "query":
                    profile, action = bandit.serve()
                    served[event] = profile
                    out.append((step, intent, repo, event, at, None, None, profile, action, None, None))
                elif step == "feedback":
                    profile = served.get(trace, profile)
                    adjusted = bandit.less_baseline(int(units)) / UNITS
                    out.append((step, intent, repo, event, at, trace, units, profile, bandit.reward(profile, adjusted), adjusted, None))
            yield pd.DataFrame(out, columns=_NAMES).astype({c: "Int64" for c in ("event_id", "trace_id", "units")})
            out = []
        yield pd.DataFrame(closed(), columns=_NAMES).astype({c: "Int64" for c in ("event_id", "trace_id", "units")})

    order = [F.when(F.col("step") == "state", 0).otherwise(1), "at", "event_id", F.desc("step")]  # an event's query before its own feedback
    return steps.repartition("intent", "repo").sortWithinPartitions("intent", "repo", *order).mapInPandas(run, _STEPS)


class FeedbackTables:
    """The tables that feedback is applied to, below one shared folder. apply() is a foreachBatch function.

    traces: all known queries, as _traces() gives them; feedback on an unknown query, or one that came before its query, is dropped. memories: vec_id, key and file; a query
    has the memories from its k on. vectors: vec_id and embedding; a query's is that of its user. Events of no known intent or repository have no bucket and are dropped.
    A batch's rows are applied in order of time; rows that come in a later batch come after it, however old they are.
    """

    def __init__(self, base: str, traces: DataFrame, memories: DataFrame, vectors: DataFrame, floor: int = SAMPLE_FLOOR):
        self.base, self.traces, self.memories, self.vectors, self.floor = base, traces, memories, vectors, floor
        self.spark: SparkSession = traces.sparkSession
        self._put("steps", -1, self.spark.createDataFrame([], _STEPS))  # something to read before the first batch

    def _put(self, name: str, epoch: int, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{name}")

    def apply(self, events: DataFrame, epoch: int) -> None:
        own = self._put("events", epoch, events)
        before = self.read("steps").where(F.col("epoch") < epoch)
        known = self.traces.where("intent is not null AND repo is not null").select(F.col("event_id").alias("trace_id"), F.col("ts").alias("asked"), "intent", "repo", F.col("k").alias("first"), F.col("user_id").alias("asker"), "prompt_tokens")
        told = self._put("told", epoch, said(own).join(known, "trace_id").where("asked <= at"))

        units = F.round(raw_reward(F.col("additional_files"), F.col("prompt_tokens"), F.col("revisits"), F.lit(0)) * UNITS).cast("long")
        served = before.where("step = 'query'").select(F.col("event_id").alias("trace_id"), "profile")
        saved = before.where("step = 'state'").groupBy("intent", "repo").agg(F.max_by("saved", "epoch").alias("saved"))
        none = lambda *names: [F.lit(None).cast(dict(c.split() for c in _STEPS.split(", "))[n]).alias(n) for n in names]
        asked = _traces(own).where("intent is not null AND repo is not null").select(F.lit("query").alias("step"), "intent", "repo", "event_id", F.col("ts").alias("at"), *none("trace_id", "units", "profile", "saved"))
        heard = told.join(served, "trace_id", "left").select(F.lit("feedback").alias("step"), "intent", "repo", "event_id", "at", "trace_id", units.alias("units"), "profile", *none("saved"))
        states = saved.select(F.lit("state").alias("step"), "intent", "repo", *none("event_id", "at", "trace_id", "units", "profile"), "saved")
        steps = self._put("steps", epoch, bandit_steps(states.unionByName(asked).unionByName(heard), self.floor))

        self._put("rewards", epoch, steps.where("step = 'feedback'").select("event_id", "trace_id", "intent", "repo", "at", "units", "adjusted", "profile", "action"))
        newest = F.max(F.struct("at", "event_id", "additional_files", "revisits", "helped")).alias("patch")
        self._put("patches", epoch, told.groupBy("trace_id").agg(newest))
        anchored = told.where(F.col("read") == F.concat(F.lit("src/"), (F.col("first") % 50).cast("string")))
        halves = F.sum(F.when(F.col("helped"), HELPED).otherwise(DIDNT)).cast("long").alias("halves")
        pattern = F.concat(F.lit("p"), (F.col("first") % 7).cast("string")).alias("pattern")
        scope = F.explode(F.array(F.lit(""), F.col("repo"))).alias("scope")  # for all repositories, and for its own
        self._put("anchors", epoch, anchored.select(pattern, scope, "helped").groupBy("pattern", "scope").agg(halves))
        self._put("false_positives", epoch, self._false_positives(told))

    def _false_positives(self, told: DataFrame) -> DataFrame:
        """Number and sum of the query vectors for which a memory was given, though other files were read. Queries alike are added up before they meet their vector."""
        wide = self.vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
        given = told.where("additional_files > 0").select(F.explode(F.sequence("first", F.col("first") + 2)).alias("vec_id"), "read", "asker")
        given = given.groupBy("vec_id", "read", "asker").agg(F.count(F.lit(1)).alias("n")).join(self.memories.select("vec_id", "key", "file"), "vec_id")
        wrong = given.where(~(F.contains("file", "read") | F.contains("read", "file"))).groupBy("key", "asker").agg(F.sum("n").alias("n"))
        asked = wrong.join(self.vectors.select(F.col("vec_id").alias("asker"), "embedding"), "asker")
        part: Column = F.array(*[F.sum(F.col("n") * F.coalesce(F.get("embedding", F.lit(i)), F.lit(0.0)).cast("double")) for i in range(wide)])
        return asked.groupBy("key").agg(F.sum("n").alias("n"), part.alias("total"))

    def patches(self) -> DataFrame:
        """The newest patch of each trace."""
        return self.read("patches").groupBy("trace_id").agg(F.max("patch").alias("patch")).select("trace_id", "patch.*")

    def anchors(self) -> DataFrame:
        return self.read("anchors").groupBy("pattern", "scope").agg(F.sum("halves").alias("halves"))

    def false_positives(self) -> DataFrame:
        """(key, n, total): the mean of what a memory was wrong for is total / n."""
        rows = self.read("false_positives")
        parts = rows.select("key", F.posexplode("total").alias("i", "x")).groupBy("key", "i").agg(F.sum("x").alias("x"))
        whole = parts.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("total"))
        return rows.groupBy("key").agg(F.sum("n").alias("n")).join(whole, "key")


def _run(s: SparkSession, d: str) -> FeedbackTables:
    """The stream of events, run to its end."""
    base = shared_path(s, "feedback")
    tables = FeedbackTables(f"{base}/tables", _traces(b.table(s, d, "events")), b.memories(s, d), b.table(s, d, "embeddings").select("vec_id", "embedding"))
    event_stream(s, d).writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(tables.apply).trigger(availableNow=True).start().awaitTermination()
    return tables


_TOLD = f"""
SELECT f.event_id, f.ts AS told_at, f.event_id - f.k AS trace_id, f.additional_files, f.revisits, 'src/' || (f.user_id % 50) AS read, f.additional_files < 3 AS helped, t.intent, t.repo, t.k AS first, t.user_id AS asker,
round(greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - 0.15::DOUBLE * f.additional_files - 0.00002::DOUBLE * t.prompt_tokens - 0.05::DOUBLE * f.revisits)) * {UNITS})::BIGINT AS units
FROM v_traces f JOIN v_traces t ON t.event_id = f.event_id - f.k WHERE f.k > 0 AND t.ts <= f.ts AND t.intent IS NOT NULL"""


@query("stream_feedback_apply", f"""
WITH told AS ({_TOLD}),
means AS (SELECT event_id, units, sum(units) OVER w AS s, count(*) OVER w AS n FROM told WINDOW w AS (PARTITION BY intent, repo ORDER BY told_at, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
given AS (SELECT unnest(range(first, first + 3)) AS vec_id, read, asker FROM told WHERE additional_files > 0),
wrong AS (SELECT key, asker FROM given JOIN v_memories m ON m.vec_id = given.vec_id WHERE NOT (contains(file, read) OR contains(read, file)))
SELECT 'rewards' AS sink, event_id::VARCHAR AS key, units AS n, (units - CASE WHEN n = 0 THEN 0::DOUBLE ELSE s::DOUBLE / n END) / {UNITS} AS value FROM means
UNION ALL SELECT 'patches', trace_id::VARCHAR, arg_max(additional_files, (told_at, event_id)), arg_max(revisits, (told_at, event_id))::DOUBLE FROM told GROUP BY trace_id
UNION ALL SELECT 'anchors', 'p' || (first % 7) || '/' || scope, sum(CASE WHEN helped THEN {HELPED} ELSE {DIDNT} END)::BIGINT, NULL FROM (SELECT *, unnest(['', repo]) AS scope FROM told) WHERE read = 'src/' || (first % 50) GROUP BY ALL
UNION ALL SELECT 'false_positives', key, count(*)::BIGINT, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) FROM wrong JOIN embeddings ON vec_id = asker GROUP BY key""")  # fmt: skip
def feedback_apply(s, d):
    """What each table holds once the stream of feedback has run to its end: a row for each reward, patched trace, pattern with its scope, and memory."""
    t = _run(s, d)
    row = lambda sink, key, n, value: [F.lit(sink).alias("sink"), key.cast("string").alias("key"), n.cast("long").alias("n"), value.cast("double").alias("value")]
    rewards = t.read("rewards").select(*row("rewards", F.col("event_id"), F.col("units"), F.col("adjusted")))
    patches = t.patches().select(*row("patches", F.col("trace_id"), F.col("additional_files"), F.col("revisits")))
    anchors = t.anchors().select(*row("anchors", F.concat_ws("/", "pattern", "scope"), F.col("halves"), F.lit(None)))
    summed = F.round(F.aggregate("total", F.lit(0.0), lambda a, x: a + x), 4)
    return rewards.unionByName(patches).unionByName(anchors).unionByName(t.false_positives().select(*row("false_positives", F.col("key"), F.col("n"), summed)))


@query("stream_profile_bandit")
def profile_bandit(s, d):
    """Each (intent, repository) has its own bandit: what each query was served, and what each reward did."""
    steps = _run(s, d).read("steps").where("step <> 'state'")
    return steps.select("step", "intent", "repo", "event_id", "trace_id", "profile", "action")

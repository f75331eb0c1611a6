"""Streams over events: windows with watermarks, sessions, repeat detection and topic clustering with keyed state.

Each query runs its stream to the end of what there is and returns what it emitted, so that batch and stream can be compared.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from glyphmill.functions.score import raw_reward
from glyphmill.operators.storage import shared_path
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query
from glyphmill.streaming.bandit import SourceBandit

#: Similarity that a topic absorbs at, and topics of a key at most.
ABSORB, MAX_TOPICS = 0.65, 32


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files; times are instants, as watermarks ask for."""
    schema = b.table(spark, sf_dir, "events").schema
    # the table is one file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """All that a stream emits; each batch has a folder of its own, written over if it runs again, and in update mode a key's last row counts."""
    spark = df.sparkSession
    base = shared_path(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/_epoch={epoch}")

    keep(spark.createDataFrame([], df.schema), -1)  # something to read even if nothing comes
    run = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    # a folder whose name begins with an underscore is hidden, unless it tells a column's value
    out = spark.read.schema(StructType([*df.schema.fields, StructField("_epoch", LongType())])).parquet(f"{base}/out")
    if keys:
        last = out.groupBy(*keys).agg(F.max("_epoch").alias("_epoch"))
        out = out.join(last, [*keys, "_epoch"], "left_semi")
    return out.drop("_epoch")


def tumbling(events: DataFrame, every: str = "1 hour") -> DataFrame:
    w = F.window("ts", every)
    out = events.withWatermark("ts", "10 minutes").groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "cents")


@query("stream_tumbling_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def tumbling_hourly(s, d):
    return drained(tumbling(event_stream(s, d)), "update", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding", "SELECT (date_trunc('hour', ts) - to_hours(k::INTEGER)) AS start, event_type, count(*)::BIGINT AS n FROM events, range(2) t(k) GROUP BY ALL")
def sliding(s, d):
    e = event_stream(s, d).withWatermark("ts", "10 minutes")
    out = e.groupBy(F.window("ts", "2 hours", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
    return drained(out, "update", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_watch_debounce", "WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 15 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM g GROUP BY user_id, k")
def watch_debounce(s, d):
    """Sessions of changes with a gap of 15 minutes, as a batch over the same session windows that a stream uses."""
    e = b.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = e.groupBy("user_id", F.session_window("ts", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


class Topics:
    """Leader clustering of one key's vectors, in order of time."""

    def __init__(self) -> None:
        self.at: dict[int, tuple[np.ndarray, int, int]] = {}
        self.step = 0

    def add(self, v: np.ndarray) -> int:
        v = v / max(float(np.linalg.norm(v)), 1e-12)
        self.step += 1
        best = max(((float(c @ v), -i) for i, (c, _, _) in self.at.items()), default=(-2.0, 0))
        if best[0] >= ABSORB:
            i = -best[1]
            c, n, _ = self.at[i]
            c = (c * n + v) / (n + 1)
            self.at[i] = (c / max(float(np.linalg.norm(c)), 1e-12), n + 1, self.step)
            return i
        i = next((j for j in range(MAX_TOPICS) if j not in self.at), None)
        i = min(self.at, key=lambda j: (self.at[j][2], j)) if i is None else i
        self.at[i] = (v, 1, self.step)
        return i


def topics(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """(key, order, topic): order matters, so that a key's rows are streamed in order through its bounded state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, Topics()
        for batch in batches:
            out = []
            for k, o, v in zip(batch[key], batch[order], batch[vector], strict=True):
                if k != own:
                    own, state = k, Topics()
                out.append(state.add(np.asarray(v, dtype=float)))
            yield batch[[key, order]].assign(topic=out)

    kinds = dict(rows.dtypes)
    return rows.select(key, order, vector).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, topic int")


def topics_kept(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """topics() for a stream: each key's topics, MAX_TOPICS at most, are in the state store between batches, and order counts within a batch."""
    kinds = dict(rows.dtypes)

    def run(own, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = Topics()
        if state.exists:
            saved = json.loads(state.get[0])
            kept.step, kept.at = saved["step"], {i: (np.array(c), n, last) for i, c, n, last in saved["at"]}
        rows = pd.concat(list(batches)).sort_values(order)
        found = [kept.add(np.asarray(v, dtype=float)) for v in rows[vector]]
        state.update((json.dumps({"step": kept.step, "at": [(i, c.tolist(), n, last) for i, (c, n, last) in kept.at.items()]}),))
        yield pd.DataFrame({key: own[0], order: rows[order], "topic": found})

    kept = rows.select(key, order, vector).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    return kept.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, topic int", "saved string", "append", "NoTimeout")


@query("stream_topics_kept")
def topics_stream(s, d):
    """Topic clusters of a stream of vectors, with state in the state store."""
    schema = b.table(s, d, "embeddings").schema
    return drained(topics_kept(s.readStream.schema(schema).parquet(f"{d}/embeddings.parquet*"), "label", "vec_id", "embedding"), "append")


@query("stream_repeats", "SELECT a.event_id, z.event_id AS earlier FROM events a JOIN events z ON a.user_id % 10 = z.user_id % 10 AND a.event_type = z.event_type AND z.ts < a.ts AND z.ts >= a.ts - INTERVAL 15 MINUTE")
def repeats(s, d):
    """What a repository was asked again within 15 minutes: a join of the stream with itself over an interval, so that what is older than the
    interval and the watermark leaves the state."""
    # an earlier event lies in the same quarter of an hour or the one before, so that each of a key's events meets those of two quarters and not all that the state holds
    quarter = lambda c: F.expr(f"unix_micros({c}) div 900000000")
    e = event_stream(s, d).select("event_id", "ts", "event_type", (F.col("user_id") % 10).alias("repo"), quarter("ts").alias("quarter")).withWatermark("ts", "15 minutes")
    z = event_stream(s, d).select(F.col("event_id").alias("earlier"), F.col("ts").alias("before"), F.col("event_type").alias("kind"), (F.col("user_id") % 10).alias("place"), F.explode(F.array(quarter("ts"), quarter("ts") + 1)).alias("due")).withWatermark("before", "15 minutes")
    near = F.expr("repo = place AND event_type = kind AND quarter = due AND before < ts AND before >= ts - INTERVAL 15 MINUTES")
    return drained(e.join(z, near).select("event_id", "earlier"), "append")


@query("stream_topic_clusters")
def topic_clusters(s, d):
    return topics(b.table(s, d, "embeddings"), "label", "vec_id", "embedding")


def traced(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, with intent, repository, the counters of their feedback and `k`."""
    intent = F.element_at(F.create_map(*[F.lit(x) for kv in b.INTENT_OF.items() for x in kv]), F.col("event_type"))
    e = events.withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    repo = F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string"))
    raw = raw_reward(F.col("k") % 8, F.floor(F.col("value") * 100).cast("long"), F.col("user_id") % 3, F.lit(0))
    return e.select("event_id", "ts", intent.alias("intent"), repo.alias("repo"), "k", raw.alias("raw"))


@query("stream_feedback", "SELECT f.event_id, t.event_id AS trace_id, t.intent, t.repo, round(f.raw, 6) AS raw, t.ts <= f.ts AS in_time FROM v_rewards f JOIN v_rewards t ON t.event_id = f.event_id - f.k WHERE f.k > 0")
def feedback(s, d):
    """A stream of feedback, each about the trace k events before it, joined to the table of traces: feedback on an unknown trace is dropped."""
    said = traced(event_stream(s, d)).where("k > 0").select("event_id", (F.col("event_id") - F.col("k")).alias("trace_id"), F.round("raw", 6).alias("raw"), F.col("ts").alias("said"))
    known = traced(b.table(s, d, "events")).select(F.col("event_id").alias("trace_id"), "intent", "repo", F.col("ts").cast("timestamp").alias("ts"))
    return drained(said.join(known, "trace_id").select("event_id", "trace_id", "intent", "repo", "raw", (F.col("ts") <= F.col("said")).alias("in_time")), "append")


SOURCES = ("code", "docs", "issues")


def source_actions(events: DataFrame) -> DataFrame:
    """(intent, repo, event_id, action, source, breadth) of a stream of traced events: keyed state, in order of time within each batch.

    Events of no known intent have no bucket and are dropped. Times order the rows of a batch; a batch's files are bounded by the reader.
    """

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = SourceBandit("/".join(map(str, key)), SOURCES, state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = [(*key, e, *own.add(x)) for e, x in zip(rows["event_id"], rows["raw"], strict=True)]
        state.update((own.saved(),))
        yield pd.DataFrame(out, columns=["intent", "repo", "event_id", "action", "source", "breadth"]).astype({"breadth": "Int64"})

    kept = events.where("intent is not null").select("intent", "repo", "event_id", "ts", "raw")
    return kept.groupBy("intent", "repo").applyInPandasWithState(run, "intent string, repo string, event_id long, action string, source string, breadth long", "saved string", "append", "NoTimeout")


@query("stream_source_bandit")
def source_bandit(s, d):
    """Breadth of sources learned from a stream of rewards, with state in the state store; draws are hashes, so that a rerun takes the same way."""
    return drained(source_actions(traced(event_stream(s, d))), "append")

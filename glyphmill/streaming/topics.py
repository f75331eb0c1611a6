"""Topics of queries as a stream with keyed state: map state, event-time timers, expiry, and merging of topics that have come near each other.

Rows wait in the state until the watermark has passed their time, and are then taken in order of time and id. So the result is that of one pass
in order, however the rows were dealt over batches; rows later than the watermark allows are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glyphmill.operators.storage import shared_path
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query
from glyphmill.streaming.events import ABSORB, MAX_TOPICS, drained, event_stream
from glyphmill.streaming.feedback import _traces

#: Two topics whose centres are so alike become one. A topic is forgotten after so many days without a query.
MERGE, TOPIC_DAYS = 0.9, 14
_DAY = 24 * 3600 * 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n > 0 else v


def _dot(a: list[float], b_: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b_, strict=False))


def _mean(a: list[float], n: int, b_: list[float], m: int) -> list[float]:
    return _unit([(x * n + y * m) / (n + m) for x, y in zip(a, b_, strict=False)])


class TopicState:
    """The topics of one key: id -> (centre, queries, when the last came, in ms)."""

    def __init__(self, at: dict[int, tuple[list[float], int, int]] | None = None):
        self.at = at or {}

    def forget(self, now: int) -> None:
        self.at = {i: t for i, t in self.at.items() if t[2] >= now - TOPIC_DAYS * _DAY}

    def add(self, v: list[float], now: int) -> tuple[int, int | None]:
        """(topic, a topic that it took in): the nearest topic takes a query that is alike enough, else a new one does, in the place of that longest unseen if all are taken."""
        self.forget(now)
        v = _unit(v)
        like, own = max(((_dot(c, v), -i) for i, (c, _, _) in self.at.items()), default=(-2.0, 0))
        if like >= ABSORB:
            own = -own
            c, n, _ = self.at[own]
            self.at[own] = (_mean(c, n, v, 1), n + 1, now)
        else:
            own = next((i for i in range(MAX_TOPICS) if i not in self.at), None)
            own = min(self.at, key=lambda i: (self.at[i][2], i)) if own is None else own
            self.at[own] = (v, 1, now)
        c, n, _ = self.at[own]
        like, other = max(((_dot(c, o), -i) for i, (o, _, _) in self.at.items() if i != own), default=(-2.0, 0))
        if like < MERGE:
            return own, None
        other = -other
        o, m, seen = self.at[other]
        kept, gone = sorted((own, other), key=lambda i: (-self.at[i][1], i))
        self.at[kept] = (_mean(*self.at[kept][:2], *self.at[gone][:2]), n + m, now)
        del self.at[gone]
        return kept, gone


_OUT = "intent string, repo string, event_id long, topic int, took_in int"


class TopicProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.topics = handle.getMapState("topics", "id int", "centre array<double>, n long, seen long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        own = [(int(at), int(event), [float(x) for x in v]) for batch in rows for at, event, v in zip(batch["at"], batch["event_id"], batch["v"], strict=True)]
        if own:
            self.waiting.appendList(own)
            self.handle.registerTimer(max(min(at for at, _, _ in own), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, left = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        if not due:
            return
        state = TopicState({r[0][0]: (list(r[1][0]), r[1][1], r[1][2]) for r in self.topics.iterator()})
        before = dict(state.at)
        out = [(*key, event, *state.add(v, at)) for at, event, v in due]
        for i in before.keys() - state.at.keys():
            self.topics.removeKey((i,))
        for i, t in state.at.items():
            if before.get(i) != t:
                self.topics.updateValue((i,), t)
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"topic": "int32", "took_in": "Int32"})

    def close(self) -> None:
        pass


def topics_merged(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """(intent, repo, event_id, topic, took_in) of a stream of intent, repo, event_id, ts and vector v.

    Rows with a null among these have no topic and are dropped, as are rows that come later than the watermark allows. State of a key: its topics, MAX_TOPICS at most,
    and the rows that the watermark hasn't passed.
    """
    named = rows.where("intent is not null AND repo is not null AND event_id is not null AND ts is not null AND v is not null").where(~F.exists("v", lambda x: x.isNull()))
    timed = named.withWatermark("ts", late).select("intent", "repo", "event_id", F.unix_millis("ts").alias("at"), "ts", "v")
    return timed.groupBy("intent", "repo").transformWithStateInPandas(statefulProcessor=TopicProcessor(), outputStructType=_OUT, outputMode="append", timeMode="eventTime")


@contextmanager
def kept_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Map state and timers need this state store; the session gets back what it had."""
    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, had)


def _angled(events: DataFrame) -> DataFrame:
    """Traced queries with a vector in the plane, by the number in their properties."""
    turn = (F.col("k") % 100) * (2 * math.pi / 100)
    return _traces(events).select("intent", "repo", "event_id", "ts", F.array(F.cos(turn), F.sin(turn)).alias("v"))


_V = "list_value(cos((k % 100) * (2 * pi() / 100)), sin((k % 100) * (2 * pi() / 100)))"
_UNIT = "list_transform({0}, lambda x: x / sqrt({0}[1] * {0}[1] + {0}[2] * {0}[2]))"
_MIX = "list_value(({0}.c[1] * {0}.n + {1}.c[1] * {1}.n) / ({0}.n + {1}.n), ({0}.c[2] * {0}.n + {1}.c[2] * {1}.n) / ({0}.n + {1}.n))"
_NEAREST = "list_sort(list_transform({0}, lambda t: {{'far': -(t.c[1] * {1}[1] + t.c[2] * {1}[2]), 't': t}}))[1]"


@query("stream_topics_merged", f"""
WITH RECURSIVE rows AS (SELECT intent, repo, event_id, epoch_ms(ts) AS at_ms, {_V} AS v, row_number() OVER (PARTITION BY intent, repo ORDER BY epoch_ms(ts), event_id) AS step FROM v_traces WHERE intent IS NOT NULL),
run AS (
  SELECT intent, repo, 0::BIGINT AS step, -1::BIGINT AS event_id, []::STRUCT(id INTEGER, c DOUBLE[], n BIGINT, seen BIGINT)[] AS topics, NULL::INTEGER AS topic, NULL::INTEGER AS took_in FROM (SELECT DISTINCT intent, repo FROM rows)
  UNION ALL
  SELECT intent, repo, step, event_id,
    CASE WHEN other IS NULL THEN topics ELSE list_append(list_filter(topics, lambda t: t.id <> own.id AND t.id <> other.id), {{'id': kept.id, 'c': {_UNIT.format("mixed")}, 'n': kept.n + gone.n, 'seen': at_ms}}) END, kept.id, gone.id
  FROM (SELECT *, CASE WHEN other IS NULL THEN NULL ELSE {_MIX.format("kept", "gone")} END AS mixed FROM (
    SELECT *, CASE WHEN other IS NULL OR own.n > other.n OR (own.n = other.n AND own.id < other.id) THEN own ELSE other END AS kept,
      CASE WHEN other IS NULL THEN NULL WHEN own.n > other.n OR (own.n = other.n AND own.id < other.id) THEN other ELSE own END AS gone FROM (
    SELECT *, CASE WHEN -near.far >= {MERGE} THEN near.t END AS other FROM (
    SELECT *, {_NEAREST.format("list_filter(topics, lambda t: t.id <> own.id)", "own.c")} AS near FROM (
    SELECT *, list_append(list_filter(live, lambda t: t.id <> own.id), own) AS topics FROM (
    SELECT *, CASE WHEN best IS NOT NULL AND -best.far >= {ABSORB} THEN {{'id': best.t.id, 'c': {_UNIT.format("together")}, 'n': best.t.n + 1, 'seen': at_ms}}
      ELSE {{'id': list_filter(range({MAX_TOPICS}), lambda i: NOT list_contains(list_transform(live, lambda t: t.id), i::INTEGER))[1]::INTEGER, 'c': v, 'n': 1::BIGINT, 'seen': at_ms}} END AS own FROM (
    SELECT *, CASE WHEN best IS NULL THEN v ELSE list_value((best.t.c[1] * best.t.n + v[1]) / (best.t.n + 1), (best.t.c[2] * best.t.n + v[2]) / (best.t.n + 1)) END AS together FROM (
    SELECT *, {_NEAREST.format("live", "v")} AS best FROM (
    SELECT r.intent, r.repo, r.step, r.event_id, r.at_ms, r.v, list_filter(run.topics, lambda t: t.seen >= r.at_ms - {TOPIC_DAYS * _DAY}) AS live
    FROM run JOIN rows r ON r.intent = run.intent AND r.repo = run.repo AND r.step = run.step + 1)))))))))
)
SELECT intent, repo, event_id, topic, took_in FROM run WHERE step > 0""")  # fmt: skip
def topics_merged_query(s, d):
    """The stream of events, and a last row without a bucket that lets the watermark pass all of them."""
    end = shared_path(s, "topics-end")
    last = b.table(s, d, "events").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).alias("ts"))
    last.select(F.lit("").alias("intent"), F.lit("").alias("repo"), F.lit(-1).cast("long").alias("event_id"), F.coalesce("ts", F.to_timestamp(F.lit("2000-01-01"))).alias("ts"), F.array(F.lit(1.0), F.lit(0.0)).alias("v")).write.parquet(end)
    closing = s.readStream.schema("intent string, repo string, event_id long, ts timestamp, v array<double>").parquet(end)
    with kept_in_rocksdb(s):
        return drained(topics_merged(_angled(event_stream(s, d)).unionByName(closing)), "append").where("event_id >= 0")

"""Repeats within 15 minutes, at the edges of quarters of an hour."""

import datetime as dt

from glyphmill.streaming import events

AT = dt.datetime(2024, 2, 28, 23, 20, tzinfo=dt.timezone.utc)


def test_edges_of_quarters(spark, tmp_path, monkeypatch):
    steps = [0, 599, 600, 899, 900, 1499, 1500, 1501, 2400, 3299, 3300, 3301, 7000]
    rows = [(i, AT + dt.timedelta(seconds=s), 3 + 10 * (i % 2), "view" if i % 5 else "click", 0.0, "{}") for i, s in enumerate(steps)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    whole = events.drained
    monkeypatch.setattr(events, "drained", lambda df, *a: seen.append(df._jdf.queryExecution().analyzed().toString()) or whole(df, *a))
    found = sorted(map(tuple, events.repeats(spark, str(tmp_path)).collect()))
    want = sorted((a[0], z[0]) for a in rows for z in rows if a[3] == z[3] and z[1] < a[1] and z[1] >= a[1] - dt.timedelta(minutes=15))
    assert found == want and found
    # an equality on a bounded time, so that a key's events don't all meet
    assert "quarter" in seen[0] and "explode" in seen[0]

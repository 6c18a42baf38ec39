"""Publish gates and trailing counts on rows made for them."""

import datetime

from strataloom.plans import registry


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def events(spark, path, rows):
    data = [(k, t, u, e, v) for k, (t, u, e, v) in enumerate(rows)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_gates_fire_for_a_platform_without_events(spark, tmp_path):
    rows = [(at(d), 0, "view", 1.0) for d in range(1, 7) for _ in range(10)]
    rows += [(at(d), 1, "view", 1.0) for d in range(1, 5) for _ in range(10)]
    rows += [(at(6), 2, "error", None)]
    got = {(r.platform, r.run.day): r for r in registry.queries()["i02_publish_gates"](spark, events(spark, tmp_path, rows)).collect()}
    assert len(got) == 18  # three platforms, six runs
    assert got[1, 6].vanished and got[1, 6].n == 0 and got[1, 6].dropped and not got[1, 6].publish
    assert got[0, 6].publish and not got[2, 1].vanished
    assert got[2, 6].fields_missing and got[2, 6].detail_failed and not got[2, 6].publish


def test_trailing_day(spark, tmp_path):
    rows = [(at(1, 0), 1, "view", 1.0), (at(1, 5), 1, "click", 1.0), (at(2, 1), 2, "view", 1.0)]
    got = {r.until: (r.added, r.updated) for r in registry.queries()["h05_changes_trailing_day"](spark, events(spark, tmp_path, rows)).collect()}
    assert got[at(1, 1)] == (1, 0) and got[at(2, 0)] == (1, 1) and got[at(2, 2)] == (1, 1) and got[at(2, 6)] == (1, 0)

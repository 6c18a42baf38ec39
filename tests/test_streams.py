"""Streams in many batches give what one batch gives."""

import datetime
import random

from pyspark.sql import functions as F

from strataloom.operators import versioning
from strataloom.streaming import observations, states

T0 = datetime.datetime(2026, 1, 1)


def batches(log, path, n=4, size=30):
    for k in range(n):
        log.where(f"event_id div {size} = {k}").coalesce(1).write.mode("append").parquet(path)
    return path


def test_versions_of_many_batches_equal_the_chain(spark, tmp_path):
    log = spark.createDataFrame(
        [(k, k // 2, (k * 7) % 5, None if k % 11 == 0 else "abc"[(k * k) % 7 % 3]) for k in range(120)], "event_id long, ts long, item long, payload string"
    ).withColumn("ts", F.timestamp_seconds("ts"))
    got = observations.changes(observations.source(spark, batches(log, str(tmp_path / "log")), files=1))
    for states in (versioning.chain(log, ["item"], ["ts", "event_id"], "payload", "ts"), versioning.history(log, None, ["item"], ["ts", "event_id"], "payload").where("new_version")):
        want = states.select("event_id", "item", F.col("version_no").cast("long").alias("version_no"), "event")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def sightings():
    """Two platforms whose complete runs differ; items come, stay away, come back, with other payloads."""
    rnd = random.Random(11)
    seen = [(p, f"{'ab'[p]}{k}", run, T0 + datetime.timedelta(days=run, minutes=k), 1000 * run + 10 * k + p, rnd.choice(["x", "y", None])) for run in range(24) for p in (0, 1) for k in range(12) if rnd.random() < (0.15 if k % 3 else 0.6)]
    ends = [(0, run) for run in range(24) if run % 4 != 1] + [(1, run) for run in range(24) if run % 3 != 0]
    return seen, ends


def written_in_batches(spark, seen, ends, path, runs):
    """A file for each run: its sightings in any order, then, told twice, that it has ended."""
    for run in runs:
        rows = [r for r in seen if r[2] == run] + [(p, None, r, None, None, None) for p, r in ends if r == run] * 2
        spark.createDataFrame(rows, "platform long, item string, run long, at timestamp, event_id long, payload string").coalesce(1).write.mode("append").parquet(path)


def whole(spark, seen, ends):
    log = spark.createDataFrame([(*r[:3], r[4], r[5]) for r in seen], "platform long, item string, run long, event_id long, payload string")
    gone = versioning.absences(log.select("platform", "item", "run"), spark.createDataFrame(ends, "platform long, run long"), ["item"], "run", scope=("platform",))
    states = versioning.history(log, gone.withColumn("event_id", F.lit(None).cast("long")), ["platform", "item"], ["run", "event_id"], "payload")
    return {(r.platform, r.item, r.run, r.event_id, r.event, r.version_no) for r in states.where("event <> 'unchanged'").collect()}


def test_states_of_many_batches_equal_the_history_and_a_restart_goes_on(spark, tmp_path):
    seen, ends = sightings()
    path, at = str(tmp_path / "log"), f"file://{tmp_path}/query"
    want = whole(spark, seen, ends)
    assert {"added", "updated", "recovered", "removed"} == {w[4] for w in want}
    for part in (range(0, 9), range(9, 24)):  # the second call starts from the first one's checkpoint
        written_in_batches(spark, seen, ends, path, part)
        with states.rocks(spark):
            got = observations.drain(states.item_events(observations.source(spark, path, files=1), shards=3), at).collect()
        assert len(got) == len(set(got))
    assert {(r.platform, r.item, r.run, r.event_id, r.event, r.version_no) for r in got} == want
    assert spark.conf.get(states.PROVIDER) != states.STORE


def test_state_rows_may_grow(spark, tmp_path):
    class Later(states.ItemStates):
        """A later version of the processor, with one more field in its state."""

        ENDED = "n long, run long, note string"

        def told(self, n, run):
            return n, run, "later"

    seen, ends = sightings()
    path, at = str(tmp_path / "log"), f"file://{tmp_path}/query"
    for part, processor in ((range(0, 12), None), (range(12, 24), Later())):
        written_in_batches(spark, seen, ends, path, part)
        with states.rocks(spark):
            got = observations.drain(states.item_events(observations.source(spark, path, files=4), shards=2, processor=processor), at).collect()
    assert {(r.platform, r.item, r.run, r.event_id, r.event, r.version_no) for r in got} == whole(spark, seen, ends)


def test_trailing_windows_leave_the_state(spark, tmp_path):
    rows = [(f"i{k % 7}", T0 + datetime.timedelta(hours=3 * k), k, "ab"[k * k % 5 % 2]) for k in range(240)]  # thirty days
    path, at = str(tmp_path / "log"), str(tmp_path / "query")
    for k in range(0, 240, 40):
        spark.createDataFrame(rows[k : k + 40], "item string, at timestamp, event_id long, payload string").coalesce(1).write.mode("append").parquet(path)
    with states.rocks(spark, evolving=False):
        query = states.trailing_day(observations.source(spark, path, files=1), shards=2).writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    kept = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"] if "stateStoreSave" in op["operatorName"]]
    assert kept and max(kept) <= 24 + 24 + 5 * 24 + 3 and kept[-1] <= 50  # a day, the delay and one batch of five days; never all 720 windows
    log = versioning.history(spark.createDataFrame(rows, "item string, at timestamp, event_id long, payload string"), None, ["item"], ["at", "event_id"], "payload").where("event <> 'unchanged'")
    want = log.groupBy(F.window("at", "24 hours", "1 hour").alias("w")).agg(F.count_if(F.col("event") == "added").alias("a"), F.count_if(F.col("event") == "updated").alias("u")).select(F.col("w.end").alias("until"), "a", "u")
    want = want.where(F.col("until") <= F.lit(rows[-1][1] - datetime.timedelta(days=1)))
    assert sorted(map(tuple, spark.read.parquet(f"{at}/rows").collect())) == sorted(map(tuple, want.collect()))


def test_end_is_said_once(spark, tmp_path):
    log = spark.createDataFrame([(k, k % 4, k > 40 and k % 4 < 3) for k in range(100)], "event_id long, run long, final boolean")
    stream = observations.source(spark, batches(log, str(tmp_path / "log")), files=1).select("run", F.col("event_id").alias("line"), "final")
    got = observations.drain(observations.tail_with_end(stream)).collect()
    assert sorted(r.run for r in got if r.kind == "end") == [0, 1, 2] and sum(r.kind == "line" for r in got) == 100


def test_empty_stream_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 9, 1, "a"), (1, 9, 1, "a"), (2, 5, 1, None), (3, None, 2, "b")], "event_id long, ts long, item long, payload string").withColumn("ts", F.timestamp_seconds("ts"))
    rows.where("false").write.parquet(str(tmp_path / "none"))
    assert observations.changes(observations.source(spark, str(tmp_path / "none"))).count() == 0
    rows.write.parquet(str(tmp_path / "some"))
    stream = observations.source(spark, str(tmp_path / "some"))
    assert observations.drain(observations.once_within(stream, ["event_id"], "ts")).count() == 3  # a row without time is kept
    assert observations.drain(observations.tail(stream, "event_id", 1)).count() == 2


def test_windows_behind_the_last_event_come_out(spark, tmp_path):
    import datetime

    from strataloom.plans import registry

    t = datetime.datetime(2024, 1, 1, 5, 30)
    spark.createDataFrame([(1, t, 7, "view")], "event_id long, ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["h05_stream_trailing_day"](spark, str(tmp_path)).collect()
    assert sorted((r.until, r.added, r.updated) for r in got) == [(t.replace(minute=0) + datetime.timedelta(hours=k), 1, 0) for k in range(1, 25)]

"""The snapshot store: repeated batches, failures half-way, damaged bodies and copies."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from strataloom.sources import snapshots as S

T0 = datetime.datetime(2026, 1, 1)
NOW = T0 + datetime.timedelta(days=31)


def rows(spark, items):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    made = [(u, T0 + datetime.timedelta(minutes=m), sha(b) if h is None else h, sha(b), p, "r", bytearray(b)) for u, m, b, p, h in items]
    return spark.createDataFrame(made, "url string, at timestamp, content_hash string, semantic_hash string, platform long, run string, body binary")


@pytest.fixture
def store(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    S.create(spark, at)
    return at


def whole(spark, at):
    return {(r.url, bytes(r.body)): r.tier for r in S.bodies(spark, at, S.current(spark, at)).collect()}


def test_batches_are_written_once_and_read_back(spark, store, tmp_path):
    one = rows(spark, [("u", 0, b"a", 1, None), ("u", 1, b"b", 1, None), ("u", 2, b"a", 1, None), ("v", 0, b"a", 2, None), ("w", 0, b"x", 2, "0" * 64)])
    assert S.append(one, store, "1") == {"written": 3, "known": 1, "failed": 1}
    assert S.append(one, store, "1") == {"written": 3, "known": 1, "failed": 1}
    assert S.append(rows(spark, [("u", 9, b"a", 1, None), ("v", 9, b"c", 2, None)]), store, "2") == {"written": 1, "known": 1, "failed": 0}
    assert set(whole(spark, store)) == {("u", b"a"), ("u", b"b"), ("v", b"a"), ("v", b"c")}
    assert (tmp_path / "store/online/batch=1/platform_id=1/fetch_date=2026-01-01").is_dir()
    assert {r.changed for r in S.current(spark, store).where("url = 'v'").collect()} == {True}


def test_a_failure_before_the_commit_leaves_the_store_as_it_was(spark, store, monkeypatch):
    S.append(rows(spark, [("u", 0, b"a", 1, None)]), store, "1")

    def broken(*args, **kwargs):
        raise RuntimeError("lost")

    more = rows(spark, [("u", 5, b"b", 1, None)])
    with monkeypatch.context() as m:
        m.setattr(S, "enter", broken)
        for job in (lambda: S.append(more, store, "2"), lambda: S.archive(spark, store, "m", F.lit(NOW), 10)):
            with pytest.raises(RuntimeError):
                job()
    assert whole(spark, store) == {("u", b"a"): "online"}  # though a second copy lies in the archive by now
    assert S.append(more, store, "2")["written"] == 1 and S.archive(spark, store, "m", F.lit(NOW), 10) == {"written": 2, "known": 0, "failed": 0}
    assert whole(spark, store) == {("u", b"a"): "archive", ("u", b"b"): "archive"}


def test_damaged_copies_are_found_and_stay_online(spark, store):
    S.append(rows(spark, [("u", 0, b"a", 1, None), ("v", 1, b"b", 1, None), ("w", 2, b"c", 1, None), ("x", 99_999, b"d", 1, None)]), store, "1")
    spoil = lambda df: df.withColumn("body", F.when(F.col("url") == "v", F.encode(F.lit("?"), "UTF-8")).otherwise(F.col("body")))
    assert S.archive(spark, store, "m1", F.lit(NOW), 2, copied=spoil) == {"written": 1, "known": 0, "failed": 1}
    assert whole(spark, store) == {("u", b"a"): "archive", ("v", b"b"): "online", ("w", b"c"): "online", ("x", b"d"): "online"}
    assert [r.alert for r in S.read(spark, store, "alerts").collect()] == ["archive checksum mismatch"]
    assert S.archive(spark, store, "m2", F.lit(NOW), 10) == {"written": 2, "known": 0, "failed": 0}
    assert whole(spark, store)["x", b"d"] == "online" and list(whole(spark, store).values()).count("archive") == 3


def test_a_batch_has_a_file_for_each_folder(spark, store, tmp_path):
    """Not one for each task and folder, which grew with the square of the days of a batch."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        S.append(rows(spark, [(f"u{k}", 1440 * (k % 3), b"%d" % k, k % 2, None) for k in range(60)]), store, "1")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [p.parent for p in (tmp_path / "store/online/batch=1").rglob("*.parquet")]
    assert len(files) == len(set(files)) == 6 and len(whole(spark, store)) == 60

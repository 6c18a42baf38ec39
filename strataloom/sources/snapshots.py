"""A store of snapshots in two tiers, written in batches that may be repeated after a failure.

Layout below a folder: ``online`` and ``archive`` hold bodies, by batch, platform and date; ``index`` says of every object in which tier and batch its body
lies, an entry for each change, of which the latest counts; ``commits`` names the batches that are whole; ``alerts`` what an archive job could not move.
A batch is written under its own name, read back and checked, entered in the index, and committed last. Readers see the
entries of committed batches only, so a batch that failed half-way is not seen, and when it is repeated it overwrites what it left.
A body is moved by copy, check, and a new index entry: before the commit it is read online, afterwards from the archive, never from neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versioning as V
from .tables import written

BODIES = "object_key string, body binary, batch string, platform_id long, fetch_date date"
INDEX = "object_key string, url string, content_hash string, semantic_hash string, platform long, run string, fetched_at timestamp, expires_at timestamp, changed boolean, tier string, place string, nth long, batch string"
COMMITS = "batch string, nth long, written long, known long, failed long"
ALERTS = "object_key string, alert string, batch string"
TABLES = {"online": BODIES, "archive": BODIES, "index": INDEX, "commits": COMMITS, "alerts": ALERTS}


def create(spark: SparkSession, at: str) -> None:
    """An empty store."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.partitionBy("batch").parquet(f"{at}/{name}")


def read(spark: SparkSession, at: str, name: str) -> DataFrame:
    """All rows of a table of the store, committed or not."""
    return spark.read.schema(TABLES[name]).parquet(f"{at}/{name}")


def committed(spark: SparkSession, at: str) -> dict[str, dict]:
    """The counts of each committed batch; one row a batch."""
    return {r.batch: r.asDict() for r in read(spark, at, "commits").collect()}


def current(spark: SparkSession, at: str) -> DataFrame:
    """The latest committed index entry of each object."""
    rows = read(spark, at, "index").join(read(spark, at, "commits").select("batch"), "batch", "left_semi")
    last = rows.groupBy("object_key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "object_key"]), "nth").alias("e"))
    return last.select("object_key", "e.*")


def bodies(spark: SparkSession, at: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rows of ``current``) with the body of each, from the tier and batch that the index names."""
    both = read(spark, at, "online").withColumn("tier", F.lit("online")).unionByName(read(spark, at, "archive").withColumn("tier", F.lit("archive")))
    held = both.select("object_key", "tier", F.col("batch").alias("place"), "body")
    return wanted.join(held, ["object_key", "tier", "place"])


def put(rows: DataFrame, at: str, tier: str, batch: str) -> DataFrame:
    """Writes (object_key, platform, fetched_at, body) as the bodies of a batch, by platform and date, and reads back (object_key, body_hash). The rows
    of a folder meet in one task (large ones in several) before, so that there are about as many files as folders, not tasks times folders."""
    spark = rows.sparkSession
    own = rows.select("object_key", "body", F.col("platform").alias("platform_id"), F.to_date("fetched_at").alias("fetch_date"))
    own.hint("rebalance", "platform_id", "fetch_date").write.mode("overwrite").partitionBy("platform_id", "fetch_date").parquet(f"{at}/{tier}/batch={batch}")
    back = spark.read.schema("object_key string, body binary, platform_id long, fetch_date date").parquet(f"{at}/{tier}/batch={batch}")
    return back.select("object_key", F.sha2("body", 256).alias("body_hash"))


def enter(entries: DataFrame, at: str, batch: str, nth: int, counts: dict[str, int], alerts: DataFrame | None = None) -> dict[str, int]:
    """Writes the index entries and alerts of a batch and commits it."""
    spark = entries.sparkSession
    names = [f.split()[0] for f in INDEX.split(", ")][:-2]
    entries.select(*names, F.lit(nth).cast("long").alias("nth")).write.mode("overwrite").parquet(f"{at}/index/batch={batch}")
    if alerts is not None:
        alerts.select("object_key", "alert").write.mode("overwrite").parquet(f"{at}/alerts/batch={batch}")
    spark.createDataFrame([(nth, counts["written"], counts["known"], counts["failed"])], "nth long, written long, known long, failed long").coalesce(1).write.mode("overwrite").parquet(f"{at}/commits/batch={batch}")
    return counts


def told(commit: dict) -> dict[str, int]:
    return {k: commit[k] for k in ("written", "known", "failed")}


def append(fetched: DataFrame, at: str, batch: str, keep_days: int = 30) -> dict[str, int]:
    """Stores responses (url, at, content_hash, semantic_hash, platform, run, body): one object for each url and content hash that the store does not
    have. Counts: written, known (responses that add no object), failed (bodies that do not have their hash when they are read back; they get no entry).
    A batch that is committed already changes nothing and gives its counts again."""
    spark, done = fetched.sparkSession, committed(fetched.sparkSession, at)
    if batch in done:
        return told(done[batch])
    old = current(spark, at)
    states = old.groupBy("url").agg(F.max_by(F.struct("content_hash", "semantic_hash"), F.struct("fetched_at", "nth")).alias("s")).select("url", "s.*")
    hashes = fetched.select("url", "at", "content_hash", "semantic_hash", "platform", "run")
    new = written(V.new_snapshots(hashes, old.select("url", "content_hash"), states, keep_days).withColumnRenamed("at", "fetched_at"))
    keys = ["url", "content_hash"]
    body = fetched.select(*keys, "body").join(new.select(*keys).hint("merge"), keys, "left_semi").groupBy(*keys).agg(F.min("body").alias("body"))
    back = put(new.join(body.hint("merge"), keys), at, "online", batch)
    entries = written(new.join(back.hint("merge"), "object_key").withColumns({"tier": F.lit("online"), "place": F.lit(batch)}))
    good = entries.where("body_hash = content_hash")
    n = entries.agg(F.count_if(F.col("body_hash") == F.col("content_hash")).alias("good"), F.count("*").alias("every")).first()
    return enter(good, at, batch, len(done) + 1, {"written": n.good, "known": fetched.count() - n.every, "failed": n.every - n.good})


def archive(spark: SparkSession, at: str, batch: str, now: Column, limit: int, copied=None) -> dict[str, int]:
    """Moves the ``limit`` online objects that expired first (a batch's size is the feature) to the archive: bodies that have their hash are copied, the
    copies are read back and checked, then the index follows. Counts: written (archived), failed; of failures, before or after the copy, there are alerts,
    and they stay online. ``copied`` may change the copies (object_key, platform, fetched_at, body) on their way, for tests."""
    done = committed(spark, at)
    if batch in done:
        return told(done[batch])
    due = written(current(spark, at).where((F.col("tier") == "online") & (F.col("expires_at") <= now)).orderBy("expires_at", "url", "content_hash").limit(limit))
    held = bodies(spark, at, due).withColumn("intact", F.sha2("body", 256) == F.col("content_hash"))
    sent = held.where("intact")
    back = put(copied(sent) if copied else sent, at, "archive", batch)
    judged = written(due.join(back.hint("merge"), "object_key", "left").withColumn("fine", F.coalesce(F.col("body_hash") == F.col("content_hash"), F.lit(False))))
    moved = judged.where("fine").withColumns({"tier": F.lit("archive"), "place": F.lit(batch)})
    n = judged.agg(F.count_if("fine").alias("fine"), F.count("*").alias("every")).first()
    alerts = judged.where("not fine").select("object_key", F.when(F.col("body_hash").isNull(), "object checksum mismatch").otherwise("archive checksum mismatch").alias("alert"))
    return enter(moved, at, batch, len(done) + 1, {"written": n.fine, "known": 0, "failed": n.every - n.fine}, alerts)

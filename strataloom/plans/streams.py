"""Queries that run as streams over the given tables until all files are read, next to batch SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import folder
from ..streaming import observations as O
from ..streaming import states as ST
from . import versions as V
from .registry import query, read


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.source(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_id, user_id, event_type from events where event_id > 500")
def h01_change_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.drain(O.tail(events(spark, sf_dir), "event_id", 500).select("event_id", "user_id", "event_type"))


@query("select user_id as run, event_id as line, 'line' as kind from events where event_type in ('error', 'purchase') union all select distinct user_id, null::bigint, 'end' from events where event_type = 'purchase'")
def h02_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases of each user as the log of a run, which a purchase ends."""
    lines = events(spark, sf_dir).where(F.col("event_type").isin("error", "purchase"))
    return O.drain(O.tail_with_end(lines.select(F.col("user_id").alias("run"), F.col("event_id").alias("line"), (F.col("event_type") == "purchase").alias("final"))))


def log_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and the ends of complete days, written as an append-only log and read as a stream. Runs are numbered by day."""
    number = lambda d: F.unix_date(d).cast("long")
    seen = V.bought(spark, sf_dir).select((F.col("item") % 3).alias("platform"), F.col("item").cast("string").alias("item"), number(F.to_date("ts")).alias("run"), F.col("ts").cast("timestamp").alias("at"), "event_id", "payload")
    ends = V.complete_days(spark, sf_dir).select("platform", number("retired_on").alias("run"))
    return O.source(spark, folder_of(seen.unionByName(ends, allowMissingColumns=True)))


def folder_of(rows: DataFrame) -> str:
    at = folder(rows.sparkSession)
    rows.write.parquet(f"{at}/log")
    return f"{at}/log"


@query(f"select item, ts::date as seen_on, event, version_no::bigint as version_no, payload from (select item, ts, event, version_no, case when removed then before else payload end as payload from {V.SEEN_OR_GONE} where event <> 'unchanged')")
def h03_stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions, removals and recoveries in one stream. A removal shows the payload that the item had."""
    with ST.rocks(spark):
        out = O.drain(ST.item_events(log_with_ends(spark, sf_dir), shards=4))
    return out.select(F.col("item").cast("long").alias("item"), F.date_from_unix_date(F.col("run").cast("int")).alias("seen_on"), "event", "version_no", "payload")


@query("select distinct event_id, user_id, sha256(event_type) as content_hash from events union all select event_id, user_id, sha256('changed') from events where day(ts) % 3 = 0 and event_id % 2 = 0")
def h04_overlap_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third day is read twice, and every second event of it has another content then; each event comes out once for each content."""
    own = events(spark, sf_dir).select("event_id", "ts", "user_id", F.sha2("event_type", 256).alias("content_hash"))
    again = own.where(F.dayofmonth("ts") % 3 == 0).withColumn("content_hash", F.when(F.col("event_id") % 2 == 0, F.sha2(F.lit("changed"), 256)).otherwise(F.col("content_hash")))
    return O.drain(O.once_within(own.unionByName(again), ["event_id", "content_hash"], "ts").select("event_id", "user_id", "content_hash"))


@query(V.TRAILING)
def h05_stream_trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows: the events are written as a log and read as a stream; a row of no item, three days behind the last, then ends the log and closes those still open."""
    own = V.read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("item"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.col("event_type").alias("payload"))
    log, at = folder_of(own), folder(spark)
    changes = ST.trailing_day(O.source(spark, log), shards=256)
    with ST.rocks(spark, evolving=False):
        O.drain(changes, at)
        end = own.agg(F.max("at").alias("at")).select(F.lit(None).cast("string").alias("item"), (F.col("at") + F.make_dt_interval(F.lit(3))).alias("at"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("payload"))
        end.write.mode("append").parquet(log)
        return O.drain(changes, at)


@query(f"select user_id as item, platform, retired_on from {V.RETIRED}")
def h06_stream_absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of three platforms whose complete runs differ: what the stream of versions says of removals."""
    with ST.rocks(spark):
        out = O.drain(ST.item_events(log_with_ends(spark, sf_dir), shards=4).where("event = 'removed'"))
    return out.select(F.col("item").cast("long").alias("item"), "platform", F.date_from_unix_date(F.col("run").cast("int")).alias("retired_on"))


@query("select distinct url from pages")
def h07_stream_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page seen twice, a minute apart; a state is kept for no longer than the watermark."""
    rows = O.source(spark, f"{sf_dir}/pages.parquet").withColumn("seen", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("page_id") + F.col("seen")).cast("int")))
    return O.drain(O.once_within(rows.select("url", "at"), ["url"], "at", "30 days").select("url"))

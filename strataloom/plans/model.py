"""The catalogue's tables as views of the given ones, in Spark and in SQL: part is the item, nation the platform, a line item an observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versioning as V
from .registry import read

KINDS = ("STANDARD", "MEDIUM", "PROMO", "LARGE", "SMALL", "ECONOMY")
ONBOARDING = ("out_of_scope", "active", "blocked", "offline", "pending_audit", "pending_audit")

ITEMS = "(select p_partkey as item, p_partkey % 25 as platform, p_type as collection, p_partkey as state, case p_partkey % 3 when 0 then 'component' else 'product' end as kind, case when p_partkey % 13 = 0 then 'inactive' else 'active' end as status, 'P-' || p_partkey as external_id, timestamp '2024-01-01' + to_days((p_partkey % 30)::int) as first_seen, timestamp '2024-03-01' + to_days((p_partkey % 30)::int) as last_seen from part)"
LINES = "(select l_partkey, l_suppkey, l_returnflag || l_linestatus as payload, l_shipdate, l_orderkey, l_linenumber, l_discount, lag(l_returnflag || l_linestatus) over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) as before from lineitem where l_partkey % 17 <> 0)"
VERSIONS = f"""(select l_partkey as item, row_number() over w as version_no, lead(l_shipdate) over w is null as is_current, p_name as name, p_name || ' by contact' || l_partkey || '@example.org' as description,
 case when l_suppkey % 9 = 0 then '' else s_name end as provider, p_type as product_type, case when l_linenumber % 2 = 0 then l_shipdate end as published_at, l_shipdate as detected_at, l_discount as confidence, l_suppkey
 from {LINES} join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where before is null or before <> payload window w as (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber))"""
DIMS = f"""(select item, version_no, unnest(['product_type', 'industry', 'platform_province', 'platform_city']) as type, unnest([product_type, 'trade ' || l_suppkey % 7, r_name, n_name]) as raw, unnest([product_type, 'trade ' || l_suppkey % 7, r_name, n_name]) as value,
 unnest([0.96, 0.73, 1.0, 1.0])::double as confidence, unnest(['source', 'rule', 'registry', 'registry']) as method from {VERSIONS} join nation on n_nationkey = item % 25 join region on r_regionkey = n_regionkey)"""
PLATFORMS = f"(select n_nationkey::bigint as platform, case when n_nationkey % 3 = 0 then '' else n_name end as name, r_name as province, n_name as city, n_nationkey % 4 <> 1 as enabled, {list(ONBOARDING)!r}[1 + n_nationkey % 6] as onboarding from nation join region on r_regionkey = n_regionkey)"
COLLECTIONS = "(select platform, collection, case when platform % 2 = 0 then n * 9 // 10 end as expected, case when platform % 5 < 2 then 'complete' when platform % 5 = 2 and collection = 'PROMO' then 'blocked' when platform % 5 = 3 and collection = 'LARGE' then 'offline' else 'partial' end as status, collection <> 'SMALL' as enabled from (select p_partkey % 25 as platform, p_type as collection, count(*) as n from part where p_partkey % 25 <> 7 group by all))"
ERRORS = f'''(select event_id as id, user_id % 25 as platform, {list(KINDS)!r}[1 + event_id % 6] as collection, ts::date as run, ts as "at", props as message from events where event_type = 'error')'''
RUNS = "(select user_id % 25 as platform, ts::date as run, min(ts) as started_at, count(*) as pages, count(*) filter (event_type = 'error') as errors from events where user_id % 25 <> 4 group by all)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    day = lambda start: F.lit(start).cast("timestamp") + F.make_dt_interval((k % 30).cast("int"))
    return read(spark, sf_dir, "part").select(
        k.alias("item"), (k % 25).alias("platform"), F.col("p_type").alias("collection"), k.alias("state"), F.when(k % 3 == 0, "component").otherwise("product").alias("kind"),
        F.when(k % 13 == 0, "inactive").otherwise("active").alias("status"), F.concat(F.lit("P-"), k).alias("external_id"), day("2024-01-01").alias("first_seen"), day("2024-03-01").alias("last_seen"),
    )


ORDER = ["l_shipdate", "l_orderkey", "l_linenumber"]


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of items by return flag and line status; items whose key 17 divides have none."""
    lines = read(spark, sf_dir, "lineitem").where("l_partkey % 17 <> 0").select("l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("payload"), "l_discount", *ORDER)
    rows = V.intervals(V.history(lines, None, ["l_partkey"], ORDER, "payload"), ["l_partkey"], ORDER, "l_shipdate")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    rows = rows.join(parts, "l_partkey").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    mail = F.concat(F.col("p_name"), F.lit(" by contact"), "l_partkey", F.lit("@example.org"))
    return rows.select(
        F.col("l_partkey").alias("item"), "version_no", "is_current", F.col("p_name").alias("name"), mail.alias("description"), F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.col("s_name")).alias("provider"),
        F.col("p_type").alias("product_type"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")).alias("published_at"), F.col("l_shipdate").alias("detected_at"), F.col("l_discount").alias("confidence"), "l_suppkey",
    )


def dims(spark: SparkSession, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    """Dimensions of the versions; ``made``: the versions, if they are at hand."""
    places = platforms(spark, sf_dir).select("platform", "province", "city")
    rows = (versions(spark, sf_dir) if made is None else made).withColumn("platform", F.col("item") % 25).join(places, "platform")
    one = lambda kind, value, sure, method: F.struct(F.lit(kind).alias("type"), value.alias("raw"), value.alias("value"), F.lit(sure).alias("confidence"), F.lit(method).alias("method"))
    every = F.array(
        one("product_type", F.col("product_type"), 0.96, "source"), one("industry", F.concat(F.lit("trade "), F.col("l_suppkey") % 7), 0.73, "rule"),
        one("platform_province", F.col("province"), 1.0, "registry"), one("platform_city", F.col("city"), 1.0, "registry"),
    )
    return rows.select("item", "version_no", F.explode(every).alias("d")).select("item", "version_no", "d.*")


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    return places.select(k.cast("long").alias("platform"), F.when(k % 3 == 0, "").otherwise(F.col("n_name")).alias("name"), F.col("r_name").alias("province"), F.col("n_name").alias("city"), (k % 4 != 1).alias("enabled"), F.get(F.array(*map(F.lit, ONBOARDING)), k % 6).alias("onboarding"))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, kind = F.col("platform"), F.col("collection")
    rows = read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("platform"), F.col("p_type").alias("collection")).where("platform <> 7").groupBy("platform", "collection").agg(F.count("*").alias("n"))
    status = F.when(p % 5 < 2, "complete").when((p % 5 == 2) & (kind == "PROMO"), "blocked").when((p % 5 == 3) & (kind == "LARGE"), "offline").otherwise("partial")
    return rows.select("platform", "collection", F.when(p % 2 == 0, F.floor(F.col("n") * 9 / 10)).alias("expected"), status.alias("status"), (kind != "SMALL").alias("enabled"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 6).cast("int"))
    return read(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), (F.col("user_id") % 25).alias("platform"), kind.alias("collection"), F.to_date("ts").alias("run"), F.col("ts").alias("at"), F.col("props").alias("message"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("user_id % 25 <> 4").groupBy((F.col("user_id") % 25).alias("platform"), F.to_date("ts").alias("run"))
    return rows.agg(F.min("ts").alias("started_at"), F.count("*").alias("pages"), F.count_if(F.col("event_type") == "error").alias("errors"))

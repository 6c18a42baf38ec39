"""Queries over the observation log (events) and orders: versions, changes, absences, crawl analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import coverage as C
from ..operators import extract as X
from ..operators import frontier as FR
from ..operators import versioning as V
from . import model as M
from . import pages as P
from . import records as RP
from .registry import query, read

LOG = "(select event_id, ts, user_id as item, user_id % 5 as platform, event_type as payload from events)"
SEEN = f"(select *, lag(payload) over (partition by item order by ts, event_id) as before, row_number() over (partition by item order by ts, event_id) as nth from {LOG})"
EVENT = "case when nth = 1 then 'added' when payload = before then 'unchanged' else 'updated' end"
CHAIN = f"(select item, payload, ts as valid_from, lead(ts) over w as valid_to, row_number() over w as version_no, event_id from (select * from {SEEN} where nth = 1 or payload <> before) window w as (partition by item order by ts, event_id))"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("item"), (F.col("user_id") % 5).alias("platform"), F.col("event_type").alias("payload"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of users by event type, without removals."""
    return V.history(log(spark, sf_dir), None, ["item"], ["ts", "event_id"], "payload")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.intervals(states(spark, sf_dir), ["item"], ["ts", "event_id"], "ts")


# Purchases are sightings, users of one remainder by three are a platform's items, days are runs; a platform's run is complete where four does not divide day + platform.
RETIRED = """(with e as (select *, user_id % 3 as platform, ts::date as d from events), c as (select distinct platform, d from e where (day(ts) + platform) % 4 <> 0), s as (select distinct platform, user_id, d from e where event_type = 'purchase'), a as (select platform, d from c union select platform, d from s),
 n as (select a.platform, a.d, c.d is not null as whole, sum((c.d is not null)::int) over (partition by a.platform order by a.d) as n from a left join c on c.platform = a.platform and c.d = a.d), p as (select platform, user_id, d, n, n - whole::int as before from s join n using (platform, d)), g as (select *, lead(before) over (partition by user_id order by d) as nxt from p)
 select user_id, g.platform, n.d as retired_on from g join n on n.platform = g.platform and n.n = g.n + 3 and n.whole where coalesce(nxt, (select max(n) from n m where m.platform = g.platform)) - g.n >= 3)"""
SEEN_OR_GONE = f"""(with l as (select user_id as item, ts, event_id, event_id % 3 || '/' || event_id % 2 as payload, false as removed from events where event_type = 'purchase' union all select user_id, retired_on::timestamp, null, null, true from {RETIRED}),
 w as (select *, last_value(payload ignore nulls) over (partition by item order by ts rows between unbounded preceding and 1 preceding) as before, coalesce(lag(removed) over (partition by item order by ts), false) as gone from l),
 e as (select *, case when removed then 'removed' when before is null then 'added' when gone then 'recovered' when payload = before then 'unchanged' else 'updated' end as event, not removed and payload is distinct from before as fresh from w)
 select *, sum(fresh::int) over (partition by item order by ts)::int as version_no from e)"""


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of users by their purchases, with removals by absence."""
    return V.history(bought(spark, sf_dir), retired(spark, sf_dir).select(F.col("user_id").alias("item"), F.col("retired_on").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id")), ["item"], ["ts", "event_id"], "payload")


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, grade = (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 2).cast("string")
    return read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("item"), "ts", "event_id", F.concat_ws("/", part, grade).alias("payload"), part.alias("part"), grade.alias("grade"))


def complete_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete runs (platform, retired_on): days with an event of one of the platform's users, those of another quarter left out on each platform."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("platform"), F.to_date("ts").alias("retired_on"))
    return rows.where((F.dayofmonth("retired_on") + F.col("platform")) % 4 != 0).distinct()


def retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "events").where("event_type = 'purchase'").select((F.col("user_id") % 3).alias("platform"), "user_id", F.to_date("ts").alias("retired_on"))
    return V.absences(seen, complete_days(spark, sf_dir), ["user_id"], "retired_on", scope=("platform",))


@query(f"select item, ts, event, version_no from {SEEN_OR_GONE}")
def d04_upsert_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(spark, sf_dir).select("item", "ts", "event", "version_no")


@query(f"select item, version_no, payload, ts as valid_from, lead(ts) over (partition by item order by ts) as valid_to, lead(ts) over (partition by item order by ts) is null as is_current from {SEEN_OR_GONE} where fresh")
def d05_scd2_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of what was bought: a removal closes none, a recovery opens one only with a new payload."""
    return V.intervals(purchases(spark, sf_dir), ["item"], ["ts", "event_id"], "ts").select("item", "version_no", "payload", "valid_from", "valid_to", "is_current")


D09 = f"""select item, ts, event, version_no, case when removed then '{{"reason":"missing from complete full scans"}}' when before is null then '{{"diff":{{}}}}'
 else '{{"diff":{{' || array_to_string(list_filter([case when split_part(before, '/', 2) <> split_part(payload, '/', 2) then '"grade":{{"old":"' || split_part(before, '/', 2) || '","new":"' || split_part(payload, '/', 2) || '"}}' end,
 case when split_part(before, '/', 1) <> split_part(payload, '/', 1) then '"part":{{"old":"' || split_part(before, '/', 1) || '","new":"' || split_part(payload, '/', 1) || '"}}' end], lambda x: x is not null), ',') || '}}}}' end as payload from {SEEN_OR_GONE} where event <> 'unchanged'"""


@query(D09)
def d09_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log with the difference of part and grade."""
    return V.change_events(purchases(spark, sf_dir), ["item"], ["ts", "event_id"], ["part", "grade"]).drop("event_id")


@query(f"select user_id, platform, retired_on from {RETIRED}")
def d13_absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three platforms whose complete runs differ."""
    return retired(spark, sf_dir)


D02 = """select p_partkey, sha256('{"data_period_end":null,"data_period_start":null,"delivery_method":"","description":"' || p_name || '","dimensions":[["brand","' || p_brand || '","' || p_brand || '"],["product_type","' || lower(p_type) || '","' || p_type || '"]],"external_id":"' || p_partkey || '","kind":"product","name":"' || p_name
 || '","price_raw":"' || p_size || '","product_type":"' || lower(p_type) || '","product_type_raw":"' || p_type || '","provider":"' || p_brand || '","published_at":null,"refresh_frequency":"","source_fields":{"brand":"' || p_brand || '","name":"' || p_name || '"},"source_updated_at":null,"source_url":"https://h.org/' || p_partkey || '"}') as semantic_hash from part"""
HASHED = ["kind", "name", "external_id", "description", "provider", "product_type_raw", "product_type", "price_raw", "delivery_method", "refresh_frequency", "data_period_start", "data_period_end", "published_at", "source_updated_at", "source_url", "source_fields"]


@query(D02)
def d02_semantic_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seventeen fields; dimensions and source fields come in another order than they are hashed in."""
    none, c = F.lit(None).cast("string"), F.col
    pair = lambda kind, value, raw: F.struct(F.lit(kind).alias("type"), value.alias("value"), raw.alias("raw"))
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", F.lit("product").alias("kind"), c("p_name").alias("name"), c("p_partkey").cast("string").alias("external_id"), c("p_name").alias("description"), c("p_brand").alias("provider"), c("p_type").alias("product_type_raw"), F.lower("p_type").alias("product_type"),
        c("p_size").cast("string").alias("price_raw"), F.lit("").alias("delivery_method"), F.lit("").alias("refresh_frequency"), none.alias("data_period_start"), none.alias("data_period_end"), none.alias("published_at"), none.alias("source_updated_at"),
        F.concat(F.lit("https://h.org/"), "p_partkey").alias("source_url"), F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand").alias("source_fields"), F.array(pair("product_type", F.lower("p_type"), c("p_type")), pair("brand", c("p_brand"), c("p_brand"))).alias("dimensions"),
    )
    return rows.select("p_partkey", V.semantic_hash(rows, HASHED).alias("semantic_hash"))


RULES = [("product_type", " Promo", "promotion", 0.99, True, 1), ("product_type", "PROMO ", "bargain", 0.97, True, 4), ("brand", "BRAND#11", "house", 0.9, True, 2), ("product_type", "LARGE", "bulk", 0.9, False, 3), ("product_type", "promo", "never", 1.0, False, 9), ("brand", "SMALL", "x", 0.9, True, 5)]
D03 = """(with d as (select p_partkey, unnest(['product_type', 'brand']) as type, unnest([p_type, p_brand]) as raw from part)
select p_partkey, type, raw, case when type = 'product_type' and raw = 'PROMO' then 'bargain' when type = 'brand' and raw = 'Brand#11' then 'house' else lower(raw) end as value,
 case when type = 'product_type' and raw = 'PROMO' then 0.97 when type = 'brand' and raw = 'Brand#11' then 0.9 else 0.5 end::double as confidence, case when (type = 'product_type' and raw = 'PROMO') or (type = 'brand' and raw = 'Brand#11') then 'taxonomy_mapping' else 'raw' end as method from d)"""


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "type string, raw string, mapped string, sure double, enabled boolean, id int")
    dims = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.create_map(F.lit("product_type"), "p_type", F.lit("brand"), "p_brand")).alias("type", "raw"))
    return V.apply_mappings(dims.select("*", F.lower("raw").alias("value"), F.lit(0.5).alias("confidence"), F.lit("raw").alias("method")), rules, "id")


@query(f"select * from {D03}")
def d03_mapping_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two enabled rules for one value, the later of which holds; two are disabled, one is of another type."""
    return mapped(spark, sf_dir)


@query(f"select p_partkey, value as product_type from {D03} where type = 'product_type'")
def d03_mapped_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' own types under the same rules."""
    items = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("product_type"))
    return V.mapped_types(items, mapped(spark, sf_dir), "p_partkey")


@query(f"select k, n as version_no, field, case when n = 2 then 'was ' || value else value end as raw, locator, case when n = 2 then 'json' else 'rule' end as method, case when n = 2 then 0.9 else 1.0 end::double as confidence, 's' || k || '-' || n as snapshot from {RP.FIELDS}, (select unnest([1, 2]) as n) where value is not null")
def d08_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each part: the second one's fields come from another extraction."""
    k, n = F.col("k"), F.col("version_no")
    versions = RP.parts(spark, sf_dir).select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("version_no")).withColumn("snapshot", F.concat(F.lit("s"), k, F.lit("-"), n))
    one = RP.page_fields(spark, sf_dir).select("k", F.lit(1).alias("version_no"), "field", "value", "locator", F.lit("rule").alias("method"), F.lit(1.0).alias("confidence"))
    two = one.withColumns({"version_no": F.lit(2), "value": F.concat(F.lit("was "), "value"), "method": F.lit("json"), "confidence": F.lit(0.9)})
    return V.evidence_rows(versions, one.unionByName(two), ["k", "version_no"])


D10 = r"""with d as (select doc_id as item, lang as kind, lower(trim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 40))) as name, case when doc_id % 10 = 0 then '' else 'p' end as provider from documents),
known as (select kind, name, min(item) + 1000000 as known from d where item % 4 = 0 and provider <> '' group by all),
fresh as (select * from d where item % 4 <> 0), h as (select kind, name, min(item) as head from fresh where provider <> '' group by all)
select item, case when provider = '' then item else coalesce(known, head) end as entity, case when provider = '' or (known is null and item = head) then 'new_entity' else 'exact_name_provider' end as method, case when provider = '' or (known is null and item = head) then 1.0 else 0.995 end::double as confidence
from fresh left join h using (kind, name) left join known using (kind, name)"""


@query(D10)
def d10_entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and beginning; every fourth is linked already, to an entity of its own making."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("kind"), F.substring(T.squeezed(F.col("text")), 1, 40).alias("name"), F.when(F.col("doc_id") % 10 == 0, "").otherwise("P").alias("provider"))
    linked = docs.where("item % 4 = 0")
    known = linked.where("provider <> ''").groupBy("kind", F.lower("name").alias("name")).agg((F.min("item") + 1000000).alias("entity")).select("entity", "kind", "name", F.lit("p").alias("provider"))
    return V.link_entities(docs, known, linked)


D11 = P.SQL_LINKS + f""", old as (select to_url as url, max(case when page_id % 3 = 0 then page_id % 5 end) as collection, case when min(page_id) % 4 = 0 then min(anchor) else '' end as anchor, min(place) + 2 as depth, case when min(page_id) % 6 = 0 then 'entry' else 'unknown' end as role, min(page_id) as first_seen, max(page_id) as last_seen from links where page_id % 2 = 0 group by 1),
s as (select to_url as url, case when page_id % 3 = 0 then page_id % 7 end as collection, case when page_id % 5 = 1 then '' else anchor end as anchor, place % 4 + 1 as depth, {P.role_sql('to_url', 'anchor')} as role, page_id as "at", place as nth from links where page_id % 2 = 1),
n as (select url, arg_min(collection, ("at", nth)) filter (collection is not null) as collection, arg_min(anchor, ("at", nth)) filter (anchor <> '') as anchor, min(depth) as depth, arg_min(role, ("at", nth)) filter (role <> 'unknown') as role, min("at") as f, max("at") as l from s group by 1)
select url, coalesce(old.collection, n.collection) as collection, coalesce(nullif(old.anchor, ''), n.anchor, '') as anchor, least(old.depth, n.depth)::int as depth, coalesce(nullif(old.role, 'unknown'), n.role, 'unknown') as role, coalesce(first_seen, f) as first_seen, greatest(last_seen, l) as last_seen, l is not null as active from old full join n using (url)"""


@query(D11)
def d11_url_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States from the links of even pages, merged with those of odd pages."""
    k = F.col("page_id")
    found = X.links(read(spark, sf_dir, "pages"))
    old = found.where(k % 2 == 0).groupBy(F.col("to_url").alias("url")).agg(
        F.max(F.when(k % 3 == 0, k % 5)).alias("collection"), F.when(F.min("page_id") % 4 == 0, F.min("anchor")).otherwise("").alias("anchor"), (F.min("place") + 2).alias("depth"), F.when(F.min("page_id") % 6 == 0, "entry").otherwise("unknown").alias("role"), F.min("page_id").alias("first_seen"), F.max("page_id").alias("last_seen"), F.lit(False).alias("active")
    )
    role = U.page_role(F.col("to_url"), F.col("anchor"), F.lit(""))
    seen = found.where(k % 2 == 1).select(F.col("to_url").alias("url"), F.when(k % 3 == 0, k % 7).alias("collection"), F.when(k % 5 == 1, "").otherwise(F.col("anchor")).alias("anchor"), (F.col("place") % 4 + 1).alias("depth"), role.alias("role"), k.alias("at"), F.col("place").alias("nth"))
    return V.merge_states(old, seen)


@query("""with s as (select page_id, url, timestamp '2023-12-01' + to_minutes(page_id::int) as fetched, page_id % 3 as errors, 'e' || page_id as etag from pages),
r as (select url, max(ts) as seen, arg_max('t' || event_id, (ts, 't' || event_id)) filter (event_id % 2 = 0) as tag from events join pages on page_id = user_id where event_type = 'click' group by 1)
select url, case when seen is null then 200 else 304 end as http_status, coalesce(seen, fetched) as last_fetched, case when seen is null then errors else 0 end::int as errors, coalesce(tag, etag) as etag from s left join r using (url)""")
def d12_not_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are 304 answers for the URL of the page of the user's number; every second one has a new tag. Pages of one URL have its answers in common."""
    k = F.col("page_id")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    old = pages.select("url", F.lit(200).alias("http_status"), (F.lit("2023-12-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, int(page_id))")).alias("last_fetched"), (k % 3).cast("int").alias("errors"), F.concat(F.lit("e"), k).alias("etag"))
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("page_id"), F.col("ts").alias("at"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), "event_id")).alias("new_etag"))
    return V.not_modified(old, clicks.join(pages, "page_id").drop("page_id"))


@query("with l as (select *, lag(o_orderstatus) over w as os, lag(o_orderpriority) over w as op, row_number() over w as nth from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)), u as (select o_custkey, o_orderdate, o_orderkey, unnest(['o_orderstatus', 'o_orderpriority']) as field, unnest([os, op]) as old, unnest([o_orderstatus, o_orderpriority]) as new from l where nth > 1) select * from u where old is distinct from new")
def d06_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.diff(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


PAGED = "(select user_id, event_id, ts, event_type, ((row_number() over (partition by user_id order by ts, event_id) - 1) // 10) as page_no, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in pages of ten."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").withColumns({"page_no": F.floor((F.row_number().over(own) - 1) / 10), "before": F.lag("event_type").over(own)})


@query(f"with p as (select user_id, page_no, count(*) filter (before is distinct from event_type) > 7 as changed from {PAGED} group by all), g as (select *, sum(changed::int) over (partition by user_id order by page_no) as island from p), r as (select *, row_number() over (partition by user_id, island order by page_no) - case when island > 0 then 1 else 0 end as nth from g) select user_id, min(page_no) as stop_page from r where nth >= 2 group by user_id")
def e06_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = paged(spark, sf_dir).groupBy("user_id", "page_no").agg((F.count_if(~F.col("before").eqNullSafe(F.col("event_type"))) > 7).alias("changed"))
    return V.unchanged_runs(pages, ["user_id"], "page_no", "changed", 2)


@query(f"select item, version_no::int as version_no, payload, valid_from from {CHAIN} where item = 7 order by version_no desc")
def g09_version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where("item = 7").select("item", "version_no", "payload", "valid_from").orderBy(F.desc("version_no"))


@query(f"select item, payload, version_no::int as version_no from {CHAIN} where valid_from <= timestamp '2024-01-15' and (valid_to is null or timestamp '2024-01-15' < valid_to)")
def i01_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.as_of(versions(spark, sf_dir), F.lit("2024-01-15").cast("timestamp")).select("item", "payload", "version_no")


I01_EACH = """with p as (select l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice from lineitem where l_linenumber % 2 = 1), v as (select l_partkey, l_shipdate, l_extendedprice, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) as nth from p),
o as (select l_orderkey, l_linenumber, l_partkey, o_orderdate from lineitem join orders on o_orderkey = l_orderkey where l_linenumber % 2 = 0),
u as (select l_partkey, l_shipdate as t, 0 as k, nth, l_extendedprice as price, null::bigint as o, null::bigint as l from v union all select l_partkey, o_orderdate, 1, null, null, l_orderkey, l_linenumber from o),
h as (select *, last_value(price ignore nulls) over w as price_then, last_value(nth ignore nulls) over w as version_then from u window w as (partition by l_partkey order by t, k, nth rows between unbounded preceding and current row))
select o as l_orderkey, l as l_linenumber, l_partkey, t as o_orderdate, price_then as price, version_then as version_no from h where k = 1"""


@query(I01_EACH)
def i01_as_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each second line of an order the price of its part that held on the order's day: the last of the other lines shipped by then."""
    lines = read(spark, sf_dir, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")).cast("long")
    prices = lines.where("l_linenumber % 2 = 1").select("l_partkey", "l_shipdate", F.col("l_extendedprice").alias("price"), nth.alias("version_no"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    sold = lines.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey").join(orders, "l_orderkey")
    return V.as_of_each(sold, prices, ["l_partkey"], "o_orderdate", "l_shipdate", ["version_no"], ["price", "version_no"])


@query("with d as (select user_id % 5 as platform, ts::date as run, count(*) as n from events group by all) select platform, run, n, n < 0.8 * median(n) over (partition by platform order by run rows between 4 preceding and 1 preceding) as dropped from d")
def i02_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("platform"), F.to_date("ts").alias("run")).agg(F.count("*").alias("n"))
    usual = F.percentile("n", 0.5).over(Window.partitionBy("platform").orderBy("run").rowsBetween(-4, -1))
    return days.select("platform", "run", "n", (F.col("n") < 0.8 * usual).alias("dropped"))


@query(f"select date_trunc('hour', ts) as hour, count(*) filter (nth = 1) as added, count(*) filter (nth > 1 and payload <> before) as updated from {SEEN} group by 1")
def h05_changes_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = states(spark, sf_dir)
    return rows.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(F.col("event") == "added").alias("added"), F.count_if(F.col("event") == "updated").alias("updated"))


GATES = """
with runs as (select distinct ts::date as run from events), own as (select distinct user_id % 5 as platform from events),
d as (select platform, run, count(user_id) as n, count(*) filter (user_id is not null and (event_type is null or value is null)) as missing, count(*) filter (event_type = 'error') as errors
  from runs cross join own left join (select *, user_id % 5 as platform, ts::date as run from events) using (platform, run) group by platform, run),
h as (select *, median(n) over w as usual, max(n) over (partition by platform order by run rows between unbounded preceding and 1 preceding) as most from d window w as (partition by platform order by run rows between 4 preceding and 1 preceding)),
g as (select platform, run, n, coalesce(n < 0.8 * usual, false) as dropped, n > 0 and missing > 0.02 * n as fields_missing, n > 0 and n - errors < 0.95 * n as detail_failed, coalesce(n = 0 and most > 0, false) as vanished from h)
select *, not (dropped or fields_missing or detail_failed or vanished) as publish from g
"""


@query(GATES)
def i02_publish_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four gates for every platform and run, also where a platform has no event; required fields are event_type and value."""
    events = read(spark, sf_dir, "events").withColumns({"platform": F.col("user_id") % 5, "run": F.to_date("ts")}).where("user_id is not null")
    bare = F.col("event_type").isNull() | F.col("value").isNull()
    counts = events.groupBy("platform", "run").agg(F.count("*").alias("n"), F.count_if(bare).alias("missing"), F.count_if(F.col("event_type") == "error").alias("errors"))
    runs = read(spark, sf_dir, "events").select(F.to_date("ts").alias("run")).distinct()
    days = runs.crossJoin(events.select("platform").distinct()).join(counts, ["platform", "run"], "left").fillna(0, ["n", "missing", "errors"])
    past = Window.partitionBy("platform").orderBy("run")
    usual, most = F.percentile("n", 0.5).over(past.rowsBetween(-4, -1)), F.max("n").over(past.rowsBetween(Window.unboundedPreceding, -1))
    n, no = F.col("n"), F.lit(False)
    gates = {
        "dropped": F.coalesce(n < 0.8 * usual, no),
        "fields_missing": (n > 0) & (F.col("missing") > 0.02 * n),
        "detail_failed": (n > 0) & (n - F.col("errors") < 0.95 * n),
        "vanished": F.coalesce((n == 0) & (most > 0), no),
    }
    return days.select("platform", "run", "n", *[g.alias(k) for k, g in gates.items()]).withColumn("publish", F.expr("not (dropped or fields_missing or detail_failed or vanished)"))


TRAILING = f"select date_trunc('hour', ts) + (k + 1) * interval 1 hour as until, count(*) filter (nth = 1) as added, count(*) filter (nth > 1 and payload <> before) as updated from {SEEN}, range(24) r(k) group by 1"


@query(TRAILING)
def h05_changes_trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the 24 hours before each full hour: counts by hour first, each then in 24 windows."""
    hours = h05_changes_by_hour(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(24))))
    return hours.groupBy((F.col("hour") + F.make_dt_interval(hours="k")).alias("until")).agg(F.sum("added").alias("added"), F.sum("updated").alias("updated"))


@query(f"""with p as (select user_id, page_no, count(*) as n from {PAGED} group by all), s as (select *, sum(n) over (partition by user_id order by page_no) as upto, case when user_id % 3 = 0 then 60 end as total, case when user_id % 3 = 1 then 4 end as pages from p),
r as (select *, case when n = 0 then 'empty_page' when upto >= total then 'total_reached' when page_no + 1 >= pages then 'page_count_reached' when n < 10 then 'short_page' end as reason from s) select user_id, arg_min(page_no, page_no) as end_page, arg_min(reason, page_no) as reason from r where reason is not null group by user_id""")
def e07_pagination_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the lists states a total, a third a number of pages."""
    pages = paged(spark, sf_dir).groupBy("user_id", "page_no").agg(F.count("*").alias("n"))
    return FR.paging_end(pages, "user_id", 10, F.when(F.col("user_id") % 3 == 0, 60), F.when(F.col("user_id") % 3 == 1, 4))


@query("select user_id as collection, coalesce(max(case when code between 200 and 299 and role = 'api' then event_id % 40 end), 0) + 1 as resume_at from (select *, case event_type when 'view' then 200 when 'click' then 206 when 'error' then 503 when 'signup' then 403 else 304 end as code, case when event_id % 7 = 0 then 'listing' else 'api' end as role from events) group by 1")
def e05_resume_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are fetched pages of the user's collection."""
    codes = F.create_map(*[F.lit(x) for kv in {"view": 200, "click": 206, "error": 503, "signup": 403, "purchase": 304}.items() for x in kv])
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("collection"), U.page_url(F.lit("https://api.example.org/v1?a=1"), k % 40).alias("url"), F.when(k % 7 == 0, "listing").otherwise("api").alias("role"), codes[F.col("event_type")].alias("http_status"))
    return FR.resume_page(rows)


CODES = (200, 304, 403, 404, 410, 429, 500, 503, 501, 418)
E08 = f"""with r as (select event_id, {list(CODES)!r}[1 + event_id % 10] as code, case when event_id % 3 = 0 then 'sitemap' else 'api' end as role, event_id % 11 <> 0 as is_json, event_id % 13 <> 0 as fine, event_id % 17 <> 0 as listed from events),
o as (select event_id, code, case when code = 304 then 'not_modified' when role = 'sitemap' and code in (404, 410) then 'ignored' when code >= 400 then 'http_status' when not is_json then 'not_json' when not fine then 'business_status' when not listed then 'schema' else 'ok' end as outcome from r)
select event_id, outcome, outcome = 'http_status' and code in (408, 425, 429, 500, 502, 503, 504) as retryable, (outcome = 'http_status' and code in (401, 403, 418, 451)) or outcome in ('business_status', 'schema') as blocked from o"""


@query(E08)
def e08_response_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as responses of all sorts."""
    k = F.col("event_id")
    code = F.get(F.array(*map(F.lit, CODES)), (k % 10).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", FR.outcome(code, F.when(k % 3 == 0, "sitemap").otherwise("api"), k % 11 != 0, k % 13 != 0, k % 17 != 0).alias("o")).select("event_id", "o.*")


@query(P.SQL_LINKS + " select page_id, to_url from links where not (page_id % 2 = 0 and (contains(lower(to_url), '/about') or contains(lower(to_url), 'page=')))")
def e09_adapter_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of even pages' adapter without those that its cards cover."""
    rules = spark.createDataFrame([("cards", "/about"), ("cards", "page="), ("other", "/")], "adapter string, pattern string")
    rows = X.links(read(spark, sf_dir, "pages")).withColumn("adapter", F.when(F.col("page_id") % 2 == 0, "cards").otherwise("generic"))
    return FR.without_covered(rows, rules).select("page_id", "to_url")


@query(f"with p as (select *, row_number() over (partition by user_id order by ts, event_id) as nth from {PAGED} where page_no = 0) select user_id, count(*) as n_records, sha256(string_agg(event_id || ':' || event_type, chr(10) order by nth)) as records_hash, string_agg(event_id::varchar, ',' order by nth) as first_ids from p group by user_id")
def f06_first_page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = paged(spark, sf_dir).select("user_id", "page_no", F.struct("ts", "event_id").alias("nth"), F.col("event_id").cast("string").alias("id"), F.concat_ws(":", "event_id", "event_type").alias("record"))
    return C.first_pages(rows, "user_id", 0).withColumn("first_ids", F.array_join("first_ids", ","))


RESULTS = "(select n_nationkey::bigint as platform, ['success', 'partial', 'blocked', 'failed', 'no_url', 'success'][1 + n_nationkey % 6] as status from nation)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a run's platforms."""
    word = F.get(F.array(*map(F.lit, ("success", "partial", "blocked", "failed", "no_url", "success"))), F.col("n_nationkey") % 6)
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("platform"), word.alias("status"))


@query(f"select platform, case status when 'failed' then 'error' else 'warning' end as severity, 'crawl_platform_failure' as alert_type, 'platform ' || platform || ' ' || status as title from {RESULTS} where status in ('failed', 'blocked')")
def f08_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.alerts(results(spark, sf_dir))


COUNTERS = f"(select item % 5 as platform, ts::date as run, count(distinct item) as urls, count(*) as pages, count(*) filter (nth > 1 and payload <> before) as changed, count(*) filter (payload <> 'error') as items_seen, count(*) filter (nth = 1) as items_new, count(*) filter (nth > 1 and payload <> before and payload <> 'error') as items_updated, count(*) filter (payload = 'error') as errors from {SEEN} group by all)"


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = F.col("payload") != "error"
    return states(spark, sf_dir).groupBy("platform", F.to_date("ts").alias("run")).agg(
        F.countDistinct("item").alias("urls"), F.count("*").alias("pages"), F.count_if(F.col("event") == "updated").alias("changed"), F.count_if(fine).alias("items_seen"), F.count_if(F.col("event") == "added").alias("items_new"), F.count_if((F.col("event") == "updated") & fine).alias("items_updated"), F.count_if(~fine).alias("errors")
    )


@query(f"select * from {COUNTERS}")
def f09_platform_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(spark, sf_dir)


@query(f"""with r as (select n.*, coalesce(pages, 0) as pages, coalesce(items_seen, 0) as items_seen, coalesce(items_new, 0) as items_new, coalesce(items_updated, 0) as items_updated, coalesce(errors, 0) as errors from {RESULTS} n left join (select * from {COUNTERS} where run = date '2024-01-12') c using (platform))
select 'partial' as status, count(*) as platforms, count(*) filter (status = 'success') as success, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'blocked') as blocked, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'no_url') as no_url,
 sum(pages)::bigint as pages, sum(items_seen)::bigint as items_seen, sum(items_new)::bigint as items_new, sum(items_updated)::bigint as items_updated, sum(errors)::bigint as errors from r""")
def f07_run_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = counters(spark, sf_dir).where("run = date'2024-01-12'")
    return C.run_roll_up(results(spark, sf_dir).join(day, "platform", "left").fillna(0))


@query("select event_id, ts, event_type from events where event_id > 1000 order by event_id limit 200")
def g20_change_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").where("event_id > 1000").select("event_id", "ts", "event_type").orderBy("event_id").limit(200)


I06 = f"""with e as (select user_id % 5 as platform, user_id % 3 as collection, {list(CODES)!r}[1 + event_id % 10] as code, event_id % 4 as attempt, ts from events)
select platform, collection, count(*) as n, round(count(*) filter (code < 400) / count(*), 6) as success_rate, round(count(*) filter (code = 304) / count(*), 6) as not_modified_rate, round(count(*) filter (attempt > 1) / count(*), 6) as retry_rate,
 count(*) filter (code // 100 = 2) as n_2xx, count(*) filter (code // 100 = 3) as n_3xx, count(*) filter (code // 100 = 4) as n_4xx, count(*) filter (code // 100 = 5) as n_5xx, round(count(*) filter (ts >= timestamp '2024-01-29 22:00:00') / count(*), 6) as fresh_rate, max(ts) as latest from e group by rollup (platform, collection)"""


@query(I06)
def i06_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and response classes by platform and collection, with both totals; fresh is what is no older than 26 hours."""
    k = F.col("event_id")
    code = F.get(F.array(*map(F.lit, CODES)), (k % 10).cast("int"))
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("platform"), (F.col("user_id") % 3).alias("collection"), code.alias("code"), (k % 4).alias("attempt"), F.col("ts").alias("at"))
    return C.metrics(rows, F.lit("2024-01-31").cast("timestamp"))


I07 = """with f as (select user_id, ts, event_type = 'error' as bad, lag(event_type = 'error') over (partition by user_id order by ts, event_id) as bad_before, event_type = 'purchase' as full_scan from events)
select user_id, count(*) filter (bad and bad_before) > 0 as failed_twice, max(ts) < timestamp '2024-01-29 22:00:00' as stale, coalesce(max(ts) filter (full_scan) < timestamp '2024-01-24', true) as no_full_scan from f group by user_id"""


@query(I07)
def i07_failure_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two failures in a row, nothing new for 26 hours, no full scan for 7 days."""
    rows = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("nth"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("full_scan"))
    return C.staleness(rows, "user_id", F.lit("2024-01-31").cast("timestamp"))


@query("select ts::date as run, count(distinct user_id) as n, sum(distinct ('0x' || left(md5(user_id::varchar), 15))::bigint)::varchar as ids_sum, sum(distinct ('0x' || right(md5(user_id::varchar), 15))::bigint)::varchar as ids_check from events group by 1")
def i09_run_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two order-free sums of 60-bit hashes of a run's distinct ids: no list of ids is gathered."""
    ids = read(spark, sf_dir, "events").select(F.to_date("ts").alias("run"), F.col("user_id").cast("string").alias("id")).distinct()
    half = lambda at: F.conv(F.substring(F.md5("id"), at, 15), 16, 10).cast("decimal(38,0)")
    return ids.groupBy("run").agg(F.count("*").alias("n"), F.sum(half(1)).cast("string").alias("ids_sum"), F.sum(half(18)).cast("string").alias("ids_check"))

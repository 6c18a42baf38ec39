"""Search, facets, details, lists and roll-ups over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as K
from ..sources.tables import written
from . import model as M
from .registry import query, read

SHOWN = "coalesce(nullif(name, ''), 'unknown')"
CURRENT = f"(select * from {M.VERSIONS} where is_current)"


@query(f"""select p.platform, coalesce(nullif(p.name, ''), 'unknown') as name, coalesce(i.n, 0) as active_items, coalesce(c.n, 0) as collections, r.started_at as last_start, r.pages as last_pages, r.errors as last_errors from {M.PLATFORMS} p
 left join (select platform, count(*) as n from {M.ITEMS} where status = 'active' group by 1) i using (platform) left join (select platform, count(*) as n from {M.COLLECTIONS} group by 1) c using (platform)
 left join (select *, row_number() over (partition by platform order by started_at desc) as nth from {M.RUNS}) r on r.platform = p.platform and nth = 1""")
def g01_platform_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.platform_list(M.platforms(spark, sf_dir), M.items(spark, sf_dir), M.collections(spark, sf_dir), M.runs(spark, sf_dir))
    return rows.select("platform", "name", "active_items", "collections", F.col("last_run.started_at").alias("last_start"), F.col("last_run.pages").alias("last_pages"), F.col("last_run.errors").alias("last_errors"))


@query(f"select platform, collection, expected, status, enabled from {M.COLLECTIONS} where platform in (3, 4) order by platform, collection")
def g02_collection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.collections(spark, sf_dir).where("platform in (3, 4)").orderBy("platform", "collection")


G03 = f"""
select v.item, coalesce(nullif(p.name, ''), 'unknown') as platform_name, v.name, v.provider, v.description, coalesce(published_at, detected_at) as "at", version_no from {M.ITEMS} i join {CURRENT} v using (item) join {M.PLATFORMS} p on p.platform = i.platform
where i.status = 'active' and kind = 'product' and product_type = 'PROMO' and provider ilike '%0%' and (published_at >= timestamp '1999-01-01' and published_at <= timestamp '2001-12-31') and (v.name ilike '%e%' or description ilike '%e%' or provider ilike '%e%')
and exists (select 1 from {M.DIMS} d where d.item = v.item and d.version_no = v.version_no and type = 'industry' and value = 'trade 3')
and exists (select 1 from {M.DIMS} d where d.item = v.item and d.version_no = v.version_no and type in ('platform_province', 'platform_city', 'coverage_region') and value = 'ASIA')
"""
MASKED = "regexp_replace(description, '(co)ntact[0-9]+@', '\\1***@')"


@query(f"with s as ({G03}) select item, platform_name, name, provider, {MASKED} as description, \"at\", version_no::int as version_no from s order by \"at\" desc, item limit 20")
def g03_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters at once, over versions that are made once."""
    import datetime

    made = written(M.versions(spark, sf_dir))
    rows = K.search(
        M.items(spark, sf_dir), made, M.dims(spark, sf_dir, made), M.platforms(spark, sf_dir), q="e", kind="product", product_type="PROMO", industry="trade 3", region="ASIA", provider="0",
        published_from=datetime.datetime(1999, 1, 1), published_to=datetime.datetime(2001, 12, 31),
    )
    return K.page_of(rows, [F.desc("at"), "item"], 1, 20).select("item", "platform_name", "name", "provider", "description", "at", "version_no")


@query("select doc_id from documents where text ilike '%there%' or source ilike '%there%' or lang ilike '%there%'")
def g04_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(K.like(["text", "source", "lang"], " there ")).select("doc_id")


@query(f"""select v.item, version_no::int as version_no from {M.ITEMS} i join {CURRENT} v using (item) where exists (select 1 from {M.DIMS} d where d.item = v.item and d.version_no = v.version_no and type = 'industry' and value = 'trade 2')
 and exists (select 1 from {M.DIMS} d where d.item = v.item and d.version_no = v.version_no and type in ('platform_province', 'platform_city', 'coverage_region') and value = 'EUROPE')""")
def g05_exists_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all states by industry and region."""
    return K.search(M.items(spark, sf_dir), M.versions(spark, sf_dir), M.dims(spark, sf_dir), M.platforms(spark, sf_dir), industry="trade 2", region="EUROPE", status=None).select("item", "version_no")


@query("select p_partkey, p_name, (select count(*) from part where p_type = 'PROMO') as total from part where p_type = 'PROMO' order by p_name, p_partkey limit 25 offset 50")
def g06_count_and_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_total(read(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 3, 25)


@query(f"""select item, version_no::int as version_no, '{{"industry":"' || max(value) filter (type = 'industry') || '","platform_city":"' || max(value) filter (type = 'platform_city') || '","platform_province":"' || max(value) filter (type = 'platform_province') || '","product_type":"' || max(value) filter (type = 'product_type') || '"}}' as dimensions from {M.DIMS} group by 1, 2""")
def g07_dimension_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dimension_maps(M.dims(spark, sf_dir)).select("item", "version_no", F.to_json("dimensions").alias("dimensions"))


G08 = f"""
with c as (select l_partkey as item from (select distinct l_partkey from lineitem where l_suppkey % 10 = 3)), v as (select * from {CURRENT} semi join c using (item)),
d as (select item, string_agg(type || '=' || value || '/' || method, ';' order by type) as dims from {M.DIMS} semi join v using (item, version_no) group by item),
e as (select item, 'provider=' || case when provider = '' then '' else 'ma***@example.org' end || '@' || item || '-' || version_no as ev from v)
select v.item, coalesce(nullif(p.name, ''), 'unknown') as platform_name, i.external_id, v.version_no::int as version_no, {MASKED} as description, dims, ev as evidence, case when v.item % 2 = 0 then v.item // 10 end as entity,
  case when v.item % 4 <> 0 then sha256(v.item || '-' || v.version_no) end as content_hash, '{{"mail":"ma***@example.org","state":"' || v.product_type || '"}}' as source_fields
from v join {M.ITEMS} i using (item) join {M.PLATFORMS} p on p.platform = i.platform left join d using (item) left join e using (item)
"""


@query(G08)
def g08_item_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the items that some suppliers sell, with evidence, entity and the snapshot of their current version, though later and earlier ones exist."""
    shot = F.concat_ws("-", "item", "version_no")
    made = written(M.versions(spark, sf_dir))
    mail = F.when(F.col("provider") == "", "").otherwise(F.concat(F.lit("maker"), F.col("item"), F.lit("@example.org")))
    evidence = made.select("item", "version_no", F.lit("provider").alias("field"), mail.alias("raw"), F.lit("dl").alias("locator"), F.lit("rule").alias("method"), F.lit(1.0).alias("confidence"), shot.alias("snapshot"))
    versions = made.withColumns({"snapshot": shot, "source_fields": F.create_map(F.lit("state"), "product_type", F.lit("mail"), F.concat(F.lit("maker"), F.col("item"), F.lit("@example.org")))})
    every = made.where("item % 4 <> 0").select(shot.alias("snapshot"), F.col("detected_at").alias("fetched_at"), F.sha2(shot, 256).alias("content_hash"), F.lit("key").alias("object_key"), F.lit("online").alias("tier"))
    links = M.items(spark, sf_dir).where("item % 2 = 0").select("item", F.floor(F.col("item") / 10).alias("entity"))
    chosen = read(spark, sf_dir, "lineitem").where("l_suppkey % 10 = 3").select(F.col("l_partkey").alias("item"))
    rows = K.item_details(M.items(spark, sf_dir), versions, M.dims(spark, sf_dir, made), evidence, every, links, M.platforms(spark, sf_dir), chosen)
    dims = F.array_join(F.transform("dimensions", lambda d: F.concat(d.type, F.lit("="), d.value, F.lit("/"), d.method)), ";")
    seen = F.array_join(F.transform("evidence", lambda e: F.concat(e.field, F.lit("="), e.raw, F.lit("@"), e.snapshot)), ";")
    fields = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("source_fields"))))
    return rows.select("item", "platform_name", "external_id", "version_no", "description", dims.alias("dims"), seen.alias("evidence"), "entity", F.col("snapshot.content_hash").alias("content_hash"), fields.alias("source_fields"))


@query(f"select product_type as value, count(*) as n from {M.ITEMS} join {CURRENT} using (item) where status = 'active' group by 1")
def g10_type_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.type_facet(M.items(spark, sf_dir), M.versions(spark, sf_dir))


@query(f"select p.platform, {SHOWN} as value, count(*) as n from {M.ITEMS} i join {M.PLATFORMS} p using (platform) where status = 'active' group by all")
def g11_platform_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.platform_facet(M.items(spark, sf_dir), M.platforms(spark, sf_dir))


@query(f"select type, value, count(distinct item) as n from {M.DIMS} join {M.ITEMS} using (item) where status = 'active' and type in ('industry', 'platform_province', 'coverage_region') group by all")
def g12_dimension_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.dimension_facet(M.items(spark, sf_dir), M.dims(spark, sf_dir))


@query(f"select provider, count(*) as n from {M.ITEMS} join {CURRENT} using (item) where status = 'active' and provider <> '' group by 1 order by n desc, provider limit 100")
def g13_top_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.provider_facet(M.items(spark, sf_dir), M.versions(spark, sf_dir))


MATRIX = f"""(select c.platform, c.collection, expected, c.status, enabled, coalesce(discovered, 0) as discovered, coalesce(active, 0) as active, coalesce(detail, 0) as detail_success, coalesce(versions, 0)::bigint as versions, coalesce(errors, 0) as errors from {M.COLLECTIONS} c
 left join (select platform, collection, count(*) as discovered, count(*) filter (status = 'active') as active, count(n) as detail, sum(n) as versions from {M.ITEMS} left join (select item, count(*) as n from {M.VERSIONS} group by 1) using (item) group by all) f using (platform, collection)
 left join (select platform, collection, count(*) as errors from {M.ERRORS} group by all) e using (platform, collection))"""
CONCLUSIONS = f"(select m.platform, case when bool_or(m.enabled) and bool_and(not m.enabled or status = 'complete') then 'COMPLETE' when bool_or(m.enabled and status = 'blocked') then 'BLOCKED' when bool_or(m.enabled and status = 'offline') then 'OFFLINE' else upper(max(onboarding)) end as conclusion from {MATRIX} m join {M.PLATFORMS} p on p.platform = m.platform group by 1)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coverage_matrix(M.platforms(spark, sf_dir), M.collections(spark, sf_dir), M.items(spark, sf_dir), M.versions(spark, sf_dir), M.errors(spark, sf_dir))


@query(f"select *, round(active / nullif(expected, 0), 6) as reconciliation, round(detail_success / nullif(discovered, 0), 6) as detail_rate from {MATRIX}")
def g16_coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).drop("platform_name", "onboarding")
    return rows.withColumns({"reconciliation": F.round("reconciliation", 6), "detail_rate": F.round("detail_rate", 6)})


@query(f"select * from {CONCLUSIONS}")
def g17_platform_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.conclusions(matrix(spark, sf_dir))


ACCEPTED = f"(select coalesce(conclusion, upper(onboarding)) as conclusion from {M.PLATFORMS} left join {CONCLUSIONS} using (platform))"


@query(f"""with c as (select conclusion, count(*) as n from {ACCEPTED} group by 1) select sum(n)::bigint as sources, sum(n) = 25 as all_registered, sum(n) = 25 and bool_and(conclusion in ('COMPLETE', 'BLOCKED', 'OFFLINE', 'OUT_OF_SCOPE')) as all_audited,
 '{{' || string_agg('"' || conclusion || '":' || n, ',' order by conclusion) || '}}' as counts from c""")
def g14_acceptance_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.acceptance(K.conclusions(matrix(spark, sf_dir)), M.platforms(spark, sf_dir), 25)
    return out.withColumn("counts", F.to_json("counts"))


@query(f"""with s as (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id order by ts, event_id) as nth from events)
select (select count(*) from {M.PLATFORMS}) as platforms, (select count(*) from {M.PLATFORMS} where enabled) as active_platforms, (select count(*) from {M.ITEMS} where status = 'active') as active_items, (select count(*) from {M.ERRORS} where id % 3 <> 0) as open_alerts,
 count(*) filter (nth = 1 and ts >= timestamp '2024-01-29 23:00:00') as items_added_24h, count(*) filter (nth > 1 and event_type <> before and ts >= timestamp '2024-01-29 23:00:00') as items_updated_24h,
 (select arg_max(run, started_at) from {M.RUNS}) as latest_run, (select max(started_at) from {M.RUNS}) as latest_start from s""")
def g15_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .versions import states

    changes = states(spark, sf_dir).select("event", F.col("ts").alias("created_at"))
    alerts = M.errors(spark, sf_dir).select(F.when(F.col("id") % 3 != 0, "open").otherwise("acknowledged").alias("status"))
    return K.dashboard(M.platforms(spark, sf_dir), M.items(spark, sf_dir), alerts, changes, M.runs(spark, sf_dir), F.lit("2024-01-30 23:00:00").cast("timestamp"))


@query("select o_orderkey, o_orderdate, o_orderstatus, (select count(*) from orders) as total from orders order by o_orderdate desc, o_orderkey desc limit 50 offset 100")
def g18_run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_total(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 50)


@query(f"select 'platform' as part, platform, null::bigint as id, started_at as \"at\", pages from {M.RUNS} where run = date '2024-01-12' union all select * from (select 'error', platform, id, \"at\", null from {M.ERRORS} where run = date '2024-01-12' order by \"at\" desc, id desc limit 500)")
def g19_run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, failed = K.run_detail(M.runs(spark, sf_dir), M.errors(spark, sf_dir), F.lit("2024-01-12").cast("date"))
    rows = own.select(F.lit("platform").alias("part"), "platform", F.lit(None).cast("long").alias("id"), F.col("started_at").alias("at"), "pages")
    return rows.unionByName(failed.select(F.lit("error").alias("part"), "platform", "id", "at", F.lit(None).cast("long").alias("pages")))


@query(f"""select * from (select 'review' as list, doc_id as id, 'pending' as status from labels where quality <> 1 order by doc_id desc limit 1000) union all select * from (select 'alert', id, 'open' from {M.ERRORS} where id % 3 <> 0 order by "at" desc, id desc limit 1000)
 union all select 'mapping', row_number() over (order by p_type, p_brand), 'enabled' from (select distinct p_type, p_brand from part)""")
def g21_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending reviews, open alerts, and the mappings in the order of their two keys."""
    from pyspark.sql import Window

    reviews = read(spark, sf_dir, "labels").where("quality <> 1").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("created_at"), F.lit("pending").alias("status"))
    alerts = M.errors(spark, sf_dir).select("id", F.col("at").alias("created_at"), F.when(F.col("id") % 3 != 0, "open").otherwise("acknowledged").alias("status"))
    rules = read(spark, sf_dir, "part").select("p_type", "p_brand").distinct()  # a rule table
    rules = rules.select(F.lit("mapping").alias("list"), F.row_number().over(Window.orderBy("p_type", "p_brand")).cast("long").alias("id"), F.lit("enabled").alias("status"))
    lists = [K.newest(df, s).select(F.lit(n).alias("list"), "id", "status") for n, df, s in (("review", reviews, "pending"), ("alert", alerts, "open"))]
    return lists[0].unionByName(lists[1]).unionByName(rules)


TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")
LEAST = {"nation": 25, "region": 6, "part": 1}


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n, {LEAST.get(t, 0)}::bigint as needed, count(*) >= {LEAST.get(t, 0)} as healthy from {t}" for t in TABLES))
def g22_health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts against required ones; one requirement fails."""
    return K.health({t: read(spark, sf_dir, t) for t in TABLES}, LEAST)

"""Queries on registry, coverage and status: supplier, part, lineitem and orders stand in for platforms and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue as K
from ..operators import coverage as C
from ..sources import registry as R
from ..streaming.observations import folder
from . import catalog
from . import model as M
from .registry import query, read

SUP = "(select s_suppkey, s_name, s_nationkey, s_acctbal > 0 as enabled, case when s_suppkey % 7 = 0 then 'missing_url' when s_suppkey % 11 = 0 then 'site_expired' else 'ok' end as url_status from supplier)"
STATUS = "case when s_suppkey % 13 = 0 then 'out_of_scope' when not enabled or url_status = 'missing_url' then 'blocked' when url_status = 'site_expired' then 'offline' else 'pending_audit' end"
COLL = "(with r as (select distinct l_partkey from lineitem where l_returnflag = 'R' and l_quantity >= 25 + l_partkey % 25) select p_partkey % 25 as platform, p_type, count(*) as expected, count(l_partkey) as observed from part left join r on l_partkey = p_partkey group by all)"


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("s_suppkey") % 7 == 0, "missing_url").when(F.col("s_suppkey") % 11 == 0, "site_expired").otherwise("ok")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", (F.col("s_acctbal") > 0).alias("enabled"), bad.alias("url_status"))
    return rows.withColumn("status", C.onboarding(F.col("enabled"), F.col("url_status"), F.col("s_suppkey") % 13 == 0, F.lit("unknown")))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and observed items of each collection; facts are reduced to part keys before the join."""
    hit = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 25 + l_partkey % 25").select("l_partkey").distinct()
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = parts.join(hit.hint("merge"), parts.p_partkey == hit.l_partkey, "left")
    return rows.groupBy((F.col("p_partkey") % 25).alias("platform"), "p_type").agg(F.count("*").alias("expected"), F.count("l_partkey").alias("observed"))


@query(f"select s_suppkey, {STATUS} as status from {SUP}")
def a03_onboarding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).select("s_suppkey", "status")


RANKED = "case o_orderstatus when 'F' then 'complete' when 'O' then 'partial' else 'unknown' end"


@query(f"select case when status in ('blocked', 'offline') then 'stopped' else status end as bucket, count(*) as n from (select {STATUS} as status from {SUP}) group by 1")
def g23_onboarding_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("status").isin("blocked", "offline"), "stopped").otherwise(F.col("status"))
    return suppliers(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


FLAGS = ("Yes", "off", "", "1", "TRUE", "n")
A01 = f"""with n as (select n_nationkey as id, r_name as province, n_name as name, n_nationkey % 4 <> 0 as has_url from nation join region on n_regionkey = r_regionkey)
select id::bigint as id, name, province, case id % 6 when 2 then has_url when 0 then true when 3 then true when 4 then true else false end as enabled, fmt from n, (select unnest(['csv', 'json']) as fmt)"""


def written_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as rows of a registry, as text."""
    k = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    word = F.get(F.array(*map(F.lit, FLAGS)), k % 6)
    return rows.select(k.cast("string").alias("id"), F.col("r_name").alias("province"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("name"), F.when(k % 4 != 0, "https://h.org/").otherwise("").alias("canonical_url"), word.alias("enabled"))


@query(A01)
def a01_registry_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations written as CSV with a byte order mark and as JSON, and read back."""
    rows, at = written_registry(spark, sf_dir), folder(spark)
    rows.toDF("\ufeffid", *rows.columns[1:]).coalesce(1).write.csv(f"{at}/csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    each = rows.groupBy().agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("platforms"))).alias("value"))  # one small file
    each.coalesce(1).write.text(f"{at}/json")
    out = [R.registry(spark, f"{at}/{fmt}", fmt).select("id", "name", "province", "enabled", F.lit(fmt).alias("fmt")) for fmt in ("csv", "json")]
    return out[0].unionByName(out[1])


A02 = """with o as (select s_suppkey + 3 as id, s_name as name, round(s_acctbal) as bal from supplier), n as (select s_suppkey as id, '  new ' || s_suppkey as name, case when s_suppkey % 4 <> 0 then round(s_acctbal) + 1 end as bal from supplier where s_suppkey % 5 <> 0)
select id, case when n.id is null then o.name else trim(n.name) end as name, case when n.id is null then o.bal else coalesce(n.bal, o.bal) end as bal, case when o.id is null then 'inserted' when n.id is null then 'kept' else 'updated' end as action from o full join n using (id)"""


@query(A02)
def a02_registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a registry, and a seed that gives a new name to most and a balance to some."""
    k = F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier")
    old = rows.select((k + 3).alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal").alias("bal"))
    new = rows.where(k % 5 != 0).select(k.alias("id"), F.concat(F.lit("  new "), k).alias("name"), F.when(k % 4 != 0, F.round("s_acctbal") + 1).alias("bal"))
    return C.registry_upsert(old, new, ["name", "bal"])


CODES = ("products", "components", "scenarios", "demands", "providers")
A05 = f"""with n as (select n_nationkey::bigint as platform, unnest({list(CODES)!r}) as code from nation),
old as (select *, case when platform % 5 = 0 then 'complete' when platform % 5 = 1 then 'out_of_scope' else 'unknown' end as coverage from n where platform % 2 = 0)
select n.platform, n.code, case when n.code = 'products' and n.platform % 3 = 0 then 'second' else 'name ' || n.code end as name, case when old.coverage = 'complete' then 'complete' when n.code = 'products' and n.platform % 3 = 0 then 'partial' else 'unknown' end as coverage from n left join old using (platform, code)"""


@query(A05)
def a05_collection_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five placeholder collections for each nation, some of which are known, and a second row for some."""
    p = F.col("platform")
    base = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("platform"), F.explode(F.array(*map(F.lit, CODES))).alias("code"))
    old = base.where(p % 2 == 0).select("platform", "code", F.lit("old").alias("name"), F.lit("mixed").alias("kind"), F.when(p % 5 == 0, "complete").when(p % 5 == 1, "out_of_scope").otherwise("unknown").alias("coverage"))
    rows = base.select("platform", "code", F.concat(F.lit("name "), "code").alias("name"), F.lit("mixed").alias("kind"), F.lit("unknown").alias("coverage"), F.lit(0).alias("at"))
    more = base.where((p % 3 == 0) & (F.col("code") == "products")).select("platform", "code", F.lit("second").alias("name"), F.lit("mixed").alias("kind"), F.lit("partial").alias("coverage"), F.lit(1).alias("at"))
    return C.upsert_collections(old, rows.unionByName(more)).select("platform", "code", "name", "coverage")


@query(f"select conclusion, count(*) as n from {catalog.ACCEPTED} group by 1")
def a14_acceptance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, written as JSON to the shared folder and read back."""
    at = folder(spark)
    K.acceptance(K.conclusions(catalog.matrix(spark, sf_dir)), M.platforms(spark, sf_dir), 25).coalesce(1).write.json(f"{at}/report")
    report = spark.read.schema("sources long, all_registered boolean, all_audited boolean, counts map<string,long>").json(f"{at}/report")
    return report.select(F.explode("counts").alias("conclusion", "n"))


RANKED = "case o_orderstatus when 'F' then 'complete' when 'O' then 'partial' else 'unknown' end"
A15 = f"""with m as (select o_custkey, o_orderpriority, min(o_orderkey) as kept_id, arg_max({RANKED}, case o_orderstatus when 'F' then 4 when 'O' then 3 else 1 end) as status, max(o_totalprice) as expected, max(o_orderdate) as last_run, count(*) as merged from orders group by all),
k as (select o_orderkey, min(o_orderkey) over (partition by o_custkey, o_orderpriority) as kept_id from orders), c as (select kept_id, count(*) as children from lineitem join k on l_orderkey = o_orderkey group by 1)
select m.*, coalesce(children, 0) as children from m left join c using (kept_id) where merged > 1"""


@query(A15)
def a15_collection_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as duplicates of (customer, priority); their lines are pointed to the order that stays."""
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial").otherwise("unknown")
    key = ["o_custkey", "o_orderpriority"]
    rows = read(spark, sf_dir, "orders").select(*key, "o_orderkey", status.alias("status"), F.col("o_totalprice").alias("expected"), F.col("o_orderdate").alias("last_run"))
    kept = C.merged_collections(rows, key, "o_orderkey", "status", ["expected", "last_run"])
    lines = C.repointed(read(spark, sf_dir, "lineitem").select("l_orderkey"), rows.withColumnRenamed("o_orderkey", "id"), key, "id", "l_orderkey")
    return kept.join(lines.groupBy(F.col("l_orderkey").alias("kept_id")).agg(F.count("*").alias("children")), "kept_id", "left").fillna(0, ["children"])


def before_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Collections of parts, and what a run counts in them; platforms of even number declare their totals."""
    rows = collections(spark, sf_dir)
    p = F.col("platform")
    old = rows.select("platform", F.col("p_type").alias("collection"), F.when(p % 3 == 0, F.col("expected") + 1).alias("expected"), F.when(p % 4 == 0, "complete").otherwise("unknown").alias("status"), F.lit(None).cast("timestamp").alias("last_complete"))
    counts = rows.select("platform", F.col("p_type").alias("collection"), "observed", F.when(p % 2 == 0, F.col("expected")).alias("declared"), F.lit("2024-01-02").cast("timestamp").alias("ended"))
    return old, counts


def after_run(spark: SparkSession, sf_dir: str, **run) -> DataFrame:
    return C.completeness(*before_run(spark, sf_dir), **run)


RUNS = "(values ('full', true, true, false), ('failed', true, false, false), ('pages', false, true, false), ('api', false, true, true)) r(run, is_full, well, api)"
F01 = f"""with c as (select run, is_full, well, api, platform, p_type as collection, observed, case when platform % 2 = 0 then expected when not is_full and platform % 3 = 0 then expected + 1 end as known, case when platform % 4 = 0 then 'complete' else 'unknown' end as old from {COLL}, {RUNS}),
e as (select *, coalesce(known, case when is_full and well and observed > 0 then observed end) as expected from c), w as (select *, expected is not null and observed >= expected and well as reached from e)
select run, platform, collection, observed, expected, known is null and expected is not null as inferred, case when api then old when reached then 'complete' else 'partial' end as status, case when api then old = 'complete' else reached end as whole from w"""


@query(F01)
def f01_collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run, one with an error, an incremental one, and one of an API, all in one plan."""
    runs = [F.struct(F.lit(n).alias("run"), F.lit(full).alias("full"), F.lit(errors).alias("errors"), F.lit(api).alias("api")) for n, full, errors, api in (("full", True, 0, False), ("failed", True, 1, False), ("pages", False, 0, False), ("api", False, 0, True))]
    old, counts = before_run(spark, sf_dir)
    old = old.select("*", F.explode(F.array(*runs)).alias("r")).select("*", "r.*").drop("r")
    out = C.completeness(old, counts, full=F.col("full"), errors=F.col("errors"), api=F.col("api"), kept=("run",))
    return out.select("run", "platform", "collection", "observed", "expected", "inferred", "status", "whole")


@query(f"select platform, p_type as collection, case when platform % 2 = 0 then expected when observed > 0 then observed end as expected, platform % 2 <> 0 and observed > 0 as inferred from {COLL}")
def f02_expected_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full run expects: the declared total, else what it observed; old expectations are forgotten."""
    return after_run(spark, sf_dir, full=True).select("platform", "collection", "expected", "inferred")


WHOLE = f"(select platform, bool_and(case when platform % 2 = 0 then observed >= expected else observed > 0 end) as whole, sum(observed)::bigint as observed, platform % 9 = 4 as cancelled, platform % 7 = 3 as blocked, case when platform % 5 = 2 or platform % 7 = 3 and platform % 2 = 1 then 0 else 10 + platform end as fetched, case when platform % 4 = 1 then 2 else 0 end as errors, platform % 11 = 6 as hit_limit from {COLL} group by platform)"


def platform_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platforms after a full run, with what happened in it."""
    p = F.col("platform")
    rows = after_run(spark, sf_dir, full=True).groupBy("platform").agg(F.bool_and("whole").alias("whole"), F.sum("observed").alias("observed"))
    fetched = F.when((p % 5 == 2) | (p % 7 == 3) & (p % 2 == 1), F.lit(0)).otherwise(p + 10)
    return rows.select("*", (p % 9 == 4).alias("cancelled"), (p % 7 == 3).alias("blocked"), fetched.alias("fetched"), F.when(p % 4 == 1, 2).otherwise(0).alias("errors"), (p % 11 == 6).alias("hit_limit"))


STATUS_SQL = "case when cancelled then 'cancelled' when blocked and fetched = 0 then 'blocked' when fetched = 0 then 'failed' when errors > 0 or hit_limit then 'partial' else 'success' end"


@query(f"select platform, {STATUS_SQL} as status, case when whole then 'complete' when blocked and fetched = 0 then 'blocked' else 'partial' end as coverage from {WHOLE}")
def f03_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = platform_runs(spark, sf_dir)
    return rows.select("platform", C.run_status(c("cancelled"), c("blocked"), c("fetched"), c("errors"), c("hit_limit")).alias("status"), C.run_coverage(c("whole"), c("blocked"), c("fetched")).alias("coverage"))


@query(f"""select platform, mode, case when platform % 13 = 0 then 'out_of_scope' when observed > 0 and fetched > 0 then 'active' when mode = 'full api' then case when {STATUS_SQL} = 'failed' and fetched = 0 then 'offline' else 'blocked' end
 when mode = 'full' and blocked then 'blocked' when mode = 'full' and fetched = 0 then 'offline' else 'pending_audit' end as status from {WHOLE}, (select unnest(['full', 'full api', 'incremental']) as mode)""")
def f04_status_from_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After full runs of pages and of an API, and after an incremental one."""
    c, rows = F.col, platform_runs(spark, sf_dir)
    rows = rows.withColumn("mode", F.explode(F.array(F.lit("full"), F.lit("full api"), F.lit("incremental"))))
    failed = C.run_status(c("cancelled"), c("blocked"), c("fetched"), c("errors"), c("hit_limit")) == "failed"
    status = C.status_from_evidence(c("platform") % 13 == 0, c("observed"), c("fetched"), c("mode").startswith("full"), c("blocked"), failed, c("mode") == "full api", F.lit("pending_audit"))
    return rows.select("platform", "mode", status.alias("status"))


F05 = f"""with c as (select platform, p_type, observed, case when platform % 2 = 0 then expected when observed > 0 then observed end as expected, platform % 2 <> 0 and observed > 0 as inferred from {COLL}),
f as (select platform, p_type || ': ' || observed || '/' || coalesce(expected::varchar, '?') as note, row_number() over (partition by platform order by p_type) as nth from c where expected is null or observed < expected),
n as (select platform, string_agg(note, '；' order by nth) as note from f where nth <= 3 group by platform)
select platform, note, '{{"coverage_complete":' || bool_and(expected is not null and observed >= expected) || ',"collections_total":' || count(*) || ',"collections_with_expected_count":' || count(expected) || ',"inferred_collection_counts":[' || coalesce(string_agg(case when inferred then observed::varchar end, ',' order by observed), '')
 || ']' || coalesce(',"expected_count":' || sum(expected), '') || ',"observed_count":' || sum(observed) || '}}' as document from c left join n using (platform) group by all"""


@query(F05)
def f05_completeness_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of each platform, and a note of its first three failures (how many is the feature)."""
    rows = after_run(spark, sf_dir, full=True)
    text = F.concat("collection", F.lit(": "), "observed", F.lit("/"), F.coalesce(F.col("expected").cast("string"), F.lit("?")))
    notes = C.failure_notes(rows.where("not whole").select("platform", F.col("collection").alias("at"), text.alias("text")), 3)
    return C.completeness_document(rows).join(notes, "platform", "left")


A04 = """with n as (select n_nationkey::bigint as platform from nation), c as (select platform, unnest(['public-catalog-auto', 'products']) as code from n)
select platform, code, case when code = 'products' and platform % 3 = 0 then 'ruled' else 'old' end as name, not (platform % 3 = 0 and code = 'public-catalog-auto') as enabled, case when platform % 3 = 0 and code = 'public-catalog-auto' then 'out_of_scope' else 'unknown' end as coverage, case when platform % 3 = 0 then 'site-v1' else 'generic' end as adapter from c
union all select platform, 'extra', 'more', false, 'unknown', 'site-v1' from n where platform % 3 = 0"""


@query(A04)
def a04_site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for every third nation, written as one JSON file and read back, on two collections of each."""
    p, at = F.col("platform"), folder(spark)
    platforms = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("platform"), F.lit("generic").alias("adapter"), F.lit("auto").alias("render_mode"))
    one = lambda code, name, enabled: F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit("product").alias("object_kind"), F.lit("https://h.org").alias("entry_url"), F.lit(enabled).alias("enabled"))
    rule = F.struct(F.lit("site-v1").alias("adapter"), F.array(one("products", "ruled", True), one("extra", "more", False)).alias("collections"))
    every = platforms.where(p % 3 == 0).select(p.cast("string").alias("k"), rule.alias("v")).unionByName(platforms.limit(1).select(F.lit("999").alias("k"), rule.alias("v")))
    every.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).coalesce(1).write.text(f"{at}/rules")  # a rule table
    held = platforms.select("platform", F.explode(F.array(F.lit("public-catalog-auto"), F.lit("products"))).alias("code")).select("*", F.lit("old").alias("name"), F.lit("mixed").alias("kind"), F.lit("").alias("entry_url"), F.lit(True).alias("enabled"), F.lit("unknown").alias("coverage"))
    ruled, out = R.apply_site_rules(platforms, held, R.site_rules(spark, f"{at}/rules"))
    return out.join(ruled.select("platform", "adapter").hint("merge"), "platform").select("platform", "code", "name", "enabled", "coverage", "adapter")

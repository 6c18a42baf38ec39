"""Queries over documents, labels, conversations and scalar functions on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract as X
from ..operators import logs as L
from ..operators import records as RC
from ..operators import similar as S
from ..operators import versioning as V
from ..sources import registry as R
from ..sources import snapshots as SN
from ..sources.tables import folder
from . import records as RP
from .registry import query, read

NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(rf"select doc_id, md5({NORM}) as norm_md5 from documents")
def b06_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("norm_md5"))


@query("select doc_id, sha256(text) as content_hash from documents")
def b07_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(rf"select doc_id, sha256({NORM}) as semantic_hash from documents")
def b08_semantic_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(T.normalize_text(F.col("text"))).alias("semantic_hash"))


@query("""select p_partkey, '{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}' as canonical_json from part""")
def b09_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct("p_brand", "p_name", "p_size"), {"ignoreNullFields": "false"}).alias("canonical_json"))


@query("select o_orderkey, o_orderdate::date::timestamp as parsed from orders")
def b10_parse_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", T.parse_datetime(F.date_format("o_orderdate", "yyyy/M/d HH:mm")).alias("parsed"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as start, strftime(o_orderdate + interval 30 day, '%Y-%m') as end from orders")
def b11_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = T.period(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" to "), F.date_format(F.expr("o_orderdate + interval 30 days"), "yyyy-MM")))
    return read(spark, sf_dir, "orders").select("o_orderkey", span.start.alias("start"), span.end.alias("end"))


@query(rf"select doc_id, case when length({NORM}) > 300 then left({NORM}, 299) || '…' else {NORM} end as snippet from documents")
def b12_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.snippet(T.normalize_text(F.col("text")), 300).alias("snippet"))


@query("select p_partkey, regexp_replace(lower(p_name || p_brand), '[^0-9a-z一-鿿]', '', 'g') as folded from part")
def b13_key_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.key_fold(F.concat("p_name", "p_brand")).alias("folded"))


@query(r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_.+-])([A-Za-z0-9_.+-]{1,2})[A-Za-z0-9_.+-]{0,62}@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1\2***@\3', 'g'),
 '(^|[^0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})([^0-9]|$)', '\1\2****\3\4', 'g'), '(^|[^0-9])([0-9]{6})[0-9]{8}([0-9]{3}[0-9Xx])([^0-9]|$)', '\1\2********\3\4', 'g')) as redacted_md5 from documents""")
def b14_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"))


@query("select event_id, coalesce(try_cast(props as json)->>'$.k', 'none') as k, coalesce(try_cast(props as json)->>'$.missing', 'none') as missing from events")
def b25_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    get = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit("none"))
    return read(spark, sf_dir, "events").select("event_id", get("$.k").alias("k"), get("$.missing").alias("missing"))


@query("select event_id, try_cast(props::json->>'$.k' as bigint) as k from events")
def a08_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as iso from events")
def b26_iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"))


@query("select n_nationkey, coalesce(nullif(case when n_nationkey % 3 = 0 then '' else n_name end, ''), 'unknown') as display_name from nation")
def b27_display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.col("n_name"))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")).alias("display_name"))


@query("select event_id, least(power(2, event_id % 7), 24)::bigint as hours, ts + to_hours(least(power(2, event_id % 7), 24)::int) as retry_at from events where event_type = 'error'")
def b21_back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.least(F.pow(F.lit(2), F.col("event_id") % 7), F.lit(24)).cast("int")
    return read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", hours.cast("long").alias("hours"), (F.col("ts") + F.make_dt_interval(F.lit(0), hours)).alias("retry_at"))


@query("select p_partkey, unnest(['product_type', 'brand']) as type, unnest([p_type, p_brand]) as value from part")
def d07_dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = F.array(F.struct(F.lit("product_type").alias("type"), F.col("p_type").alias("value")), F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("value")))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.filter(dims, lambda d: F.trim(d.value) != "")).alias("d"))
    return rows.select("p_partkey", "d.type", "d.value")


A10 = f"""with d as (select doc_id, 'u' || doc_id % 97 as url, timestamp '2024-01-01' + to_minutes(doc_id::int) as seen, sha256(text) as h, sha256({NORM}) as m, doc_id % 5 as platform, text from documents where text is not null),
old as (select url, arg_max(h, seen) as h, arg_max(m, seen) as m from d where doc_id % 10 = 0 group by 1), stored as (select distinct url, h from d where doc_id % 10 = 0),
f as (select d.*, coalesce(lag(d.h) over (partition by d.url order by seen), old.h) as h0, coalesce(lag(d.m) over (partition by d.url order by seen), old.m) as m0 from d left join old using (url) where doc_id % 10 <> 0),
k as (select *, row_number() over (partition by url, h order by seen) as nth from f)
select url, h as content_hash, not (h is not distinct from h0 and m is not distinct from m0) as changed, seen + to_days(30) as expires_at, 'platform/' || platform || '/' || strftime(seen, '%Y/%m/%d') || '/run-1/' || left(sha256(url), 16) || '-' || left(h, 16) as object_key
from k where nth = 1 and (url, h) not in (select url, h from stored)"""


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses of 97 URLs, a minute apart."""
    k, text = F.col("doc_id"), F.col("text")
    rows = read(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.concat(F.lit("u"), k % 97).alias("url"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=k.cast("int"))).alias("at"), T.content_hash(text).alias("content_hash"), T.content_hash(T.normalize_text(text)).alias("semantic_hash"), (k % 5).alias("platform"), F.lit("run-1").alias("run"), F.encode("text", "UTF-8").alias("body"))


@query(A10)
def a10_snapshot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth response is stored already."""
    rows = fetched(spark, sf_dir).drop("body")
    old = rows.where("doc_id % 10 = 0")
    states = old.groupBy("url").agg(F.max_by("content_hash", "at").alias("content_hash"), F.max_by("semantic_hash", "at").alias("semantic_hash"))
    out = V.new_snapshots(rows.where("doc_id % 10 <> 0").drop("doc_id"), old.select("url", "content_hash").distinct(), states, 30)
    return out.select("url", "content_hash", "changed", "expires_at", "object_key")


STORED = "(select 'u' || doc_id % 97 as url, sha256(text) as content_hash, min(timestamp '2024-01-01' + to_minutes(doc_id::int)) filter (doc_id % 2 = 0) as even, min(timestamp '2024-01-01' + to_minutes(doc_id::int)) as any_at, min(md5(text)) as body_md5 from documents where text is not null group by 1, 2)"


def stored(spark: SparkSession, sf_dir: str) -> str:
    """A store filled with the documents in two batches, one of which comes twice."""
    at = folder(spark)
    SN.create(spark, at)
    rows = fetched(spark, sf_dir)
    for batch, rest in (("a", 0), ("b", 1), ("a", 0)):
        SN.append(rows.where(F.col("doc_id") % 2 == rest).drop("doc_id"), at, batch)
    return at


@query(f"select url, content_hash, coalesce(even, any_at) as fetched_at, body_md5 from {STORED}")
def a10_snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects of the store with their bodies, read back."""
    at = stored(spark, sf_dir)
    return SN.bodies(spark, at, SN.current(spark, at)).select("url", "content_hash", "fetched_at", F.md5("body").alias("body_md5"))


@query(f"with s as (select *, row_number() over (order by coalesce(even, any_at), url, content_hash) as nth from {STORED} where coalesce(even, any_at) <= timestamp '2024-01-01 12:00:00') select s.url, s.content_hash, case when nth <= 400 then 'archive' else 'online' end as tier, s.body_md5 from s union all select url, content_hash, 'online', body_md5 from {STORED} where coalesce(even, any_at) > timestamp '2024-01-01 12:00:00'")
def a13_archive_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the 400 objects that expired first have moved, bodies from both tiers."""
    at = stored(spark, sf_dir)
    for _ in range(2):  # the second time changes nothing
        SN.archive(spark, at, "move", F.lit("2024-01-31 12:00:00").cast("timestamp"), 400)
    return SN.bodies(spark, at, SN.current(spark, at)).select("url", "content_hash", "tier", F.md5("body").alias("body_md5"))


@query("select doc_id as id, case when doc_id % 4 = 0 then 'archive' else 'online' end as tier, sha256(text) as content_hash from documents where doc_id % 3 <> 0 and exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def a12_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents read back from two tiers that were written by platform and day; some are in both."""
    at, k = folder(spark), F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(k.alias("id"), "text", (k % 5).alias("platform_id"), (k % 7).alias("day"))
    for tier, own in (("online", "id % 4 <> 0 and id % 3 <> 0"), ("archive", "id % 2 = 0 and id % 3 <> 0")):
        rows.where(own).write.partitionBy("platform_id", "day").parquet(f"{at}/{tier}")
    tiers = [spark.read.schema("id long, text string, platform_id long, day long").parquet(f"{at}/{tier}") for tier in ("online", "archive")]
    out = R.snapshots(*tiers, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return out.select("id", "tier", T.content_hash(F.col("text")).alias("content_hash"))


A13 = """with s as (select doc_id as id, timestamp '2024-01-01' + to_hours((doc_id % 500)::int) as e, doc_id % 5 = 0 as done, doc_id % 7 = 0 as bad from documents),
d as (select * from s where not done and e <= timestamp '2024-01-15' order by e, id limit 5000) select id, case when bad then 'failed' else 'archived' end as outcome, case when bad then 'online' else 'archive' end as tier, case when bad then 'snapshot_archive_failure' end as alert from d"""


@query(A13)
def a13_expiry_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,000 snapshots that expired first (a batch's size is the feature). Every seventh body was damaged after its hash was stored."""
    k, text = F.col("doc_id"), F.col("text")
    rows = read(spark, sf_dir, "documents").select(
        k.alias("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 500).cast("int"))).alias("expires_at"), F.when(k % 5 == 0, "archive").otherwise("online").alias("tier"),
        T.content_hash(F.coalesce(text, F.lit(""))).alias("stored_hash"), T.content_hash(F.when(k % 7 == 0, F.concat(F.coalesce(text, F.lit("")), F.lit("!"))).otherwise(F.coalesce(text, F.lit("")))).alias("body_hash"),
    )
    return V.archived(rows, F.lit("2024-01-15").cast("timestamp"), 5000).select("id", "outcome", "tier", "alert")


@query("""select 'crawl_error' as log, event_id as id, left('failed: ' || repeat(props, 1000), 8000) as message, event_id % 2 = 0 as flag from events where event_type = 'error' union all select 'change_event', event_id, event_type, null from events where event_type in ('signup', 'purchase')
 union all select 'alert', event_id, 'error', true from events where event_type = 'error' and event_id % 10 = 0""")
def a16_observation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three logs, appended to the shared folder in two batches and read back."""
    at, k = folder(spark), F.col("event_id")
    rows = read(spark, sf_dir, "events")
    for half in (0, 1):
        own = rows.where(k % 2 == half)
        failed = own.where("event_type = 'error'")
        L.append(failed.select(k.alias("id"), F.concat(F.lit("failed: "), F.repeat("props", F.lit(1000))).alias("message"), (k % 2 == 0).alias("flag")), at, "crawl_error")
        L.append(own.where("event_type in ('signup', 'purchase')").select(k.alias("id"), F.col("event_type").alias("message"), F.lit(None).cast("boolean").alias("flag")), at, "change_event")
        L.append(failed.where(k % 10 == 0).select(k.alias("id"), F.lit("error").alias("message"), F.lit(True).alias("flag")), at, "alert")
    return L.logs(spark, at, "id long, message string, flag boolean")


@query("with t as (select conv_id, turn, string_split(text, ' ') as parts from conversations where text is not null), e as (select conv_id, turn, unnest(parts) as body, unnest(range(len(parts))) as place from t) select conv_id, turn, place::int as place, 1 as depth, md5(body) as body_md5 from e where place % 3 <> 2 and body <> ''")
def c18_sub_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a turn as its captured sub-responses; every third has failed."""
    parts = F.transform(F.split("text", " "), lambda w, k: F.struct(F.concat(F.lit("u"), k).alias("url"), F.when(k % 3 == 2, 500).otherwise(200).alias("status"), w.alias("body")))
    rows = read(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.lit(0).alias("depth"), parts.alias("captured"))
    return X.sub_responses(rows, ["conv_id", "turn"]).select("conv_id", "turn", "place", "depth", F.md5("body").alias("body_md5"))


REVIEWS = "(select doc_id, quality, toxic, case when doc_id % 5 <> 0 then case when quality = 1 then 0.9 else 0.5 end end as type_sure, case when toxic = 1 then 0.6 else 0.85 end as sure from labels)"


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as items; every fifth has no confidence of its type."""
    sure = F.when(F.col("doc_id") % 5 != 0, F.when(F.col("quality") == 1, 0.9).otherwise(0.5))
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"), F.concat(F.lit("type"), F.col("doc_id") % 4).alias("product_type"), sure.alias("type_confidence"), F.when(F.col("toxic") == 1, 0.6).otherwise(0.85).alias("confidence"))


@query(f"select doc_id as item, 'product_type' as field, 'type' || doc_id % 4 as proposed, coalesce(type_sure, sure)::double as confidence, mode as status, case when mode = 'accepted' then 'automatic_classifier' else '' end as reviewer from {REVIEWS}, (select unnest(['accepted', 'pending']) as mode) where coalesce(type_sure, sure) < 0.8")
def d14_review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With and without automatic acceptance."""
    items = labelled_items(spark, sf_dir)
    return V.review_rows(items, automatic=True).unionByName(V.review_rows(items))


@query(f"select doc_id as item, case when doc_id % 3 = 0 then 'rejected' else 'accepted' end as status, case when doc_id % 3 = 0 then 'editor' else 'bulk' end as reviewer, doc_id % 3 <> 0 as resolved from {REVIEWS} where coalesce(type_sure, sure) < 0.8")
def d15_bulk_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third review is decided already."""
    done = F.col("item") % 3 == 0
    reviews = V.review_rows(labelled_items(spark, sf_dir)).withColumns({"status": F.when(done, "rejected").otherwise(F.col("status")), "reviewer": F.when(done, "editor").otherwise(F.col("reviewer"))})
    return V.resolve_pending(reviews, "bulk").select("item", "status", "reviewer", "resolved")


D16 = """with i as (select doc_id as item, 'type' || doc_id % 4 as t from labels), n as (select doc_id as item, case when doc_id % 4 = 0 then 'alpha' else 'new' || doc_id % 3 end as v from labels where toxic = 0 and doc_id % 2 = 0 group by 1, 2)
select item, coalesce(v, t) as product_type, type, case when type = 'product_type' then coalesce(v, t) else 'other' end as value, case when v is not null and type = 'product_type' then 1.0 else 0.5 end::double as confidence, case when v is not null and type = 'product_type' then 'manual_review' else 'rule' end as method from (select distinct * from i) left join n using (item), (select unnest(['product_type', 'industry']) as type)"""


@query(D16)
def d16_apply_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted decisions change a type, of several the latest; those without a value and rejected ones change nothing."""
    labels = read(spark, sf_dir, "labels")
    versions = labelled_items(spark, sf_dir).select("item", "product_type").distinct()
    dims = versions.select("item", F.explode(F.create_map(F.lit("product_type"), "product_type", F.lit("industry"), F.lit("other"))).alias("type", "value"), F.lit(0.5).alias("confidence"), F.lit("rule").alias("method"))
    value = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new"), F.col("doc_id") % 3)).otherwise("")
    decisions = labels.select(F.col("doc_id").alias("item"), F.when(F.col("toxic") == 0, "accepted").otherwise("rejected").alias("status"), value.alias("value"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    later = decisions.where("item % 4 = 0").withColumns({"value": F.lit("alpha"), "at": F.lit("2024-01-02").cast("timestamp")})
    decisions = decisions.unionByName(later).unionByName(later.withColumns({"value": F.lit("zeta"), "at": F.lit("2023-01-01").cast("timestamp")}))
    out, rows = V.apply_decisions(versions, dims, decisions)
    return out.join(rows.hint("merge"), "item").select("item", "product_type", "type", "value", "confidence", "method")


I05 = r"""with d as (select doc_id as item, lang as kind, lower(left(coalesce(text, ''), 40) || ' ' || coalesce(text, '')) as t from documents where lang is not null), g as (select distinct item, kind, unnest(regexp_extract_all(t, '[\pL\pN]+')) as w from d),
s as (select item, kind, list(w order by w) as ws from g group by all), c as (select *, min(item) over (partition by kind, ws) as head from s), r as (select item, kind, len(ws) as n from c where item = head),
p as (select a.item, b.item as other, a.kind, count(*) as common from g a join g b on a.kind = b.kind and a.w = b.w and a.item < b.item join r x on x.item = a.item join r y on y.item = b.item group by all),
j as (select p.item, p.other, p.kind, common / (x.n + y.n - common) as score from p join r x on x.item = p.item join r y on y.item = p.other), n as (select doc_id as item, lower(trim(regexp_replace(left(coalesce(text, ''), 40), '\s+', ' ', 'g'))) as name from documents)
select item, other, kind, round(score, 6) as score, case when score = 1 then 'equal tokens' when a.name <> '' and a.name = b.name then 'equal names' else 'similar tokens' end as reason
from (select * from j where score >= 0.8 - 1e-9 union all select head, item, kind, 1.0 from c where item <> head) q join n a using (item) join n b on b.item = q.other"""


@query(I05)
def i05_possible_same_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: a name of forty characters, the whole text as description, the language as kind."""
    text = F.coalesce("text", F.lit(""))
    return S.possible_same_as(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("kind"), F.substring(text, 1, 40).alias("name"), F.col("text").alias("description")))


@query(r"""select doc_id, regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') as has_email, regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}([^0-9]|$)') as has_mobile, regexp_matches(text, '(^|[^0-9])[0-9]{17}[0-9Xx]([^0-9]|$)') as has_identity,
 regexp_matches(lower(text), 'ignore (all )?(previous|prior|above) instructions|<script|system prompt|javascript:') as has_injection from documents""")
def i08_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", L.text_flags(F.col("text")).alias("f")).select("doc_id", "f.*")


@query(r"""select doc_id, case doc_id % 7 when 5 then md5(regexp_replace(text, '[^\x00-\x7F]', chr(65533), 'g') || chr(65533) || chr(65533)) else md5(text) end as text_md5 from documents where text is not null""")
def a07_charset_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes, and back: UTF-8; declared as UTF-16 and, where that can hold them, Latin-1; under a charset that is none; with signs beyond ASCII and an end that no charset of the chain reads."""
    k, text = F.col("doc_id"), F.col("text")
    narrow = text.rlike("^[\\x00-\\xFF]*$")
    body = F.when((k % 7 == 3) & narrow, F.encode(text, "ISO-8859-1")).when(k % 7 == 4, F.encode(text, "UTF-16BE")).when(k % 7 == 5, F.concat(F.encode(F.regexp_replace(text, "[^\\x00-\\x7F]", "\ufffd"), "UTF-8"), F.unhex(F.lit("FFFF")))).otherwise(F.encode(text, "UTF-8"))
    declared = F.when((k % 7 == 3) & narrow, "ISO-8859-1").when(k % 7 == 4, "utf-16-be").when(k % 7 == 6, "no such charset").when(k % 7 == 2, "ascii")
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.decoded(body, declared)).alias("text_md5"))


@query("""select event_id, '{"mail":"us***@example.org","phone":1381234' || lpad((event_id % 10000)::varchar, 4, '0') || ',"13912345678":["138****' || lpad((event_id % 10000)::varchar, 4, '0') || '", "x\\"y"],"props":' || props || '}' as body from events""")
def b15_redact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free JSON around the events' own: values that are text are masked; keys, numbers and escapes stay."""
    tail = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    body = F.concat(F.lit('{"mail":"user'), "event_id", F.lit('@example.org","phone":1381234'), tail, F.lit(',"13912345678":["1381234'), tail, F.lit('", "x\\"y"],"props":'), "props", F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", T.redact_json(body).alias("body"))


@query("""with p as (select p_partkey // 50 as page, p_partkey as k, row_number() over (partition by p_partkey // 50 order by p_partkey) - 1 as place from part), u as (select page, place, 'https://data.example.org/' || case when k % 3 = 0 then 'product/detail/' else 'about/' end || k || case when k % 5 = 0 then '?a=1&b=2' else '' end as to_url from p)
select page, place::int as place, to_url, case when contains(to_url, 'product') then 3.5 else 2.0 end::double as relevance from u""")
def a09_sitemap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps of fifty parts each."""
    k = F.col("p_partkey")
    loc = F.concat(F.lit("<url><loc> https://data.example.org/"), F.when(k % 3 == 0, "product/detail/").otherwise("about/"), k, F.when(k % 5 == 0, "?b=2&amp;a=1&amp;utm_source=x").otherwise(""), F.lit("</loc></url>"))
    rows = read(spark, sf_dir, "part").select(F.floor(k / 50).alias("page"), F.struct(k.alias("k"), loc.alias("loc")).alias("s"))
    maps = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.loc), "").alias("body"))  # fifty addresses a page
    return R.sitemap_links(maps.select("page", F.lit("https://data.example.org/sitemap.xml").alias("url"), F.concat(F.lit("<?xml version='1.0'?><urlset>"), "body", F.lit("</urlset>")).alias("body")), "page")


DRIFT = f"""with r as (select page % 2 as run, k from {RP.COPIES}), n as (select run, count(*) as n from r group by 1),
c as (select run, unnest(['productId', 'productName', 'orgName', 'nested', 'title', 'productType', 'price', 'link']) as key, unnest([true, true, true, true, k % 9 = 0, k % 2 = 0, k % 8 = 0, k % 3 = 0]) as has from r),
q as (select key, run, count(*) filter (has) / any_value(n) as rate from c join n using (run) group by all)
select key, round(max(rate) filter (run = 0), 6) as before, round(max(rate) filter (run = 1), 6) as after, abs(max(rate) filter (run = 0) - max(rate) filter (run = 1)) > 0.05 as drifted from q group by key"""


@query(DRIFT)
def i03_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of records in responses of even and of odd pages."""
    records = RC.json_records(RP.responses(spark, sf_dir), "page", "body").where("path like '$.data.records[%]'")
    keys = records.select("page", (F.col("page") % 2).alias("run"), F.transform("entries", lambda e: e.key).alias("keys"))
    out = L.drift(L.key_rates(keys.where("run = 0")), L.key_rates(keys.where("run = 1")), 0.05)
    return out.withColumns({"before": F.round("before", 6), "after": F.round("after", 6)})

"""Queries on records: pages, listings and responses that Spark writes from part and supplier, read back by the operators.

The SQL works on the tables themselves: what was written into a page must come out of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import extract as X
from ..operators import records as R
from .registry import query, read

#: Words of the industries and types that parts are given, by key.
TRADES = ("银行 风控", "医院 医保", "公路 出行", "电网", "零售 物流", "普通")
TYPES = ("查询接口", "行业数据集", "风控模型", "手工", "")
PARTS = f"""(select p_partkey as k, p_name, p_brand, p_type, p_size, p_retailprice, ['{"', '".join(TRADES)}'][1 + p_partkey % {len(TRADES)}] as trade,
 ['{"', '".join(TYPES)}'][1 + p_partkey % {len(TYPES)}] as kind_raw, 'https://data.example.org/' || case when p_partkey % 7 = 0 then 'product/list' when p_partkey % 3 = 0 then 'product/detail' when p_partkey % 3 = 1 then 'scene/detail' else 'about' end || '/' || p_partkey as url from part)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    route = F.when(k % 7 == 0, "product/list").when(k % 3 == 0, "product/detail").when(k % 3 == 1, "scene/detail").otherwise("about")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    return read(spark, sf_dir, "part").select(k.alias("k"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice", pick(TRADES).alias("trade"), pick(TYPES).alias("kind_raw"), F.concat(F.lit("https://data.example.org/"), route, F.lit("/"), k).alias("url"))


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, url, html): a detail page for each part. Labels are given in all four ways; a shorter second name and an unknown label are put in;
    every fifth page names no provider, every eleventh has no name field."""
    rows = parts(spark, sf_dir)
    name = F.when(F.col("k") % 11 == 0, "").otherwise(F.concat(F.lit("<tr><th>产品名称</th><td>"), "p_name", F.lit("</td><th>产品编号：</th><td>P-"), "k", F.lit("</td></tr>")))
    maker = F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("<dl><dt>提供方</dt> <dd><b>"), "p_brand", F.lit("</b> &amp; Co</dd></dl>")))
    html = F.concat(
        F.lit("<html><head><title>"), "p_type", F.lit(" | exchange</title></head><body><h1>首页</h1><table>"), name,
        F.lit("<tr><td>所属行业</td><td>"), "trade", F.lit("</td><td>alone</td></tr></table><li>名称: x</li>"), maker,
        F.lit('<span class="item-label">产品类型</span>\n<span>'), "kind_raw", F.lit("</span><p>更新频率：every "), "p_size", F.lit(" days</p><p>备注：none</p></body></html>"),
    )
    return rows.select("k", "url", html.alias("html"))


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.labelled_fields(product_pages(spark, sf_dir), "k", R.aliases(spark, R.LABELS))


FIELDS = f"""(select k, unnest(['name', 'external_id', 'industry_raw', 'provider', 'product_type_raw', 'refresh_frequency']) as field,
 unnest([case when k % 11 = 0 or length(p_name) < 1 then 'x' else p_name end, case when k % 11 <> 0 then 'P-' || k end, trade, case when k % 5 <> 0 then p_brand || ' & Co' end, nullif(kind_raw, ''), 'every ' || p_size || ' days']) as value,
 unnest([case when k % 11 = 0 then 'text-pair[0]' else 'table tr[0]' end, 'table tr[0]', case when k % 11 = 0 then 'table tr[0]' else 'table tr[1]' end, 'dl dt[0]+dd', 'class-label[0]', 'text-pair[1]']) as locator from {PARTS})"""


@query(f"select * from {FIELDS} where value is not null")
def c03_labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_fields(spark, sf_dir)


ALIAS_ROWS = ", ".join(f"('{label}', '{field}')" for field, labels in R.LABELS.items() for label in labels)


@query(f"with a as (select label, field, row_number() over () - 1 as n from (values {ALIAS_ROWS}) t(label, field)) select k, field from {PARTS} join a on k % 76 = n")
def c04_field_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all fields, one for each part, with signs that the fold drops; the 76th is unknown."""
    labels = [label for names in R.LABELS.values() for label in names]
    own = F.concat(F.lit(" "), F.get(F.array(*map(F.lit, labels)), (F.col("k") % 76).cast("int")), F.lit("(*) ："))
    return R.canonical_field(parts(spark, sf_dir).select("k", own.alias("label")), "label", R.aliases(spark, R.LABELS)).select("k", "field")


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their fields, kind and score."""
    url = F.col("url")
    pages = product_pages(spark, sf_dir).select("k", "url", T.element(F.col("html"), "title").alias("title"), X.item_name(F.lit(None).cast("string"), F.col("html")).alias("page_name"), F.substring(T.stripped(F.col("html")), 1, 1500).alias("body"))
    rows = pages.join(R.field_map(page_fields(spark, sf_dir), "k").hint("merge"), "k", "left")
    has = lambda n: F.col("fields")[n].isNotNull()
    trade = has(R.TRADE[0]) | has(R.TRADE[1]) | has(R.TRADE[2]) | has(R.TRADE[3])
    score = X.item_score(url, F.col("title"), F.size("fields"), has("name"), trade)
    named = F.when(X.usable_name(F.col("fields")["name"]), F.col("fields")["name"])
    return rows.select("*", X.item_kind(url, F.concat_ws(" ", "url", "title", "body")).alias("kind"), score.alias("score"), F.coalesce(named, "page_name").alias("name"), has("name").alias("named"))


N_FIELDS = "(4 + (k % 11 <> 0)::int + (k % 5 <> 0)::int - (kind_raw = '')::int)"
PAGE_SCORE = f"""(select *, {N_FIELDS} as n_fields, (case when contains(url, 'detail') or contains(url, 'product/') then 3 else 0 end
 + case when regexp_matches(lower(p_type || ' | exchange'), 'product|catalog|dataset|component|scenario|solution|demand') then 2 else 0 end + least({N_FIELDS} * 0.8, 4.0) + 1.5 + case when k % 5 <> 0 or kind_raw <> '' then 1.5 else 0 end)::double as score from {PARTS})"""


@query(f"select k, round(score, 4) as score, n_fields::int as n_fields from {PAGE_SCORE}")
def c08_item_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(spark, sf_dir).select("k", F.round("score", 4).alias("score"), F.size("fields").alias("n_fields"))


@query(f"select k, case when k % 11 = 0 then p_type else p_name end as name from {PAGE_SCORE} where round(score, 4) - 6 >= case when contains(url, 'detail') or contains(url, 'product/') then 3.0 else 4.5 end and (not contains(url, '/list') or k % 4 <> 0)")
def c09_item_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that pass the gate with six points less, so that both thresholds decide; every fourth page counts as one without a name of its own, which lists need. A
    one-letter name gives way to the page's title."""
    rows = page_items(spark, sf_dir)
    return rows.where(X.admitted(F.col("url"), F.round("score", 4) - 6, F.col("named") & (F.col("k") % 4 != 0))).select("k", "name")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, url, html): cards of 50 parts on a page; every fourth card is given twice, every tenth has a generic name."""
    card = F.concat(
        F.lit('<div class="box product-item"><h3 class="card-title">'), F.when(F.col("k") % 10 == 0, "详情").otherwise(F.col("p_name")), F.lit('</h3><a href="/product/detail/'), F.col("k") + 100000, F.lit('">more</a><span class="provider">'),
        "p_brand", F.lit("</span> 交付方式： file "), "p_size", F.lit(" 应用场景：any</div>"),
    )
    rows = parts(spark, sf_dir).select(F.floor(F.col("k") / 50).alias("page"), "k", F.when(F.col("k") % 4 == 0, F.concat(card, card)).otherwise(card).alias("card"))
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda c: c.card), "\n").alias("cards"))  # fifty cards a page
    return pages.select("page", F.concat(F.lit("https://data.example.org/market/"), "page").alias("url"), F.concat(F.lit("<title>product</title><main>"), "cards", F.lit("</main>")).alias("html"))


@query(f"select floor(k / 50)::bigint as page, 'https://data.example.org/product/detail/' || (k + 100000) as url, p_name as name, (k + 100000)::varchar as external_id, p_brand as provider, 'file ' || p_size as delivery_method, 'product' as kind, 0.6::double as confidence from {PARTS} where k % 10 <> 0")
def c10_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cards(listing_pages(spark, sf_dir), "page").select("page", "url", "name", "external_id", "provider", "delivery_method", "kind", "confidence")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, url, body): API answers with 20 parts each. Every sixth part is given twice, every ninth has a second name, every tenth a
    generic one; pages of odd number have a URL that says nothing, and there parts without type and price are no items."""
    k = F.col("k")
    record = F.struct(
        k.cast("string").alias("productId"), F.when(k % 10 == 0, "详情").otherwise(F.col("p_name")).alias("productName"), F.when(k % 9 == 0, "second").alias("title"), F.col("p_brand").alias("orgName"),
        F.when(k % 2 == 0, F.col("kind_raw")).alias("productType"), F.when(k % 8 == 0, F.col("p_retailprice")).alias("price"), F.when(k % 3 == 0, F.concat(F.lit("../item?x="), k)).alias("link"),
        F.struct(F.array(F.lit("n1"), F.lit("n2")).alias("list"), F.lit(1).alias("n")).alias("nested"),
    )
    rows = parts(spark, sf_dir).select(F.floor(k / 20).alias("page"), F.struct(k.alias("k"), record.alias("r")).alias("s")).withColumn("s", F.explode(F.array_repeat("s", F.when(F.col("s.k") % 6 == 0, 2).otherwise(1))))
    pages = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.r).alias("records"))  # twenty records a page
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.size("records").alias("total"), "records").alias("data")))
    return pages.select("page", F.concat(F.when(F.col("page") % 2 == 0, "https://api.example.org/catalog/v1/").otherwise("https://api.example.org/v1/"), "page").alias("url"), body.alias("body"))


COPIES = f"(select *, floor(k / 20)::bigint as page from {PARTS}, range(2) r(copy) where copy = 0 or k % 6 = 0)"


@query(f"""with r as (select page, k, copy, row_number() over (partition by page order by k, copy) - 1 as i from {COPIES}),
paths as (select page, '$' as path, 2 as n_keys from r where i = 0 union all select page, '$.data', 2 from r where i = 0
 union all select page, '$.data.records[' || i || ']', 3 + (k % 9 = 0)::int + (k % 2 = 0)::int + (k % 8 = 0)::int + (k % 3 = 0)::int + 1 from r union all select page, '$.data.records[' || i || '].nested', 2 from r)
select page, path, n_keys::int as n_keys from paths""")
def c11_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.json_records(responses(spark, sf_dir), "page", "body").select("page", "path", F.size("entries").alias("n_keys"))


FIELDS_JSON = f"""(select page, k, copy, unnest(['external_id', 'name', 'provider', 'product_type_raw', 'price_raw']) as field,
 unnest([k::varchar, case when k % 10 = 0 then '详情' else p_name end, p_brand, case when k % 2 = 0 then nullif(kind_raw, '') end, case when k % 8 = 0 then 'price' end]) as value,
 unnest(['json.productId', 'json.productName', 'json.orgName', 'json.productType', 'json.price']) as locator from {COPIES})"""


@query(f"select page, field, locator, count(*) as n, min(value) as least from {FIELDS_JSON} where value is not null and field <> 'price_raw' group by all union all select page, field, locator, count(*), null from {FIELDS_JSON} where value is not null and field = 'price_raw' group by all union all select distinct page, 'external_id', 'json.code', 1, '0' from {FIELDS_JSON}")
def c12_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the two names of a record the first wins."""
    rows = R.json_fields(R.json_records(responses(spark, sf_dir), "page", "body"), "page", R.aliases(spark, R.JSON_KEYS))
    return rows.groupBy("page", "field", "locator").agg(F.count("*").alias("n"), F.min(F.when(F.col("field") != "price_raw", F.col("value"))).alias("least"))


JSON_SUPPORT = "(1 + (k % 2 = 0 and kind_raw <> '')::int + (k % 8 = 0)::int)"
JSON_ITEMS = f"""(select page, k, p_name as name, k::varchar as external_id, case when k % 3 = 0 then 'https://api.example.org/' || case when page % 2 = 0 then 'catalog/' else '' end || 'item?x=' || k
  when page % 2 = 0 then 'https://api.example.org/catalog/v1/' || page else 'https://api.example.org/v1/' || page end as url, {JSON_SUPPORT} as support, kind_raw,
 greatest(5.0, (case when regexp_matches(lower(p_name), 'product|catalog|dataset|component|scenario|solution|demand') then 2 else 0 end + least((2 + {JSON_SUPPORT}) * 0.8, 4.0) + 1.5 + 1.5 + case when page % 2 = 0 then 1.5 else 0 end))::double as score
 from {COPIES} where copy = 0 and k % 10 <> 0)"""


@query(f"select page, external_id, name, url, round(score, 4) as score from {JSON_ITEMS} where page % 2 = 0 or support >= 2")
def c13_json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.json_items(responses(spark, sf_dir), "page", "url", "body", R.aliases(spark, R.JSON_KEYS))
    return rows.select("page", "external_id", "name", "url", F.round("score", 4).alias("score"))


def cased(value: str, groups, otherwise: str) -> str:
    return "case " + " ".join("when " + " or ".join(f"contains({value}, '{w}')" for w in words) + f" then '{g}'" for g, words in groups) + f" else '{otherwise}' end"


CONTEXT = "lower(concat_ws(' ', kind_raw, p_name))"


@query(f"select k, {cased(CONTEXT, R.PRODUCT_TYPES, 'other')} as product_type, case when {cased(CONTEXT, R.PRODUCT_TYPES, 'other')} = 'other' then 0.4 when kind_raw <> '' then 0.96 else 0.75 end::double as confidence from {PARTS}")
def c15_product_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.product_type(F.col("kind_raw"), F.col("p_name"))
    return parts(spark, sf_dir).select("k", own.value.alias("product_type"), own.confidence.alias("confidence"))


LABELLED = "(" + " union all ".join(f"select '{g}' as label, {list(w)!r} as words" for g, w in R.INDUSTRIES) + ")"


@query(f"with m as (select k, label, list_filter(words, lambda w: contains(trade, w)) as hits from {PARTS}, {LABELLED}) select k, label, round(least(0.65 + 0.08 * len(hits), 0.95), 4)::double as confidence, array_to_string(hits, '/') as raw from m where len(hits) > 0")
def c16_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parts(spark, sf_dir).select("k", F.explode(R.industries(F.col("trade"))).alias("i"))
    return found.select("k", F.col("i.value").alias("label"), "i.confidence", F.col("i.hits").alias("raw"))


C14 = f"""
with i as (select k, label, list_filter(words, lambda w: contains(trade || ' ' || p_name, w)) as hits, trade from {PARTS}, {LABELLED}),
d as (select k, 'industry' as type, trade as raw, label as value, round(least(0.65 + 0.08 * len(hits), 0.95), 4) as confidence, 'source+rule' as method from i where len(hits) > 0
 union all select k, 'product_type', kind_raw, {cased("lower(concat_ws(' ', kind_raw, 'product', p_name, ''))", R.PRODUCT_TYPES, 'other')}, case when {cased("lower(concat_ws(' ', kind_raw, 'product', p_name, ''))", R.PRODUCT_TYPES, 'other')} = 'other' then 0.4 when kind_raw <> '' then 0.96 else 0.75 end, case when kind_raw <> '' then 'source' else 'rule' end from {PARTS}
 union all select k, 'platform_province', r_name, r_name, 1.0, 'registry' from {PARTS} join nation on n_nationkey = k % 25 join region on r_regionkey = n_regionkey
 union all select k, 'platform_city', n_name, n_name, 1.0, 'registry' from {PARTS} join nation on n_nationkey = k % 25
 union all select k, 'refresh_frequency', 'every ' || p_size || ' days', 'every ' || p_size || ' days', 0.95, 'source' from {PARTS})
select k, type, raw, value, confidence::double as confidence, method from d
"""


@query(C14)
def c14_item_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five rows
    places = places.select(F.col("n_nationkey").alias("at"), F.col("r_name").alias("province"), F.col("n_name").alias("city"))
    fields = F.create_map(F.lit("product_type_raw"), "kind_raw", F.lit("industry_raw"), "trade", F.lit("refresh_frequency"), F.concat(F.lit("every "), "p_size", F.lit(" days")))
    rows = parts(spark, sf_dir).withColumn("at", (F.col("k") % 25).cast("int")).join(places, "at")
    rows = R.dimensions(rows.select("k", F.lit("product").alias("kind"), F.col("p_name").alias("name"), F.lit("").alias("description"), fields.alias("fields"), "province", "city"))
    return rows.select("k", F.explode("dimensions").alias("d")).select("k", "d.*")


@query(f"select k, case when k % 3 = 1 then kind_of else 'product' end as kind from (select k, case k % 4 when 0 then 'scenario' when 2 then 'component' else 'product' end as kind_of from {PARTS})")
def c17_kind_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared collection kind beats the page's, unless it is mixed or there is none."""
    rules = spark.createDataFrame([(0, "scenario"), (1, "mixed"), (2, "component")], "collection long, declared string")  # a rule table
    rows = parts(spark, sf_dir).where("k >= 0").select("k", F.when(F.col("k") % 3 == 1, F.col("k") % 4).alias("collection"), F.lit("product").alias("kind"))
    return X.declared_kind(rows, rules).select("k", "kind")


@query(f"select k, 'https://data.example.org/item/' || k || '?p=' || k % 9 as url, case when k % 4 = 0 then 'https://data.example.org/list?a=1&_page=' || k % 9 else 'https://data.example.org/list?_page=' || k % 9 end as page_url, k % 9 as page_no from {PARTS} where k % 5 <> 0 union all select k, url, case when k % 4 = 0 then 'https://data.example.org/list?a=1&_page=' || k % 9 else 'https://data.example.org/list?_page=' || k % 9 end, k % 9 from {PARTS} where k % 5 = 0")
def b22_b23_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, their page numbers, and detail URLs from a template; every fifth part has no id."""
    rows = parts(spark, sf_dir)
    k = F.col("k")
    template = F.concat(F.lit("https://data.example.org/item/{id}?p="), k % 9)
    paged = U.page_url(F.when(k % 4 == 0, "https://data.example.org/list?a=1#top").otherwise("https://data.example.org/list"), k % 9)
    external = F.when(k % 5 == 0, "").otherwise(k.cast("string"))
    return rows.select("k", U.detail_url(template, external, F.col("url")).alias("url"), paged.alias("page_url"), U.page_number(paged).alias("page_no"))


@query(f"select k, case when k % 7 = 0 or k % 3 = 0 then case when k % 2 = 0 then k * 1000 + 7 end end as total from {PARTS}")
def b24_declared_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with separators in listings; on odd parts no word of the catalogue stands near."""
    k = F.col("k")
    word = F.when(k % 2 == 0, "数据产品").otherwise(F.concat(F.lit("数据产品"), F.repeat(F.lit("-"), F.lit(90))))
    text = F.concat(F.lit("x" * 100), word, F.lit(" 共 "), F.format_number(k * 1000 + 7, 0), F.lit(" 条"), F.lit("-" * 90))
    return parts(spark, sf_dir).select("k", T.declared_total(text, F.col("url"), F.lit("unknown")).alias("total"))


@query(f"select k, 'al***@h.org' as mail, '138****5678,' || p_name as list, p_size from {PARTS}")
def b15_redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses and numbers in maps and lists of structs; numbers and keys stay."""
    inner = F.struct(F.create_map(F.lit("alice@h.org"), F.lit("alice@h.org")).alias("m"), F.array(F.lit("13812345678"), "p_name").alias("list"), "p_size")
    rows = parts(spark, sf_dir).select("k", inner.alias("v"))
    return rows.select("k", T.redact_fields(F.col("v"), rows.schema["v"].dataType).alias("v")).select("k", F.col("v.m")["alice@h.org"].alias("mail"), F.array_join("v.list", ",").alias("list"), "v.p_size")

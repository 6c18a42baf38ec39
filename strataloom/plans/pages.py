"""Queries over captured pages: URL functions, link graph, extraction, frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..operators import extract as X
from ..operators import frontier as FR
from ..operators import versioning as V
from .registry import query, read

# SQL fragments over pages, written without the functions above.
TRACK = "('" + "', '".join(U.TRACKING) + "')"
P_HOST = r"lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
SQL_CANON = rf"""regexp_extract(url, '^(https?://)', 1) || {P_HOST}
 || case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/{{2,}}', '/', 'g') end
 || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in {TRACK})), '&'), ''), '')
 || case when regexp_matches(url, '#!?/') then regexp_extract(url, '(#!?/.*)$', 1) else '' end"""
SQL_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))"""
A_RE = r"<a\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"
SQL_LINKS = rf"""
with a as (select page_id, url, unnest(regexp_extract_all(html, '{A_RE}', 1)) as href, unnest(regexp_extract_all(html, '{A_RE}', 2)) as anchor, unnest(range(0, len(regexp_extract_all(html, '{A_RE}', 1)))) as place from pages),
t as (select page_id, place, regexp_extract(url, '^(https?://)', 1) || {P_HOST} || href as to_url, anchor from a),
links as (select * exclude nth from (select *, row_number() over (partition by page_id, to_url order by place) as nth from t) where nth = 1)"""


def has(v: str, terms) -> str:
    return "(" + " or ".join(f"contains({v}, '{t}')" for t in terms) + ")"


def relevance_sql(url: str, anchor: str) -> str:
    v = f"lower({url} || ' ' || {anchor})"
    return " + ".join(f"case when contains({v}, '{t}') then 1.5::double else 0 end" for t in U.TARGET_TERMS) + f" + case when {has(v, U.DETAIL_TERMS)} then 2 else 0 end + case when regexp_matches({v}, '{U.PAGER}') then 1 else 0 end - case when regexp_matches({v}, '{U.BINARY}') then 10 else 0 end - case when {has(v, U.EXIT_TERMS)} then 10 else 0 end"


def role_sql(url: str, anchor: str) -> str:
    v = f"lower({url} || ' ' || {anchor})"
    return f"case when contains({v}, '/api/') then 'api' when contains({v}, 'sitemap') or suffix({v}, '.xml') then 'sitemap' when regexp_matches({v}, '\\.pdf(\\?|$)') then 'document' when {has(v, ('detail', 'info', 'view'))} then 'detail' when {has(v, U.LISTING_TERMS)} then 'listing' else 'unknown' end"


def url_of(*a):
    return read(*a, "pages").select("page_id", "url")


@query(f"select page_id, {SQL_CANON} as canonical_url from pages")
def b01_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_of(spark, sf_dir).select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"))


@query(rf"select page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x/y?z=1' as rooted, regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || 'next' as beside, regexp_extract(url, '^([^?#]*)', 1) || '?p=2' as paged, regexp_extract(url, '^(https?:)', 1) || '//cdn.example.org/a' as other from pages")
def b02_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return url_of(spark, sf_dir).select("page_id", *[U.resolved(u, F.lit(h)).alias(n) for n, h in (("rooted", "/x/y?z=1"), ("beside", "./next"), ("paged", "?p=2"), ("other", "//cdn.example.org/a"))])


@query(rf"select page_id, {P_HOST} as host, array_to_string(list_slice(string_split({P_HOST}, '.'), -2, -1), '.') as family from pages")
def b03_host_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = U.host(F.col("url"))
    return url_of(spark, sf_dir).select("page_id", h.alias("host"), U.family(h).alias("family"))


@query(rf"select page_id, url from pages where {P_HOST} in ('example.org', 'blog.example.com') or suffix({P_HOST}, '.example.org') or suffix({P_HOST}, '.blog.example.com')")
def b04_allowed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_of(spark, sf_dir).where(U.host_allowed(U.host(F.col("url")), ("example.org", "blog.example.com")))


OCTETS = "(select s_suppkey, [s_suppkey * 7 % 256, s_nationkey * 31 % 256, (s_suppkey * 3 + s_nationkey) % 256, s_suppkey % 256] as o from supplier)"
CLOSED_SQL = " or ".join("n between " + " and ".join(str(sum(int(x) << (24 - 8 * k) for k, x in enumerate(v.split(".")))) for v in pair) for pair in U.CLOSED)


@query(f"""with h as (select s_suppkey, array_to_string(o, '.') as host, o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] as n from {OCTETS}), p as (select *, not ({CLOSED_SQL}) as public from h)
select s_suppkey, host, public from p union all select s_suppkey, '::FFFF:' || host, public from p union all select s_suppkey, '[2002:' || format('{{:x}}', n // 65536) || ':' || format('{{:x}}', n % 65536) || '::1]', false from p
 union all select s_suppkey, '2a00:' || format('{{:x}}', s_suppkey) || '::' || host, true from p union all select s_suppkey, '0:0:0::' || s_suppkey % 3, s_suppkey % 3 = 2 from p""")
def b05_public_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of supplier keys, in both families and several spellings."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    octets = [k * 7 % 256, n * 31 % 256, (k * 3 + n) % 256, k % 256]
    quad, pair = F.concat_ws(".", *octets), lambda a, b: F.lower(F.hex(a * 256 + b))
    every = F.array(quad, F.concat(F.lit("::FFFF:"), quad), F.concat(F.lit("[2002:"), pair(*octets[:2]), F.lit(":"), pair(*octets[2:]), F.lit("::1]")), F.concat(F.lit("2a00:"), F.lower(F.hex(k)), F.lit("::"), quad), F.concat(F.lit("0:0:0::"), k % 3))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(every).alias("host")).withColumn("public", U.public_literal(F.col("host")))


@query(f"select page_id, {role_sql('url', chr(39) * 2)} as role from pages")
def b16_page_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_of(spark, sf_dir).select("page_id", U.page_role(F.col("url"), F.lit(""), F.lit("")).alias("role"))


@query(SQL_LINKS + f" select page_id, to_url, {relevance_sql('to_url', 'anchor')} as relevance from links")
def b17_link_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(read(spark, sf_dir, "pages")).select("page_id", "to_url", "relevance")


B18 = r"""
with p as (select page_id, case when page_id % 3 = 0 then replace(url, '#top', '') || '#/list' else url end as url,
  case page_id % 5 when 0 then html || '<script>window.__NUXT__</script><SCRIPT src="x">' when 1 then '<div id="app"></div><script></script><script src="vite">' else html end as html from pages),
v as (select page_id, url, left(html, 300000) as head from p),
w as (select *, length(trim(regexp_replace(regexp_replace(head, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as seen, len(regexp_extract_all(lower(head), '<script\b')) as scripts,
  contains(head, 'window.__NUXT__') or contains(head, '__NEXT_DATA__') as server,
  contains(head, 'id="app"') or contains(head, 'id="root"') or contains(head, 'id="main"') or contains(head, 'webpack') or contains(head, 'vite') as app from v)
select page_id, regexp_matches(url, '#!?/') or (scripts >= 2 and (server or (app and seen < 800))) as is_app from w
"""


@query(B18)
def b18_app_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, some with the marks of applications put in."""
    k, html, url = F.col("page_id"), F.col("html"), F.col("url")
    rows = read(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k % 3 == 0, F.concat(F.replace(url, F.lit("#top"), F.lit("")), F.lit("#/list"))).otherwise(url).alias("url"),
        F.when(k % 5 == 0, F.concat(html, F.lit('<script>window.__NUXT__</script><SCRIPT src="x">'))).when(k % 5 == 1, '<div id="app"></div><script></script><script src="vite">').otherwise(html).alias("html"),
    )
    return rows.select("page_id", U.looks_like_app(F.col("html"), F.col("url"), F.lit("text/html")).alias("is_app"))


@query(r"select page_id, case when regexp_matches(tail, '^[0-9a-fA-F_-]{6,80}$') then tail else '' end as external_id from (select page_id, regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) as tail from pages)")
def b19_external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_of(spark, sf_dir).select("page_id", U.external_id(F.col("url")).alias("external_id"))


@query(f"select page_id, case when role in ('entry', 'listing', 'api', 'sitemap', 'unknown') then 1 when page_id % 2 = 0 then 2 when role = 'detail' then 7 else 14 end as days, timestamp '2024-01-01' + to_days(case when role in ('entry', 'listing', 'api', 'sitemap', 'unknown') then 1 when page_id % 2 = 0 then 2 when role = 'detail' then 7 else 14 end) as due_at from (select page_id, {role_sql('url', chr(39) * 2)} as role from pages)")
def b20_due_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = U.due_days(U.page_role(F.col("url"), F.lit(""), F.lit("")), F.col("page_id") % 2 == 0)
    return url_of(spark, sf_dir).select("page_id", days.alias("days"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days)).alias("due_at"))


@query(SQL_LINKS + " select page_id, place::int as place, to_url, anchor from links")
def c01_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(read(spark, sf_dir, "pages")).select("page_id", "place", "to_url", "anchor")


SQL_TITLE = SQL_TEXT.format(r"regexp_extract(html, '<title>(.*?)</title>', 1, 's')")
SQL_H1 = SQL_TEXT.format(r"regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]*>', ' ', 'g')")
SQL_BODY = SQL_TEXT.format(r"regexp_replace(regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')")


@query(f"select page_id, {SQL_TITLE} as title, md5({SQL_BODY}) as text_md5 from pages")
def c02_title_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.element(F.col("html"), "title").alias("title"), F.md5(T.stripped(F.col("html"))).alias("text_md5"))


SQL_NAME = f"case when length({SQL_H1}) between 2 and 300 then {SQL_H1} else (case when length(trim(regexp_extract({SQL_TITLE}, '^([^-_|—]*)', 1))) between 2 and 300 then trim(regexp_extract({SQL_TITLE}, '^([^-_|—]*)', 1)) end) end"


@query(f"select page_id, {SQL_NAME} as name from pages")
def c05_item_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.item_name(F.lit(None).cast("string"), F.col("html")).alias("name"))


P_ALL = SQL_TEXT.format(r"regexp_replace(p, '<[^>]*>', ' ', 'gs')")


C06 = rf"""
with a as (select page_id, unnest(regexp_extract_all(html, '<article\b[^>]*>(.*?)</article>', 1, 's')) as a from pages), q as (select page_id, regexp_extract_all(a, '<p\b[^>]*>(.*?)</p>', 1, 's') as ps from a),
p as (select page_id, unnest(ps) as p, unnest(range(len(ps))) as k from q), t as (select page_id, k, {P_ALL} as t from p)
select pages.page_id, coalesce(arg_max(t, (length(t), -k)), '') as description from pages left join (select * from t where length(t) between 20 and 5000) t on t.page_id = pages.page_id group by all
"""


@query(C06)
def c06_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.description(F.col("html")).alias("description"))


def kind_sql(url: str, context: str) -> str:
    rows = [(k, t, f"lower({url})") for k, t in X.ROUTE_KINDS] + [(k, t, f"lower({context})") for k, t in X.CONTEXT_KINDS]
    return "case " + " ".join(f"when {has(v, t)} then '{k}'" for k, t, v in rows) + " else 'product' end"


SQL_EXTERNAL = r"(case when regexp_matches(regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '^[0-9a-fA-F_-]{{6,80}}$') then regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1) else '' end)".replace("{{", "{").replace("}}", "}")
ITEM = f"select page_id, url, {kind_sql('url', f'concat_ws(chr(32), url, {SQL_TITLE}, left({SQL_BODY}, 1500))')} as kind, (case when {has('lower(url)', U.DETAIL_TERMS)} then 3.0 else 0 end + case when {has(f'lower({SQL_TITLE})', U.TARGET_TERMS)} then 2.0 else 0 end - case when {has(SQL_TITLE, X.NEWS)} then 4.0 else 0 end)::double as score, {SQL_NAME} as name, {SQL_CANON} as canonical, {SQL_EXTERNAL} as external from pages"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_items(read(spark, sf_dir, "pages"))


def page_items(pages: DataFrame) -> DataFrame:
    """Page to item, for pages without labelled fields: canonical URL, kind, score, name, key."""
    url, html = F.col("url"), F.col("html")
    rows = pages.select("page_id", "url", T.element(html, "title").alias("title"), F.substring(T.stripped(html), 1, 1500).alias("body"), X.item_name(F.lit(None).cast("string"), html).alias("name"), U.canonical_url(url).alias("canonical"))
    no = F.lit(False)
    rows = rows.select("*", X.item_kind(url, F.concat_ws(" ", "url", "title", "body")).alias("kind"), X.item_score(url, F.col("title"), F.lit(0), no, no).alias("score"))
    return rows.withColumn("natural_key", X.natural_key(F.col("kind"), U.external_id(url), F.col("canonical"), F.col("name"), F.lit("")))


@query(f"select page_id, kind from ({ITEM})")
def c07_item_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("page_id", "kind")


SQL_KEY = "sha256(case when external <> '' then 'external:' || kind || ':' || lower(external) else 'url:' || kind || ':' || canonical end)"


@query(f"select page_id, {SQL_KEY} as natural_key from ({ITEM})")
def d01_natural_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("page_id", "natural_key")


@query(rf"select array_to_string(list_slice(string_split({P_HOST}, '.'), -2, -1), '.') as family, kind, count(*) as n_items, count(distinct {SQL_KEY}) as n_keys from ({ITEM}) group by all")
def slice_items_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("family", U.family(U.host(F.col("url"))))
    return rows.groupBy("family", "kind").agg(F.count("*").alias("n_items"), F.countDistinct("natural_key").alias("n_keys"))


Q_SCORE = f"({relevance_sql('to_url', 'anchor')} + case {role_sql('to_url', 'anchor')} when 'sitemap' then 7 when 'listing' then 5 when 'api' then 5 when 'detail' then 4 else 0 end - 0.15 * 2)"


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with role and queue score at depth 2."""
    u, a = F.col("to_url"), F.col("anchor")
    rows = X.links(read(spark, sf_dir, "pages")).withColumn("role", U.page_role(u, a, F.lit("")))
    return rows.withColumn("score", F.round(U.queue_score(u, a, F.col("role"), F.lit(2)), 4))


@query(SQL_LINKS + f" select page_id, to_url, round({Q_SCORE}, 4) as score from links")
def e01_queue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier(spark, sf_dir).select("page_id", "to_url", "score")


E02_REL = f"({relevance_sql('to_url', 'anchor')})"


@query(SQL_LINKS + f" select page_id, to_url from links where case when page_id % 4 = 0 then {E02_REL} > -5 when page_id % 3 = 0 then {E02_REL} > -0.1 or regexp_matches(anchor, '^[0-9]+$') else {E02_REL} >= 1 end")
def e02_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at depth 1 from every fourth page, from listings on every third, from other pages at depth 2."""
    k = F.col("page_id")
    rows = X.links(read(spark, sf_dir, "pages"))
    keep = U.admitted(F.col("to_url"), F.col("anchor"), F.col("relevance"), F.when(k % 4 == 0, 1).otherwise(2), F.when(k % 3 == 0, "listing").otherwise("unknown"))
    return rows.where(keep).select("page_id", "to_url")


@query(SQL_LINKS + rf""", d as (select to_url, max(round({Q_SCORE}, 4)) as score, min((page_id, place)) as seq from links where to_url not in (select {SQL_CANON} from pages) group by to_url),
 r as (select *, regexp_extract(to_url, '^https?://([^/?#:]+)', 1) as host, row_number() over (partition by regexp_extract(to_url, '^https?://([^/?#:]+)', 1) order by score desc, seq) as rank, count(*) over (partition by regexp_extract(to_url, '^https?://([^/?#:]+)', 1)) as n from d)
 select host, to_url, score, rank::int as rank, n > 5 as hit_limit from r where rank <= 5""")
def e03_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best links of each host that are no captured pages themselves; the budget of a host is the feature."""
    visited = url_of(spark, sf_dir).select(U.canonical_url(F.col("url")).alias("url"))
    return FR.best_first(frontier(spark, sf_dir).select("to_url", "score", F.struct("page_id", "place").alias("seq")), visited, 5).select("host", "to_url", "score", "rank", "hit_limit")


@query("select page_id, url, timestamp '2024-01-01' + to_minutes(page_id::int) as due_at from pages where page_id % 4 <> 0 order by due_at, page_id limit 50")
def e04_due_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_of(spark, sf_dir).withColumn("due_at", F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, int(page_id))"))
    return rows.where("page_id % 4 <> 0").orderBy(F.asc_nulls_first("due_at"), "page_id").limit(50)


@query(SQL_LINKS + f", s as (select to_url as from_url, page_id * 1000000 + place as n, regexp_extract(to_url, '^(https?://[^/]+)', 1) || '/next/' || place as to_url, page_id % 2 = 0 as active from links), u as (select page_id, to_url from links) select distinct u.page_id, s.to_url from u join s on s.from_url = u.to_url where s.active")
def e10_stored_link_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that did not change, read from the stored edges of the page that they point to."""
    found = X.links(read(spark, sf_dir, "pages"))
    stored = found.select(F.col("to_url").alias("from_url"), F.concat(F.regexp_extract("to_url", "^(https?://[^/]+)", 1), F.lit("/next/"), "place").alias("to_url"), (F.col("page_id") % 2 == 0).alias("active"))
    return FR.stored_links(found.select("page_id", F.col("to_url").alias("url")), stored)


@query("select page_id, case when html like '{%' or html like '[%' then 'json' when html like '<?xml%' then 'xml' when html like '%PDF%' and html like '\\%PDF%' escape '\\' then 'pdf' else 'html' end as content_kind, length(html) as n_chars from pages")
def a06_content_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.content_kind(F.lit(""), F.col("html")).alias("content_kind"), F.length("html").alias("n_chars"))


A11 = SQL_LINKS + f""", f as (select url as from_url, to_url, case when place % 3 = 0 then '' else anchor end as anchor, {relevance_sql('to_url', 'anchor')} as relevance, page_id, place from links join (select page_id, url from pages) using (page_id))
select from_url, to_url, coalesce(nullif(n.anchor, ''), o.anchor, '') as anchor, coalesce(n.relevance, 0)::double as relevance, case when o.anchor is null then 2 else 1 end as first_seen, case when n.nth is null then 1 else 2 end as last_seen
from (select distinct from_url, to_url, 'old' as anchor from f where place % 2 = 0) o full join (select * from (select *, row_number() over (partition by from_url, to_url order by place, anchor, relevance) as nth from f where page_id % 2 = 0) where nth = 1) n using (from_url, to_url)"""


@query(A11)
def a11_link_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the links are known, from all pages; a new batch has those of even pages, some without anchor. An edge goes from URL to URL, so pages of one URL share theirs."""
    pages = read(spark, sf_dir, "pages")
    rows = X.links(pages).join(pages.select("page_id", F.col("url").alias("from_url")).hint("merge"), "page_id")
    known = rows.where("place % 2 = 0").select("from_url", "to_url", F.lit("old").alias("anchor"), F.lit(0.0).alias("relevance"), F.lit(1).alias("first_seen"), F.lit(1).alias("last_seen")).distinct()
    found = rows.where("page_id % 2 = 0").select("from_url", "to_url", "place", F.when(F.col("place") % 3 == 0, "").otherwise(F.col("anchor")).alias("anchor"), "relevance", F.lit(2).alias("at"))
    return V.merge_links(known, found)


@query(f"select page_id, 'v2' as extractor_version, kind, name from ({ITEM}) where page_id % 3 <> 0")
def i04_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages extracted anew where that was not yet done with this version."""
    done = read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "v2").otherwise("v1").alias("extractor_version"))
    return X.replay(read(spark, sf_dir, "pages"), done, "page_id", "v2", page_items).select("page_id", "extractor_version", "kind", "name")

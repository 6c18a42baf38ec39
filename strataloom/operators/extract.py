"""Extraction jobs: captured pages to links, records and classified items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions.steps import settled

# Results depend on them.
GENERIC_NAMES = ("首页", "数据产品", "产品中心", "产品目录", "数据服务", "数据组件", "应用场景", "解决方案", "数据交易", "更多", "详情", "产品详情", "场景案例")
ROUTE_KINDS = (
    ("demand", ("/demand", "demand/", "requirement/")),
    ("scenario", ("/scenario", "scenario/", "/scene/", "/solution/")),
    ("component", ("/component", "component/", "/tool/", "/algorithm/", "/aifactory")),
    ("product", ("/product", "product/", "/goods/", "/dataset/", "/catalog/")),
)
CONTEXT_KINDS = (
    ("scenario", ("应用场景", "数据场景", "场景详情", "scenario", "解决方案")),
    ("component", ("数据组件", "组件详情", "component", "算法工具", "开发工具")),
    ("demand", ("数据需求", "需求详情", "demand")),
)
LIST_PATHS = "/list|/catalog|/search|/index|/(?:product|goods|dataset|scenario|demand)$"
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:(["'])(.*?)\1|([^\s>"']+))[^>]*>(.*?)</a>"""
NEWS = ("新闻", "通知", "公告", "政策", "资讯")


def content_kind(mime: Column, body: Column) -> Column:
    """json, xml, pdf or html by media type or first characters."""
    start = F.substring(F.ltrim(body), 1, 5)
    return (
        F.when(F.contains(mime, F.lit("json")) | start.rlike(r"^[{\[]"), "json")
        .when(F.contains(mime, F.lit("xml")) & ~F.contains(mime, F.lit("html")) | (start == "<?xml"), "xml")
        .when(F.contains(mime, F.lit("pdf")) | start.startswith("%PDF"), "pdf")
        .otherwise("html")
    )


def links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Link graph: page, place, canonical target, anchor, relevance; the first occurrence of each target. The page body
    is dropped before the window, so only link rows are shuffled."""
    pattern = F.lit(ANCHOR)
    found = pages.select(id_col, "url", F.posexplode(F.regexp_extract_all("html", pattern, 0)).alias("place", "a"))  # one pass over a page
    found = found.select(id_col, "url", "place", F.concat(F.regexp_extract("a", ANCHOR, 2), F.regexp_extract("a", ANCHOR, 3)).alias("href"), F.regexp_extract("a", ANCHOR, 4).alias("inner"))
    anchor = T.unescaped(F.regexp_replace("inner", r"(?s)<[^>]*>", " "))
    rows = settled(found, {"to": U.resolved(F.col("url"), F.trim(T.unescaped(F.col("href")))), "anchor": anchor}).drop("inner", "href", "url")
    rows = settled(rows, {"to_url": U.canonical_url(F.col("to")), "anchor": T.snippet(T.normalize_text(F.col("anchor")), 300)}).drop("to").where("to_url <> ''")
    rows = settled(rows, {"relevance": U.link_relevance(F.col("to_url"), F.col("anchor"))})
    own = Window.partitionBy(id_col, "to_url").orderBy("place")
    return rows.withColumn("nth", F.row_number().over(own)).where("nth = 1").drop("nth")


def item_kind(url: Column, context: Column) -> Column:
    """Kind by route, else by what the text says, else product."""
    out, low = F.when(F.lit(False), ""), F.lower(url)
    for kind, terms in ROUTE_KINDS:
        out = out.when(U.any_of(low, terms), kind)
    for kind, terms in CONTEXT_KINDS:
        out = out.when(U.any_of(F.lower(context), terms), kind)
    return out.otherwise("product")


def usable_name(name: Column) -> Column:
    return (F.length(name) >= 2) & (F.length(name) <= 300) & ~name.isin(*GENERIC_NAMES)


def item_name(fields_name: Column, html: Column) -> Column:
    """The first usable of: name field, h1, detail or product title, h2 under a title, h2, page title up to a separator."""
    inner = lambda pattern, k: T.squeezed(T.unescaped(F.regexp_replace(F.regexp_extract(html, pattern, k), r"(?s)<[^>]*>", " ")))
    titles = [inner(rf'(?is)<(\w+)\b[^>]*\bclass="(?:[^"]*\s)?{c}(?:\s[^"]*)?"[^>]*>(.*?)</\1>', 2) for c in ("detail-title", "product-title")]
    under = inner(r'(?is)\bclass="(?:[^"]*\s)?title(?:\s[^"]*)?"[^>]*>(?:(?!</div>).)*?<h2\b[^>]*>(.*?)</h2>', 1)
    title = F.trim(F.regexp_extract(T.element(html, "title"), r"^([^-_|—]*)", 1))
    options = F.array(F.coalesce(fields_name, F.lit("")), T.element(html, "h1"), *titles, under, T.element(html, "h2"), title)
    return F.try_element_at(F.filter(options, usable_name), F.lit(1))


def description(html: Column, given: Column | None = None) -> Column:
    """A given description, else that of the meta tags (15 characters or more), else the longest paragraph of 20 to 5,000
    characters in an article, content or detail block."""
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda m: m.rlike(r"""(?i)\b(?:name=["']description|property=["']og:description)["']"""))
    meta = F.coalesce(F.try_element_at(F.transform(metas, lambda m: T.squeezed(T.unescaped(F.regexp_extract(m, r"""(?is)\bcontent=["']([^"']*)["']""", 1)))), F.lit(1)), F.lit(""))
    parts = F.concat(
        F.regexp_extract_all(html, F.lit(r"(?is)<article\b[^>]*>(.*?)</article>"), 1),
        F.regexp_extract_all(html, F.lit(r'(?is)<div\b[^>]*\bclass="(?:[^"]*\s)?(?:content|detail)(?:\s[^"]*)?"[^>]*>(.*?)</div>'), 1),
    )
    inner = F.flatten(F.transform(parts, lambda a: F.regexp_extract_all(a, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)))
    plain = F.transform(inner, lambda p: T.squeezed(T.unescaped(F.regexp_replace(p, r"(?s)<[^>]*>", " "))))
    fits = F.transform(F.filter(plain, lambda p: (F.length(p) >= 20) & (F.length(p) <= 5000)), lambda p, k: F.struct(F.length(p).alias("n"), (-k).alias("k"), p.alias("text")))
    found = F.when(F.length(meta) >= 15, meta).otherwise(F.coalesce(F.array_max(fits).text, F.lit("")))
    return found if given is None else F.coalesce(F.nullif(given, F.lit("")), found)


def item_score(url: Column, title: Column, n_fields: Column, has_name: Column, has_trade: Column) -> Column:
    score = F.when(U.any_of(F.lower(url), U.DETAIL_TERMS), 3.0).otherwise(0.0) + F.when(U.any_of(F.lower(title), U.TARGET_TERMS), 2.0).otherwise(0.0)
    score = score + F.least(n_fields * 0.8, F.lit(4.0)) + F.when(has_name, 1.5).otherwise(0.0) + F.when(has_trade, 1.5).otherwise(0.0)
    return score - F.when(U.any_of(title, NEWS) & (n_fields < 3), 4.0).otherwise(0.0)


def admitted(url: Column, score: Column, named: Column) -> Column:
    """The gate: 3.0 on detail routes, else 4.5; a page that looks like a list needs a name of its own among its fields."""
    path = F.regexp_replace(F.lower(U.part(url, 4)), "/+$", "")
    listing = path.rlike(LIST_PATHS)
    return (score >= F.when(U.any_of(path, U.DETAIL_TERMS), 3.0).otherwise(4.5)) & (~listing | named)


def natural_key(kind: Column, external: Column, url: Column, name: Column, provider: Column) -> Column:
    """sha256 of what tells an item apart: external id, else URL, else name and provider; each with the kind."""
    fold = lambda c: F.lower(F.trim(c))
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    raw = (
        F.when(some(external), F.concat_ws(":", F.lit("external"), kind, fold(external)))
        .when(some(url), F.concat_ws(":", F.lit("url"), kind, url))
        .otherwise(F.concat_ws(":", F.lit("name"), kind, fold(F.coalesce(name, F.lit(""))), fold(F.coalesce(provider, F.lit("")))))
    )
    return F.sha2(raw, 256)


def replay(snapshots: DataFrame, done: DataFrame, key: str, version: str, extractor) -> DataFrame:
    """What ``extractor`` (DataFrame -> DataFrame with the key) makes of the stored snapshots that ``done`` (key, extractor_version) does not have for
    this version."""
    known = done.where(F.col("extractor_version") == version).select(key)
    return extractor(snapshots.join(known.hint("merge"), key, "left_anti")).withColumn("extractor_version", F.lit(version))


def sub_responses(pages: DataFrame, key: list[str]) -> DataFrame:
    """Captured sub-responses (``captured``: array of url, status, body) as rows of the corpus: (key, place, url, body, depth), one level deeper; only those
    with status 200 and a body. Rows are exploded where they lie, without a shuffle."""
    each = pages.select(*key, (F.col("depth") + 1).alias("depth"), F.posexplode("captured").alias("place", "c"))
    return each.where("c.status = 200 and c.body <> ''").select(*key, "place", "c.url", "c.body", "depth")


def declared_kind(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The kind that the item's collection declares (rules: collection, declared), unless that is mixed; of several rules for a collection the
    largest counts. Spark broadcasts the rules if their size allows."""
    out = items.join(rules.groupBy("collection").agg(F.max("declared").alias("declared")), "collection", "left")
    return out.withColumn("kind", F.when(F.coalesce("declared", F.lit("mixed")) != "mixed", F.col("declared")).otherwise(F.col("kind"))).drop("declared")


def keyword_class(text: Column, groups, other: str = "other") -> Column:
    """The first of ordered keyword groups that the text matches."""
    out = F.when(F.lit(False), "")
    for value, words in groups:
        out = out.when(U.any_of(F.lower(text), words), value)
    return out.otherwise(other)

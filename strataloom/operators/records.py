"""Records from listing pages, detail pages and JSON responses: fields, cards, types, industries, dimensions.

Rule lists are parameters; the defaults are fixed values. Labels and cards are read from a page's tree (``tree``). Page bodies leave the plan before any shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions.steps import settled
from . import extract as X
from . import tree as TR

# Results depend on them.
LABELS = {
    "name": ("产品名称", "商品名称", "数据名称", "资源名称", "场景名称", "组件名称", "名称"),
    "description": ("产品描述", "产品简介", "商品描述", "数据描述", "场景描述", "功能简介", "简介", "描述"),
    "provider": ("数据提供方", "提供单位", "提供方", "供应商", "所属数商", "发布单位", "机构名称"),
    "product_type_raw": ("产品类型", "商品类型", "资源类型", "数据类型", "交付形态", "服务类型"),
    "industry_raw": ("所属行业", "应用行业", "行业分类", "行业领域", "应用领域", "领域"),
    "price_raw": ("产品价格", "挂牌价格", "价格", "计费方式", "参考价格"),
    "delivery_method": ("交付方式", "交付形式", "服务方式", "使用方式", "交付渠道"),
    "refresh_frequency": ("更新频率", "更新周期", "数据频率", "刷新频率"),
    "published_at": ("发布时间", "发布日期", "上架时间", "挂牌时间", "创建时间"),
    "source_updated_at": ("更新时间", "更新日期", "最后更新", "修改时间"),
    "data_period": ("数据时间范围", "数据周期", "覆盖时间", "数据期限", "时间范围"),
    "region_raw": ("覆盖地域", "所属区域", "服务区域", "数据地域", "地域范围"),
    "external_id": ("产品编号", "商品编号", "资源编号", "产品编码", "场景编号", "唯一标识"),
    "tags": ("标签", "关键词", "产品标签"),
}
JSON_KEYS = {
    "name": ("productname", "goodsname", "dataname", "resourcename", "scenename", "componentname", "proresourcename", "cpmc", "servicename", "title", "name"),
    "description": (
        "productdesc", "productintroduction", "detailedintroduction", "dataproductdesc", "proresourcedesc", "briefintroduction", "introduce", "cpms", "descript",
        "description", "describe", "introduction", "summary", "content", "remark",
    ),
    "provider": (
        "providername", "suppliername", "suppliercompanyname", "providercompanyname", "dataprovidername", "enterprisename", "publisher", "producername", "supplyname",
        "companyname", "orgname", "provider", "supplier",
    ),
    "product_type_raw": (
        "producttype", "producttypename", "goodstype", "goodsclassify", "datatype", "dataproducttype", "data_service_type1_name", "proresourcetype", "fclassmc",
        "fsubclassmc", "resourcetype", "deliverytype", "typename",
    ),
    "industry_raw": ("industryname", "industry", "industrytype", "industrycategory", "sectorsname", "yycjmc", "fieldname", "domain"),
    "price_raw": ("price", "productprice", "displayprice", "totalprice", "prodprice", "amount", "listingprice", "charge", "fee"),
    "delivery_method": ("deliverymethod", "deliverytype", "servicemode", "deliverymode"),
    "refresh_frequency": ("updatefrequency", "refreshfrequency", "updatecycle", "datafrequency", "frequency"),
    "published_at": ("publishtime", "publishdate", "releasedate", "shelftime", "launchdate", "uptime", "createdat", "createtime"),
    "source_updated_at": ("updatetime", "updatedat", "updatedate", "modifytime", "lastmodified"),
    "region_raw": ("regionname", "region", "coveragearea", "servicearea", "areaName"),
    "external_id": ("productid", "goodsid", "resourceid", "proresourceid", "sceneid", "componentid", "componentcode", "productcode", "goodsCode", "dataid", "id", "uuid", "code"),
    "tags": ("tags", "taglist", "keywords", "labels"),
}
PRODUCT_TYPES = (
    ("api", ("api", "接口", "查询服务", "核验服务")),
    ("dataset", ("数据集", "数据包", "样本集", "语料库", "数据库")),
    ("report", ("数据报告", "分析报告", "研究报告", "指数报告")),
    ("model", ("模型", "算法", "评分卡", "画像")),
    ("component", ("组件", "工具", "连接器", "中间件", "软件")),
    ("application", ("应用", "解决方案", "场景服务", "平台服务")),
    ("data_service", ("数据服务", "定制服务", "咨询服务", "加工服务")),
)
INDUSTRIES = (
    ("finance", ("金融", "银行", "保险", "证券", "信贷", "征信", "基金")),
    ("healthcare", ("医疗", "医药", "健康", "医院", "医保", "疾病")),
    ("transportation", ("交通", "道路", "公路", "铁路", "航空", "出行", "车辆")),
    ("logistics", ("物流", "快递", "仓储", "供应链", "港口")),
    ("government", ("政务", "公共数据", "政府", "行政", "监管")),
    ("manufacturing", ("工业", "制造", "工厂", "设备", "机械")),
    ("agriculture", ("农业", "农村", "农产品", "种植", "养殖", "林业", "渔业")),
    ("energy", ("能源", "电力", "电网", "煤炭", "石油", "天然气", "新能源")),
    ("tourism", ("文旅", "旅游", "景区", "酒店", "文化")),
    ("education", ("教育", "学校", "高校", "教学", "培训")),
    ("commerce", ("商业", "零售", "消费", "电商", "贸易", "市场")),
    ("telecom", ("通信", "电信", "运营商", "网络")),
    ("geospatial", ("地理", "地图", "测绘", "遥感", "空间", "位置")),
    ("environment", ("环境", "气象", "生态", "碳排放", "水务", "污染")),
    ("real_estate", ("房地产", "房产", "住房", "土地", "物业")),
    ("human_resources", ("人力资源", "招聘", "人才", "就业", "社保")),
    ("legal", ("法律", "司法", "法院", "法务", "知识产权")),
    ("science", ("科研", "科学", "实验", "技术创新")),
)
CARD_CLASSES = ("product-item", "goods-item", "data-item", "scenario-item", "scene-item", r"[^\" ]*product-card[^\" ]*", r"[^\" ]*goods-card[^\" ]*")
CARD_ROUTES = r"/(?:product|goods|scenario|scene|demand|requirement)/detail/"
CARD_NAMES = ("content-title", "title-left", "scene-item-title", "special-item-title", "product-title", "goods-title", "card-title", "title")
DELIVERY = r"交付方式\s*[：:]\s*(.+?)(?=\s+(?:应用场景|所属行业|提供方|供应商)\s*[：:]|[，,；;]|$)"
RECORD_URLS = ("detailUrl", "url", "link", "productUrl")
#: Fields that make an item a commercial one.
TRADE = ("provider", "product_type_raw", "delivery_method", "price_raw")


def folded(label: str) -> str:
    """A label as ``text.key_fold`` makes it."""
    return "".join(c for c in label.lower() if c.isdigit() or "a" <= c <= "z" or "一" <= c <= "鿿")


def aliases(spark: SparkSession, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rule table: folded label, field. Of a label listed twice the last field counts. It is made from names in the code, so it is small, and carries a
    broadcast hint: Spark takes the size of such a table for unknown and would rather broadcast the rows that it is joined with."""
    rows = {folded(label): field for field, labels in names.items() for label in labels}
    return F.broadcast(spark.createDataFrame(sorted(rows.items()), "folded string, field string"))


def canonical_field(rows: DataFrame, label: str, rules: DataFrame) -> DataFrame:
    """Adds the canonical field of a label; rows with an unknown label go. The rows are never broadcast; rules are if they carry that hint
    (``aliases``), which goes before the merge hint, else both are sorted and merged."""
    return rows.withColumn("folded", T.key_fold(F.col(label))).hint("merge").join(rules, "folded").drop("folded")


def plain(html: Column) -> Column:
    """Text of a piece of a page."""
    return T.squeezed(T.unescaped(F.regexp_replace(html, r"(?s)<[^>]*>", " ")))


def class_text(html: Column, name: str) -> Column:
    """Text of the first element of a class."""
    return plain(F.regexp_extract(html, rf'(?is)<(\w+)\b[^>]*\bclass="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</\1>', 2))


def labelled_pairs(text: Column, nodes: Column) -> Column:
    """All pairs (label, value, locator, place) of a page's tree: table cells two by two, each dt with the next dd beside it, texts with a colon, and
    elements of a label class with what stands behind them."""
    none = "array<struct<label:string,value:string,locator:string,place:struct<branch:int,at:int,nth:int>>>"
    inner = lambda n: TR.text_of(text, n)

    def pair(label: Column, value: Column, locator: str, behind: str, branch: int, at: Column, nth: Column) -> Column:
        named = F.concat(F.lit(f"{locator}["), at.cast("string"), F.lit(f"]{behind}"))
        return F.struct(label.alias("label"), value.alias("value"), named.alias("locator"), F.struct(F.lit(branch).alias("branch"), at.cast("int").alias("at"), nth.cast("int").alias("nth")).alias("place"))

    def row(tr: Column, at: Column) -> Column:
        cells = F.transform(F.filter(TR.below(nodes, tr["at"], tr["node"]), lambda c: (c["parent"] == tr["at"]) & c["tag"].isin("td", "th")), inner)
        twos = F.zip_with(cells, F.slice(cells, F.lit(2), F.size(cells)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.filter(F.transform(twos, lambda c, k: pair(c["a"], c["b"], "table tr", "", 0, at, k)), lambda p: (p["place"]["nth"] % 2 == 0) & p["value"].isNotNull())

    tables = F.flatten(F.transform(TR.numbered(nodes, lambda n: n["tag"] == "tr"), row))
    lists = F.transform(TR.numbered(nodes, lambda n: n["tag"] == "dt"), lambda x, at: pair(inner(x["node"]), inner(F.get(nodes, x["node"]["dd"])), "dl dt", "+dd", 1, at, x["node"]["dd"]))

    def spoken(x: Column, at: Column) -> Column:
        t = inner(x["node"])
        return pair(F.regexp_extract(t, "^([^:：]*)[:：]", 1), F.regexp_extract(t, "(?s)^[^:：]*[:：](.*)$", 1), "text-pair", "", 2, at, F.length(t))

    told = TR.numbered(nodes, lambda n: n["tag"].isin("li", "p") | (n["tag"] == "div") & TR.has_class(n, "form-item", "info-item", "detail-item"))
    colons = F.filter(F.transform(told, spoken), lambda p: (p["label"] != "") & (F.length(p["label"]) <= 24) & (p["place"]["nth"] > 2) & (p["place"]["nth"] <= 600))
    marked = TR.numbered(nodes, lambda n: F.coalesce(n["classes"].rlike("[lL]abel"), F.lit(False)))
    beside = F.transform(marked, lambda x, at: pair(inner(x["node"]), inner(F.get(nodes, x["node"]["next"])), "class-label", "", 3, at, x["node"]["next"]))
    good = lambda p: (p["place"]["branch"].isin(0, 2)) | (p["place"]["nth"] >= 0)
    return F.filter(F.concat(*[a.cast(none) for a in (tables, lists, colons, beside)]), good)


def labelled_fields(pages: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """(key, field, value, locator): the longest value of each known field of a page, of equal ones the first."""
    trees = TR.parsed(pages, [key])
    pairs = trees.select(key, F.explode(labelled_pairs(F.col("text"), F.col("nodes"))).alias("p")).select(key, F.regexp_replace(T.normalize_text(F.col("p.label")), "[:：]+$", "").alias("label"), T.normalize_text(F.col("p.value")).alias("value"), "p.locator", "p.place")
    fits = pairs.where("value <> '' and value <> label and length(value) <= 10000")
    order = F.struct(F.length("value"), -F.col("place.branch"), -F.col("place.at"), -F.col("place.nth"))
    best = canonical_field(fits, "label", rules).groupBy(key, "field").agg(F.max_by(F.struct("value", "locator"), order).alias("v"))
    return best.select(key, "field", "v.value", "v.locator")


def field_map(fields: DataFrame, key: str) -> DataFrame:
    """(key, fields): a map of the at most fourteen fields of each row."""
    return fields.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def product_type(raw: Column, context: Column, groups=PRODUCT_TYPES) -> Column:
    """(value, confidence): the first keyword group that raw value or context holds; surer with a raw value."""
    raw = F.coalesce(raw, F.lit(""))
    value = X.keyword_class(F.concat_ws(" ", raw, context), groups)
    return F.struct(value.alias("value"), F.when(value == "other", 0.4).when(raw != "", 0.96).otherwise(0.75).alias("confidence"))


def industries(text: Column, groups=INDUSTRIES) -> Column:
    """Array of (value, confidence, hits): every group with a keyword in the text."""
    hits = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    found = F.filter(F.array(*[F.struct(F.lit(g).alias("value"), hits(w).alias("hits")) for g, w in groups]), lambda s: F.size(s.hits) > 0)
    sure = lambda n: F.round(F.least(0.65 + 0.08 * n, F.lit(0.95)), 4)
    return F.transform(found, lambda s: F.struct(s.value.alias("value"), sure(F.size(s.hits)).alias("confidence"), F.array_join(s.hits, "/").alias("hits")))


def dimensions(items: DataFrame, type_groups=PRODUCT_TYPES, industry_groups=INDUSTRIES) -> DataFrame:
    """``items`` (kind, name, description, fields, province, city) with product_type, type_confidence and the array ``dimensions``
    of (type, raw, value, confidence, method). Blank values give no dimension."""
    field = lambda n: F.coalesce(F.col("fields")[n], F.lit(""))
    kind = product_type(field("product_type_raw"), F.concat_ws(" ", "kind", "name", F.substring("description", 1, 600)), type_groups)
    rows = items.withColumns({"__type": kind, "__industries": industries(F.concat_ws(" ", field("industry_raw"), "name", F.substring("description", 1, 1000)), industry_groups)})

    def dim(kind: str, raw: Column, value: Column, confidence, method) -> Column:
        lit = lambda c: c if isinstance(c, Column) else F.lit(c)
        return F.struct(F.lit(kind).alias("type"), raw.alias("raw"), value.alias("value"), lit(confidence).alias("confidence"), lit(method).alias("method"))

    own = lambda name, method, sure: dim(name, field(name), field(name), sure, method)
    of = F.transform("__industries", lambda i: dim("industry", F.when(field("industry_raw") != "", field("industry_raw")).otherwise(i.hits), i.value, i.confidence, F.when(field("industry_raw") != "", "source+rule").otherwise("rule")))
    single = F.array(
        dim("product_type", field("product_type_raw"), F.col("__type.value"), F.col("__type.confidence"), F.when(field("product_type_raw") != "", "source").otherwise("rule")),
        dim("platform_province", F.col("province"), F.col("province"), 1.0, "registry"),
        dim("platform_city", F.col("city"), F.col("city"), 1.0, "registry"),
        dim("coverage_region", field("region_raw"), field("region_raw"), 0.95, "source"),
        own("delivery_method", "source", 0.95),
        own("refresh_frequency", "source", 0.95),
    )
    every = F.filter(F.concat(single, of), lambda d: F.coalesce(d.value, F.lit("")) != "")
    return rows.withColumns({"product_type": F.col("__type.value"), "type_confidence": F.col("__type.confidence"), "dimensions": every}).drop("__type", "__industries")


def item_confidence(score: Column) -> Column:
    return F.least(F.greatest(score / 10.0, F.lit(0.0)), F.lit(0.99))


def cards(pages: DataFrame, key: str, site_rules: tuple = ()) -> DataFrame:
    """(key, place, url, name, external_id, description, provider, delivery_method, kind, confidence) of the cards of listing pages: one for each target
    URL of a page. ``site_rules``: (host, route, classes, prefix) of sites whose cards have no link; their cards are named by prefix and
    name. Cards, their first links, titles and providers are nodes of the page's tree, so a card may hold others."""
    url, text, nodes = F.col("url"), F.col("text"), F.col("nodes")
    listing = U.any_of(F.lower(F.concat_ws(" ", T.element(F.col("html"), "title"), url)), U.TARGET_TERMS)
    found = TR.with_classes(nodes, CARD_CLASSES)
    more, prefix = F.array().cast(f"array<struct<at:int,node:struct<{TR.NODE}>>>"), F.lit("")
    for host, route, classes, name in site_rules:
        here = (U.host(url) == host) & F.lower(U.part(url, 4)).endswith(route)
        more = F.when(here, TR.with_classes(nodes, classes)).otherwise(more)
        prefix, listing = F.when(here, name).otherwise(prefix), listing | here
    anchors = TR.numbered(nodes, lambda n: (n["tag"] == "a") & F.coalesce(n["href"].rlike(CARD_ROUTES), F.lit(False)))

    def card(x: Column) -> Column:
        n, inside = x["node"], TR.below(nodes, x["at"], x["node"])
        first = lambda good: F.get(F.filter(inside, lambda c: ~c["hidden"] & good(c)), 0)
        link = F.when((n["tag"] == "a") & n["href"].isNotNull(), n["href"]).otherwise(F.get(F.filter(inside, lambda c: (c["tag"] == "a") & c["href"].isNotNull()), 0)["href"])
        title = first(lambda c: TR.has_class(c, *CARD_NAMES) | c["tag"].isin("h2", "h3", "h4"))
        maker = first(lambda c: TR.has_class(c, "product-org") | F.coalesce(F.contains(c["classes"], F.lit("provider")), F.lit(False)))
        return F.struct(F.trim(F.coalesce(link, F.lit(""))).alias("href"), TR.text_of(text, n).alias("text"), TR.text_of(text, title).alias("title"), F.coalesce(TR.text_of(text, maker), F.lit("")).alias("provider"))

    own = pages.where(listing).select(key, "url", prefix.alias("prefix"), "html")
    trees = TR.parsed(own, [key, "url", "prefix"])
    rows = trees.select(key, "url", "prefix", F.posexplode(F.transform(F.concat(found, more, anchors), card)).alias("place", "card")).select(key, "url", "place", "prefix", "card.*")
    rows = settled(rows.where("href <> '' or prefix <> ''"), {"to": F.when(F.col("href") != "", U.resolved(url, F.col("href"))).otherwise(url)})
    rows = settled(rows, {"target": U.canonical_url(F.col("to")), "linked": F.col("href") != "", "text": T.normalize_text(F.col("text")), "title": T.normalize_text(F.col("title")), "provider": T.normalize_text(F.col("provider"))}).drop("to", "href")
    rows = rows.withColumn("name", F.coalesce("title", "text")).where(F.col("target") != "")
    external = F.when(F.col("linked"), U.external_id(F.col("target"))).otherwise(F.concat_ws(":", "prefix", "name"))
    rows = settled(rows, {"external_id": external}).withColumn("own", F.when(F.col("linked"), F.col("target")).otherwise(F.col("external_id")))
    first = F.row_number().over(Window.partitionBy(key, "own").orderBy("place"))
    delivery = T.squeezed(F.regexp_extract("text", DELIVERY, 1))
    kind = X.item_kind(F.col("target"), F.concat_ws(" ", "target", "name", F.substring("text", 1, 1500)))
    return rows.withColumn("nth", first).where((F.col("nth") == 1) & X.usable_name(F.col("name"))).select(key, "place", F.col("target").alias("url"), "name", "external_id", T.snippet(F.col("text"), 2000).alias("description"), "provider", delivery.alias("delivery_method"), kind.alias("kind"), F.lit(0.6).alias("confidence"))


def card_evidence(cards: DataFrame, key: str) -> DataFrame:
    """(key, place, field, value, locator, method, confidence): what name and provider of each card rest on; a blank provider rests on nothing."""
    at = F.concat(F.lit("catalog-card["), F.col("place").cast("string"), F.lit("]"))
    row = lambda field, locator, sure: F.struct(F.lit(field).alias("field"), F.col(field).alias("value"), locator.alias("locator"), F.lit("rule").alias("method"), F.lit(sure).alias("confidence"))
    each = F.filter(F.array(row("name", at, 0.75), row("provider", F.concat(at, F.lit(".provider")), 0.70)), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return cards.select(key, "place", F.explode(each).alias("e")).select(key, "place", "e.*")


def rendered(value) -> str:
    return json.dumps(value, ensure_ascii=False) if isinstance(value, (dict, list)) else str(value)


#: Keys whose values may be objects or lists that count as a value: those of the fields above, folded.
NESTED = frozenset(folded(k) for names in JSON_KEYS.values() for k in names)


def walk(text: str | None, nested: frozenset[str] = NESTED) -> list[tuple[str, list[tuple[str, str | None, bool]]]]:
    """(path, [(key, value as text, is a string)]) of every object in a JSON text, outer before inner, in the order of the text;
    blank values are null, and so are objects and lists under keys that are not among ``nested``. A text that is no JSON, or nested too deeply to be
    read, gives nothing."""
    try:
        todo, out = [("$", json.loads(text or ""))], []
    except (ValueError, RecursionError):
        return []

    def shown(key: str, value) -> str | None:
        if value in (None, "", [], {}):
            return None
        if isinstance(value, (dict, list)):
            if folded(key) not in nested:
                return None
            try:
                return rendered(value)
            except RecursionError:
                return None
        return str(value)

    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            out.append((path, [(k, shown(k, v), isinstance(v, str)) for k, v in value.items()]))
            todo += [(f"{path}.{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(f"{path}[{k}]", v) for k, v in reversed(list(enumerate(value)))]
    return out


def json_records(rows: DataFrame, key: str, column: str, nested: frozenset[str] = NESTED) -> DataFrame:
    """(key, nth, path, entries): every object in a JSON column. Spark's own variants lose the order of keys, on which the first
    of several names of a field depends; so a small function walks the texts of Arrow batches, a quarter of a megabyte at a time: objects in Python take tens of times the text's room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in TR.in_chunks(batches, 1):
            at, nth, path, ends, flat = [], [], [], [0], ([], [], [])
            for i, t in enumerate(b.column(1)):
                for n, (p, entries) in enumerate(walk(t.as_py(), nested)):
                    at.append(i)
                    nth.append(n)
                    path.append(p)
                    ends.append(ends[-1] + len(entries))
                    for into, values in zip(flat, zip(*entries, strict=True), strict=False):
                        into.extend(values)
            columns = [pa.array(c, t) for c, t in zip(flat, (pa.string(), pa.string(), pa.bool_()), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["key", "value", "is_text"]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(nth, pa.int64()), pa.array(path, pa.string()), lists], [key, "nth", "path", "entries"])

    own = rows.select(key, F.col(column).cast("string"))
    return own.mapInArrow(run, f"{key} {own.schema[key].dataType.simpleString()}, nth long, path string, entries array<struct<key:string,value:string,is_text:boolean>>")


def json_fields(records: DataFrame, key: str, rules: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, nth, field, value, locator): the first non-blank value of each known field of a record, of 20,000 characters at most; ``carried`` names columns
    of the records to be kept."""
    each = records.select(key, "nth", *carried, F.posexplode("entries").alias("at", "e")).where("e.value is not null and length(e.value) <= 20000")
    found = canonical_field(each.select(key, "nth", *carried, "at", F.col("e.key").alias("label"), "e.value"), "label", rules)
    first = found.groupBy(key, "nth", "field").agg(F.min_by(F.struct("value", "label"), "at").alias("v"), *[F.any_value(c).alias(c) for c in carried])
    return first.select(key, "nth", "field", "v.value", F.concat(F.lit("json."), "v.label").alias("locator"), *carried)


def json_items(rows: DataFrame, key: str, url: str, column: str, rules: DataFrame) -> DataFrame:
    """(key, nth, url, name, external_id, kind, score, fields) of the records that are items: a usable name and, unless the URL says
    so, two supporting fields; of records with one id and name the first. Texts are walked once: a record's links go with its fields."""
    links = F.transform(F.array(*map(F.lit, RECORD_URLS)), lambda n: F.try_element_at(F.filter("entries", lambda e: (e.key == n) & e.is_text), F.lit(1)).value)
    records = json_records(rows, key, column).withColumn("links", F.filter(links, lambda v: v.isNotNull()))
    found = json_fields(records, key, rules, ("links",))
    names = found.groupBy(key, "nth").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"), F.any_value("links").alias("links"))
    rows = rows.select(key, url).join(names.hint("merge"), key)
    field = lambda n: F.coalesce(F.col("fields")[n], F.lit(""))
    page = F.col(url)
    rows = settled(rows, {"name": T.normalize_text(field("name")), "external_id": T.normalize_text(field("external_id")), "listed": U.any_of(F.lower(page), U.TARGET_TERMS)})
    support = F.size(F.filter(F.map_keys("fields"), lambda f: ~f.isin("name", "description", "external_id")))
    rows = rows.where((F.col("name") != "") & (F.length("name") <= 300) & ~F.col("name").isin(*X.GENERIC_NAMES) & (F.col("listed") | (support >= 2)))
    first = F.row_number().over(Window.partitionBy(key, "external_id", "name").orderBy("nth"))
    rows = rows.withColumn("order", first).where("order = 1").drop("order")
    targets = F.filter(F.transform("links", lambda h: U.resolved(page, h)), lambda u: u.rlike(r"^(?i)https?://[^/?#]"))
    rows = settled(rows, {"to": F.coalesce(F.try_element_at(targets, F.lit(1)), F.lit(""))})
    rows = settled(rows, {"target": U.canonical_url(F.col("to"))})
    has = F.map_contains_key("fields", F.lit("name"))
    trade = F.arrays_overlap(F.map_keys("fields"), F.array(*map(F.lit, TRADE)))
    score = X.item_score(page, F.col("name"), F.size("fields"), has, trade) + F.when(F.col("listed"), 1.5).otherwise(0.0)
    kind = X.item_kind(page, F.concat_ws(" ", page, "name", F.substring(field("description"), 1, 1500)))
    return rows.select(key, "nth", F.when(F.col("target") != "", F.col("target")).otherwise(page).alias("url"), "name", "external_id", kind.alias("kind"), F.greatest(score, F.lit(5.0)).alias("score"), "fields")

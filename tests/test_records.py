"""Literal pages and responses: fields, kinds, cards, JSON records, types and industries."""

import json

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import url as U
from strataloom.operators import extract as X
from strataloom.operators import records as R

DETAIL = """<html><head><title>企业信用查询接口 - 数据产品</title><meta content="面向金融机构的企业信用信息查询服务接口" property="og:description"></head><body>
<script>var label = "产品名称：错误";</script><h1>企业信用查询接口</h1>
<table><tr><th>产品名称</th><td>企业信用查询接口</td><th>提供单位</th><td>甲数据公司</td></tr><tr><td>所属行业：</td><td>金融</td></tr></table>
<dl><dt>交付方式</dt><dd>API</dd></dl><ul><li>更新频率：每日</li><li>简介：短</li></ul><p>产品简介：一个较长的产品简介</p>
<span class="form-label">产品编号</span><span>A-1</span></body></html>"""


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


def test_labelled_fields_of_a_page(spark):
    pages = spark.createDataFrame([(1, DETAIL), (2, None), (3, "<p>no label</p>")], "id long, html string")
    got = {r.field: (r.value, r.locator) for r in R.labelled_fields(pages, "id", R.aliases(spark, R.LABELS)).collect() if r.id == 1}
    assert got["name"] == ("企业信用查询接口", "table tr[0]") and got["provider"][0] == "甲数据公司" and got["industry_raw"] == ("金融", "table tr[1]")
    assert got["delivery_method"] == ("API", "dl dt[0]+dd") and got["refresh_frequency"] == ("每日", "text-pair[0]")
    assert got["description"] == ("一个较长的产品简介", "text-pair[2]") and got["external_id"] == ("A-1", "class-label[0]")


def test_names_and_descriptions(spark):
    name = lambda html: one(spark, X.item_name(F.lit(None).cast("string"), F.lit(html)))
    assert name("<h1>首页</h1><div class='x'></div><b class=\"big detail-title\">Real name</b>") == "Real name"
    assert name('<div class="title"><i></i><h2>Under</h2></div><title>T | x</title>') == "Under" and name("<title>Only this - site</title>") == "Only this"
    assert one(spark, X.description(F.lit(DETAIL))) == "面向金融机构的企业信用信息查询服务接口"
    assert one(spark, X.description(F.lit("<p>outside the article, but a long one</p><article><p>" + "inside " * 5 + "</p></article>"))) == ("inside " * 5).strip()
    assert one(spark, X.description(F.lit(DETAIL), F.lit("given"))) == "given"


def test_gate(spark):
    gate = lambda url, score, named: one(spark, X.admitted(F.lit(url), F.lit(score), F.lit(named)))
    assert gate("https://h.org/product/detail/1", 3.0, False) and not gate("https://h.org/a", 4.4, True) and gate("https://h.org/a", 4.5, False)
    assert not gate("https://h.org/list", 9.0, False) and gate("https://h.org/list", 9.0, True) and not gate("https://h.org/product/", 9.0, False)


def test_cards(spark):
    html = """<title>数据产品</title><div class="product-item hot"><h3>Alpha</h3><a href="/product/detail/11">x</a><i class="the-provider-name">Maker</i> 交付方式：API 所属行业：金融</div>
    <div class="product-item"><h3>更多</h3><a href="/product/detail/12">x</a></div></main><a href="/goods/detail/13?id=13">Gamma data</a><a href="/product/detail/11">again</a>"""
    pages = spark.createDataFrame([(1, "https://h.org/market", html), (2, "https://h.org/news", html.replace("数据产品", "news"))], "id long, url string, html string")
    got = {r.external_id: r for r in R.cards(pages, "id").collect()}
    assert set(got) == {"", "13"} and got["13"].name == "Gamma data"
    assert (got[""].name, got[""].provider, got[""].delivery_method, got[""].kind, got[""].url) == ("Alpha", "Maker", "API", "product", "https://h.org/product/detail/11")
    site = spark.createDataFrame([(1, "https://www.site.org/hall", '<div class="card-box"><b class="title">One</b></div><div class="card-box"><b class="title">Two</b></div><div class="card-box"><b class="title">One</b></div>')], "id long, url string, html string")
    got = R.cards(site, "id", (("www.site.org", "/hall", ("card-box",), "site"),)).collect()
    assert sorted(r.external_id for r in got) == ["site:One", "site:Two"]


def test_json_items(spark):
    body = json.dumps({"data": {"records": [{"productId": "p1", "productName": "交通数据集", "productType": "数据集", "industryName": "交通", "providerName": "乙", "publishTime": "2026-01-02", "detailUrl": "/d/1"}, {"id": 2, "name": "bare"}, {"x": 1}]}}, ensure_ascii=False)
    rows = spark.createDataFrame([(1, "https://h.org/v1", body), (2, "https://h.org/catalog", body), (3, "https://h.org/v1", "no json"), (4, "u", None)], "id long, url string, body string")
    got = R.json_items(rows, "id", "url", "body", R.aliases(spark, R.JSON_KEYS)).collect()
    assert sorted((r.id, r.external_id) for r in got) == [(1, "p1"), (2, "2"), (2, "p1")]
    first = next(r for r in got if r.id == 1)
    assert first.url == "https://h.org/d/1" and first.fields["published_at"] == "2026-01-02" and abs(first.score - 9.0) < 1e-9
    assert [p for p, _ in R.walk('{"a": [{"b": 1}, 2], "c": {}}')] == ["$", "$.a[0]", "$.c"] and R.walk("{") == []


def test_types_and_industries(spark):
    kind = lambda raw, context: tuple(one(spark, R.product_type(F.lit(raw), F.lit(context))))
    assert kind("API接口", "") == ("api", 0.96) and kind("", "一个模型") == ("model", 0.75) and kind(None, "none") == ("other", 0.4)
    got = one(spark, R.industries(F.lit("银行与医院的医保数据")))
    assert [(r.value, r.confidence, r.hits) for r in got] == [("finance", 0.73, "银行"), ("healthcare", 0.81, "医院/医保")]


def test_urls(spark):
    url = lambda u: one(spark, U.canonical_url(F.lit(u)))
    assert url("http://h.org/x?a=100%") == "http://h.org/x?a=100%25" and url("http://h.org/x?a=%zz&b=1") == "http://h.org/x?a=%25zz&b=1"
    assert url("http://Bücher.de/") == "http://xn--bcher-kva.de/" and url("http://h.org/?q=a+b&q=%E4%BD%A0") == "http://h.org/?q=a+b&q=%E4%BD%A0"
    allowed = lambda h: one(spark, U.host_allowed(F.lit(h), ("example.org", "a.b.c")))
    assert allowed("example.org") and allowed("www.example.org") and allowed("x.a.b.c") and not allowed("notexample.org") and not allowed("b.c")
    public = {h: one(spark, U.public_literal(F.lit(h))) for h in ("", "localhost", "127.0.0.1", "10.1.2.3", "172.31.0.1", "172.32.0.1", "8.8.8.8", "198.18.0.1", "100.64.0.1", "[::1]", "fd00::1", "2606:4700::1", "h.org")}
    assert {h for h, ok in public.items() if ok} == {"172.32.0.1", "8.8.8.8", "2606:4700::1", "h.org"}


def test_pages_that_are_applications(spark):
    app = lambda html, url="https://h.org/": one(spark, U.looks_like_app(F.lit(html), F.lit(url), F.lit("text/html")))
    shell = '<div id="app"></div><script src="a"></script><script src="b"></script>'
    assert app(shell) and not app(shell + "word " * 300) and app(shell + "word " * 300 + "__NEXT_DATA__") and not app("<p>plain</p>") and app("<p>plain</p>", "https://h.org/#/list")


def test_totals_charsets_and_nested_masks(spark):
    total = lambda t, u="https://h.org/product", r="detail": one(spark, T.declared_total(F.lit(t), F.lit(u), F.lit(r)))
    assert total("数据产品 共 1,234 条") == 1234 and total("共 5 个") is None and total("产品 共 5 个", "https://h.org/news") is None and total("产品 共 5 个", "https://h.org/news", "listing") == 5
    assert total("产品" + "-" * 90 + "共 5 个") is None
    rows = spark.createDataFrame([(bytearray("数据 é".encode()), None), (bytearray("数据".encode("gb18030")), None), (bytearray("数据".encode("gbk")), "GBK"), (bytearray("é".encode("latin-1")), "iso-8859-1")], "body binary, charset string")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        assert [r[0] for r in rows.select(T.decoded(F.col("body"), F.col("charset"))).collect()] == ["数据 é", "数据", "数据", "é"]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")


def test_links_in_either_quotes(spark):
    html = """<a class=x href='/a?b=1&amp;c=2'>One's</a> <A HREF = "it's">Two</A> <a href="/a?c=2&b=1">again</a> <a name="x">none</a>"""
    pages = spark.createDataFrame([(1, "https://h.org/d/", html), (2, "https://h.org/", None)], "page_id int, url string, html string")
    assert [(r.place, r.to_url, r.anchor) for r in X.links(pages).orderBy("place").collect()] == [(0, "https://h.org/a?b=1&c=2", "One's"), (1, "https://h.org/d/it's", "Two")]


def test_rules_are_broadcast_and_rows_never(spark):
    rows = spark.range(100).select("id", F.concat(F.lit("产品名称"), F.repeat(F.lit("："), (F.col("id") % 2).cast("int"))).alias("label"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    own = R.canonical_field(rows, "label", R.aliases(spark, R.LABELS))
    assert "Inner, BuildRight" in plan(own) and own.where("field = 'name'").count() == 100
    given = R.canonical_field(rows, "label", spark.createDataFrame([("产品名称", "x")], "folded string, field string"))
    assert "SortMergeJoin" in plan(given) and "BroadcastHashJoin" not in plan(given) and given.where("field = 'x'").count() == 100


def test_texts_are_walked_a_quarter_of_a_megabyte_at_a_time():
    import pyarrow as pa

    from strataloom.operators import tree as TR

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(["x" * 1000] * 1999 + ["y" * 600_000])], ["id", "body"])
    parts = list(TR.in_chunks(iter([batch]), 1))
    assert sum(p.num_rows for p in parts) == 2000 and all(p.num_rows <= 262 for p in parts) and parts[-1].num_rows == 1

"""Trees of pages, labels, cards, free JSON, charsets, addresses: cases on literal rows."""

import ipaddress
import json

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import url as U
from strataloom.operators import extract as X
from strataloom.operators import records as R
from strataloom.operators import tree as TR

PAGE = """<html><body><table><tr><td>产品名称</td><td>甲乙<table><tr><td>x</td></tr></table></td><td>提供方</td><td>某公司</td></tr></table>
<dl><dt>更新频率<span>:</span></dt><p>aside</p><dd>每日<dt>价格</dt><dd>免费</dl>
<div class='info-item other'>交付方式：API <b>接口</b></div><SPAN CLASS=fieldLabel>所属行业</SPAN><em>金融</em>
<noscript><p>机构名称：hidden</p></noscript><script>var a = "<p>描述：no</p>";</script><!-- <li>标签：no</li> --></body>"""


def fields(spark, html):
    pages = spark.createDataFrame([(1, html)], "id int, html string")
    return {r.field: (r.value, r.locator) for r in R.labelled_fields(pages, "id", R.aliases(spark, R.LABELS)).collect()}


def test_labels_of_nested_and_loose_markup(spark):
    assert fields(spark, PAGE) == {
        "name": ("甲乙 x", "table tr[0]"), "provider": ("某公司", "table tr[0]"), "refresh_frequency": ("每日", "dl dt[0]+dd"), "price_raw": ("免费", "dl dt[1]+dd"),
        "delivery_method": ("API 接口", "text-pair[1]"), "industry_raw": ("金融", "class-label[0]"),
    }
    assert fields(spark, None) == fields(spark, "") == fields(spark, "<<>< no <tags") == {}


def test_trees():
    text, nodes = TR.tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<div>f</div></b>g &amp; h<br/>i")
    assert text == "a b c d e f g & h i" and [n[0] for n in nodes] == ["ul", "li", "li", "ul", "li", "li", "p", "div", "br"]
    parent, last, following = ([n[k] for n in nodes] for k in (3, 4, 5))
    assert parent == [-1, 0, 0, 2, 3, 0, -1, -1, -1] and last == [5, 1, 4, 4, 4, 5, 6, 7, 8] and following == [6, 2, 5, -1, -1, -1, 7, 8, -1]
    assert [text[n[7] : n[8]] for n in nodes[:8]] == ["a b c d", "a", "b c", "c", "c", "d", "e", "f"]
    text, nodes = TR.tree("<table><tr><td>1<table><tr><td>2</table><td>3<tr><td>4</table>")
    assert [n[3] for n in nodes if n[0] == "td"] == [1, 4, 1, 7] and text == "1 2 3 4"
    deep = TR.tree("<div>" * 30_000 + "x")
    assert len(deep[1]) == 30_000 and deep[1][0][4] == 29_999
    assert TR.tree('<a href="x>y" class=\'p q\'>z')[1][0][:3] == ["a", "p q", "x>y"]


def test_cards_within_cards_and_their_evidence(spark):
    html = """<title>数据产品</title><div class='product-item'><h3>外层产品</h3><div class="big product-card-x"><a href=/product/detail/7?id=7>进入</a><h2>内层产品</h2>
    <span class="my-provider">乙公司</span> 交付方式：API，等</div></div><div class=goods-item><a href='/goods/detail/8'><b class=title>第三个产品</b></a></div><div class="product-item">没有链接的</div>"""
    pages = spark.createDataFrame([(1, "https://h.org/list", html)], "id int, url string, html string")
    cards = R.cards(pages, "id").cache()
    got = {r.url: (r.name, r.provider, r.delivery_method, r.place) for r in cards.collect()}
    assert got == {"https://h.org/product/detail/7?id=7": ("外层产品", "乙公司", "API", 0), "https://h.org/goods/detail/8": ("第三个产品", "", "", 2)}
    evidence = sorted(map(tuple, R.card_evidence(cards, "id").select("field", "value", "locator", "confidence").collect()))
    assert evidence == [("name", "外层产品", "catalog-card[0]", 0.75), ("name", "第三个产品", "catalog-card[2]", 0.75), ("provider", "乙公司", "catalog-card[0].provider", 0.7)]


def test_links_in_any_quotes(spark):
    pages = spark.createDataFrame([(1, "https://h.org/a/", "<a href=/x>one</a> <a class=c href='y?b=2&amp;a=1'>two</a> <A HREF=\"/x\">again</A> <a name=n>no</a>")], "page_id int, url string, html string")
    assert sorted((r.to_url, r.anchor) for r in X.links(pages).collect()) == [("https://h.org/a/y?a=1&b=2", "two"), ("https://h.org/x", "one")]
    plan = X.links(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 30_000, "a long expression is repeated"


def test_no_json_stops_a_job(spark):
    bodies = ["[" * 20_000 + "]" * 20_000, '{"a":' * 20_000 + "1" + "}" * 20_000, "{", "", None, '{"productName":"n","nested":{"title":"t"},"orgName":{"title":"o"}}']
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    got = R.json_records(rows, "id", "body").collect()
    assert {r.id for r in got} == {5} and [r.path for r in sorted(got, key=lambda r: r.nth)] == ["$", "$.nested", "$.orgName"]
    first = {e.key: e.value for e in got[0].entries} if got[0].nth == 0 else None
    assert first == {"productName": "n", "nested": None, "orgName": '{"title": "o"}'}


def test_string_values_of_free_json_are_masked(spark):
    mail, number = "someone@example.org", "13812345678"
    value = {mail: [mail, {"n": 13812345678, number: f"call {number}", "q": 'a"\\ é ' + mail}], "e": "", "t": True, "long": "x" * 200_000}
    texts = [json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1), '{"m":"someone\\u0040example.org"}', f"no json {mail}", None, '"' + mail + '"', "{}"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(T.redact_json(F.col("t"))).collect()]
    want = {mail: ["so***@example.org", {"n": 13812345678, number: "call 138****5678", "q": 'a"\\ é so***@example.org'}], "e": "", "t": True, "long": "x" * 200_000}
    assert json.loads(got[0]) == json.loads(got[1]) == want and got[0].index('"n"') > 0 and json.loads(got[2]) == {"m": "so***@example.org"}
    assert got[3:] == ["no json so***@example.org", None, '"so***@example.org"', "{}"]


def test_any_bytes_are_read(spark):
    cases = [(b"abc\xff\xff", None, "abc��"), (b"ok\x80z", None, "ok\ufffdz"), ("日本語".encode("shift_jis"), "Shift_JIS", "日本語"), ("繁體字".encode("big5"), "big5", "繁體字"), ("数据".encode("gb18030"), None, "数据"), ("数据".encode(), "nonsense", "数据"), ("é".encode("latin-1"), "ISO-8859-1", "é"), ("数据".encode(), "ascii", "数据"), (b"", None, ""), (None, "utf-8", None)]
    rows = spark.createDataFrame([(k, bytearray(b) if b is not None else None, d) for k, (b, d, _) in enumerate(cases)], "k int, body binary, declared string")
    got = [r[0] for r in rows.orderBy("k").select(T.decoded(F.col("body"), F.col("declared"))).collect()]
    want = [w for *_, w in cases]
    assert got == want


def test_addresses_by_number(spark):
    names = ["::1", "0:0:0:0:0:0:0:1", "::", "::ffff:10.0.0.1", "::ffff:7f00:1", "::ffff:8.8.8.8", "2001::1", "2001:1::1", "2001:20::5", "2002:a00:1::1", "2001:db8::1", "fc00::1", "fdff::", "fe80::1%eth0", "febf::1", "fec0::1", "64:ff9b::808:808", "64:ff9b:1::1", "3fff:1000::1", "2606:4700::1111", "FF02::1", "100::1", "8.8.8.8", "10.1.2.3", "192.0.0.9", "172.32.0.1", "169.254.1.1", "1::2:3:4:5:6:7:8"]
    df = spark.createDataFrame([(n,) for n in [*names, "3fff::1", "[::1]", "[2606:4700::1111]", "localhost", "", "example.org", "1:2:3", "12345::1", "1::2::3", ":::", None]], "h string")
    got = {r.h: r.p for r in df.select("h", U.public_literal(F.col("h")).alias("p")).collect()}
    assert {n: got[n] for n in names} == {n: ipaddress.ip_address(n).is_global for n in names if n != "1::2:3:4:5:6:7:8"} | {"1::2:3:4:5:6:7:8": False}
    assert [got[n] for n in ("3fff::1", "[::1]", "[2606:4700::1111]", "localhost", "", "example.org", "1:2:3", "12345::1", "1::2::3", ":::", None)] == [False, False, True, False, False, True, False, False, False, False, False]
    hosts = spark.createDataFrame([("https://[::1]:80/x",), ("http://u@[2606:4700::1111]/",)], "u string").select(U.host(F.col("u"))).collect()
    assert [r[0] for r in hosts] == ["[::1]", "[2606:4700::1111]"]

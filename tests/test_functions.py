"""Literal cases of the scalar functions and of versioning."""

from pyspark.sql import functions as F

from strataloom.functions import text as T
from strataloom.functions import url as U
from strataloom.operators import extract as X
from strataloom.operators import versioning as V


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


def test_canonical_url(spark):
    cases = {
        "HTTPS://Example.com:443//a//b?b=2&a=1&utm_source=x#top": "https://example.com/a/b?a=1&b=2",
        "http://example.com": "http://example.com/",
        "http://example.com:8080/x?q=a b": "http://example.com:8080/x?q=ab",
        "https://example.com/app#/route/1": "https://example.com/app#/route/1",
        "ftp://example.com/": "",
        "mailto:a@b.c": "",
    }
    for url, want in cases.items():
        assert one(spark, U.canonical_url(F.lit(url))) == want


def test_resolve_dot_segments(spark):
    assert one(spark, U.resolved(F.lit("https://h.org/a/b/c.html?x=1"), F.lit("../d"))) == "https://h.org/a/d"


def test_family_and_external_id(spark):
    assert one(spark, U.family(F.lit("www.data.gov.cn"))) == "data.gov.cn"
    assert one(spark, U.family(F.lit("a.b.example.org"))) == "example.org"
    assert one(spark, U.external_id(F.lit("https://h.org/p?goodsId=7&id=3"))) == "7"
    assert one(spark, U.external_id(F.lit("https://h.org/p/abcdef12"))) == "abcdef12"


def test_redact(spark):
    assert one(spark, T.redact(F.lit("mail alice@example.com, call 13812345678, id 110101199003071234."))) == "mail al***@example.com, call 138****5678, id 110101********1234."


def test_normalize_and_dates(spark):
    assert one(spark, T.normalize_text(F.lit("ＡＢ  c　访问量：12 d"))) == "AB c d"
    assert str(one(spark, T.parse_datetime(F.lit("发布 2024年3月5日 12:00")))) == "2024-03-05 00:00:00"
    assert one(spark, T.parse_datetime(F.lit("soon"))) is None


def test_kind_by_route_beats_text(spark):
    assert one(spark, X.item_kind(F.lit("https://h.org/product/1"), F.lit("应用场景"))) == "product"


def test_three_complete_misses_retire(spark):
    runs = spark.createDataFrame([(k,) for k in range(1, 7)], "run int")
    seen = spark.createDataFrame([("a", 1), ("a", 5), ("b", 1), ("b", 2), ("b", 4)], "item string, run int")
    assert [tuple(r) for r in V.absences(seen, runs, ["item"], "run").collect()] == [("a", 4)]


def test_revert_is_a_version(spark):
    rows = spark.createDataFrame([("i", 1, "A"), ("i", 2, "A"), ("i", 3, "B"), ("i", 4, "A")], "item string, at int, payload string")
    out = V.chain(rows, ["item"], ["at"], "payload", "at").orderBy("version_no").collect()
    assert [(r.payload, r.valid_from, r.valid_to, r.is_current) for r in out] == [("A", 1, 3, False), ("B", 3, 4, False), ("A", 4, None, True)]

"""Runs, completeness, conclusions, registries, search and frontier on literal rows."""

import datetime
import json

from pyspark.sql import functions as F

from strataloom.operators import catalogue as K
from strataloom.operators import coverage as C
from strataloom.operators import frontier as FR
from strataloom.sources import registry as R

T0 = datetime.datetime(2026, 1, 1)


def test_two_records_of_a_declared_total_are_complete(spark):
    old = spark.createDataFrame([(1, "c", 99, "unknown", None)], "platform int, collection string, expected long, status string, last_complete timestamp")
    counts = spark.createDataFrame([(1, "c", 2, 2, T0)], "platform int, collection string, observed long, declared long, ended timestamp")
    (r,) = C.completeness(old, counts, full=True).collect()
    assert (r.expected, r.observed, r.status, r.whole, r.inferred, r.last_complete) == (2, 2, "complete", True, False, T0)
    for run in ({"errors": 1}, {"hit_limit": True}, {"cancelled": True}):
        (r,) = C.completeness(old, counts, full=True, **run).collect()
        assert (r.status, r.whole, r.last_complete) == ("partial", False, None)
    (r,) = C.completeness(old, counts.withColumn("declared", F.lit(None).cast("long")), full=True).collect()
    assert (r.expected, r.inferred, r.status) == (2, True, "complete")
    (r,) = C.completeness(old, counts.where("false"), full=True).collect()
    assert (r.expected, r.observed, r.status) == (None, 0, "partial")
    (r,) = C.completeness(old, counts, full=False, api=True).collect()
    assert (r.status, r.whole) == ("unknown", False)


def test_run_roll_up_precedence(spark):
    def status(*words):
        rows = spark.createDataFrame([(k, w, 1, 1, 1, 1, 0) for k, w in enumerate(words)], "platform int, status string, pages int, items_seen int, items_new int, items_updated int, errors int")
        return C.run_roll_up(rows).first().status

    assert [status("success"), status("success", "failed"), status("failed", "blocked"), status("partial", "failed"), status("failed", "no_url"), status("success", "cancelled")] == ["success", "partial", "failed", "partial", "partial", "cancelled"]


def test_conclusions(spark):
    rows = [(1, "complete", True, "active"), (1, "partial", False, "active"), (2, "blocked", True, "active"), (2, "offline", True, "active"), (3, "offline", True, "active"), (4, "partial", True, "active"), (5, "complete", False, "blocked")]
    got = {r.platform: r.conclusion for r in K.conclusions(spark.createDataFrame(rows, "platform int, status string, enabled boolean, onboarding string")).collect()}
    assert got == {1: "COMPLETE", 2: "BLOCKED", 3: "OFFLINE", 4: "ACTIVE", 5: "BLOCKED"}
    platforms = spark.createDataFrame([(k, "out_of_scope" if k == 6 else "active") for k in (1, 2, 3, 6)], "platform int, onboarding string")
    found = spark.createDataFrame([(k, v) for k, v in got.items()], "platform int, conclusion string")
    r = K.acceptance(found, platforms, 4).first()
    assert (r.sources, r.all_registered, r.all_audited, r.counts) == (4, True, True, {"COMPLETE": 1, "BLOCKED": 1, "OFFLINE": 1, "OUT_OF_SCOPE": 1})


def test_registry_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,name,canonical_url,enabled\n1, One ,https://h.org,\n2,"Two, Ltd",,Yes\n3,,,0\n', encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "One", "enabled": True}, {"id": 2, "canonical_url": "u"}]))
    (tmp_path / "b.json").write_text("﻿" + json.dumps({"platforms": [{"id": 7, "name": " x ", "enabled": "off"}]}), encoding="utf-8")
    got = R.registry(spark, str(tmp_path / "a.csv"), "csv").orderBy("id").collect()
    assert [(r.id, r.name, r.enabled) for r in got] == [(1, "One", True), (2, "Two, Ltd", True), (3, "", False)]
    assert [(r.id, r.name, r.enabled) for r in R.registry(spark, str(tmp_path / "a.json"), "json").orderBy("id").collect()] == [(1, "One", True), (2, "", True)]
    assert [(r.id, r.name, r.enabled) for r in R.registry(spark, str(tmp_path / "b.json"), "json").collect()] == [(7, "x", False)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    new = spark.createDataFrame([(2, " c ", None), (3, "d", 1)], "id int, name string, n int")
    got = {r.id: (r.name, r.n, r.action) for r in C.registry_upsert(old, new, ["name", "n"]).collect()}
    assert got == {1: ("a", 5, "kept"), 2: ("c", 6, "updated"), 3: ("d", 1, "inserted")}
    assert {r.id: (r.name, r.action) for r in C.registry_upsert(old, new, ["name", "n"], update=False).collect()}[2] == ("b", "skipped")


def test_sitemaps(spark):
    pages = spark.createDataFrame([(1, "https://h.org/s.xml", "<urlset><url><loc>/product/detail/1</loc></url><x:loc> https://h.org/a?utm_source=1&amp;b=2 </x:loc></urlset>"), (2, "u", None)], "id int, url string, body string")
    assert [(r.to_url, r.relevance) for r in R.sitemap_links(pages, "id").orderBy("place").collect()] == [("https://h.org/product/detail/1", 3.5), ("https://h.org/a?b=2", 2.0)]


def test_resume_at_the_page_after_the_last_good_one(spark):
    rows = [("c", f"https://h.org/v1?_page={k}", "api", s) for k, s in ((1, 200), (2, 206), (9, 500))] + [("c", "https://h.org/v1?_page=30", "listing", 200), ("d", "https://h.org/x", "api", 200)]
    got = FR.resume_page(spark.createDataFrame(rows, "collection string, url string, role string, http_status int"))
    assert {r.collection: r.resume_at for r in got.collect()} == {"c": 3, "d": 1}


def test_budget_of_a_host(spark):
    links = spark.createDataFrame([(f"https://h.org/{k}", float(k % 3), k) for k in range(7)] + [("https://x.org/", 1.0, 9)], "to_url string, score double, seq int")
    visited = spark.createDataFrame([("https://h.org/2",)], "url string")
    got = FR.best_first(links, visited, 3).orderBy("host", "rank").collect()
    assert [(r.to_url, r.hit_limit) for r in got] == [("https://h.org/5", True), ("https://h.org/1", True), ("https://h.org/4", True), ("https://x.org/", False)]


def test_search_on_one_s_own_tables(spark):
    items = spark.createDataFrame([(1, 1, "product", "active", T0, T0), (2, 1, "product", "inactive", T0, T0)], "item int, platform int, kind string, status string, first_seen timestamp, last_seen timestamp")
    versions = spark.createDataFrame([(k, 1, True, "Name", "mail alice@h.org", "Maker", "api", None, T0) for k in (1, 2)], "item int, version_no int, is_current boolean, name string, description string, provider string, product_type string, published_at timestamp, detected_at timestamp")
    dims = spark.createDataFrame([(1, 1, "coverage_region", "north")], "item int, version_no int, type string, value string")
    platforms = spark.createDataFrame([(1, "")], "platform int, name string")
    find = lambda **k: [r.item for r in K.search(items, versions, dims, platforms, **k).collect()]
    assert find() == [1] and find(status=None, q="MAKER") == [1, 2] and find(region="north") == [1] and find(region="south") == [] and find(industry="x") == []
    assert find(published_from=T0) == [] and find(provider="ake", product_type="api", platform=1, kind="product") == [1]
    r = K.search(items, versions, dims, platforms).first()
    assert (r.description, r.platform_name, r["at"]) == ("mail al***@h.org", "unknown", T0)

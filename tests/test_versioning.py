"""Acceptance cases of versions, absences, mappings, entities, reviews and states on literal rows."""

import datetime

from pyspark.sql import functions as F

from strataloom.operators import versioning as V

T0 = datetime.datetime(2026, 1, 1)


def day(n):
    return T0 + datetime.timedelta(days=n)


def test_same_item_twice_then_changed(spark):
    rows = spark.createDataFrame([("i", 1, "A"), ("i", 2, "A"), ("i", 3, "B"), ("j", 1, None), ("j", 2, None)], "item string, at int, payload string")
    states = V.history(rows, None, ["item"], ["at"], "payload")
    assert sorted((r.item, r["at"], r.event, r.version_no) for r in states.collect()) == [("i", 1, "added", 1), ("i", 2, "unchanged", 1), ("i", 3, "updated", 2), ("j", 1, "added", 1), ("j", 2, "unchanged", 1)]
    versions = V.intervals(states, ["item"], ["at"], "at").where("item = 'i'").orderBy("version_no").collect()
    assert [(r.valid_from, r.valid_to, r.is_current) for r in versions] == [(1, 3, False), (3, None, True)]
    assert V.history(rows.where("false"), None, ["item"], ["at"], "payload").count() == 0


def test_three_complete_misses_remove_once_and_a_sighting_recovers(spark):
    seen = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("b", 5), ("b", 7), ("a", 7), ("c", 3), ("c", 6)], "item string, run int")
    runs = spark.createDataFrame([(k,) for k in (1, 2, 4, 5, 7)], "run int")  # runs 3 and 6 were not complete
    gone = V.absences(seen, runs, ["item"], "run")
    assert [tuple(r) for r in gone.collect()] == [("a", 5)]
    states = V.history(seen.withColumn("payload", F.lit("p")), gone, ["item"], ["run"], "payload")
    log = V.change_events(states, ["item"], ["run"]).where("item = 'a'").orderBy("run").collect()
    assert [(r.run, r.event, r.version_no, r.payload) for r in log] == [(1, "added", 1, '{"diff":{}}'), (5, "removed", 1, '{"reason":"missing from complete full scans"}'), (7, "recovered", 1, '{"diff":{}}')]


def test_recovery_with_a_new_payload_makes_a_version(spark):
    seen = spark.createDataFrame([("a", 1, "p"), ("a", 9, "q")], "item string, run int, payload string")
    gone = spark.createDataFrame([("a", 4)], "item string, run int")
    out = V.history(seen, gone, ["item"], ["run"], "payload").orderBy("run").collect()
    assert [(r.event, r.new_version, r.version_no) for r in out] == [("added", True, 1), ("removed", False, 1), ("recovered", True, 2)]


def test_a_mapping_before_the_hash_changes_it_once(spark):
    dims = spark.createDataFrame([(1, "product_type", " API  接口", "other", 0.4, "rule")], "item int, type string, raw string, value string, confidence double, method string")
    rules = spark.createDataFrame([("product_type", "api 接口", "api", 1.0, True)], "type string, raw string, mapped string, sure double, enabled boolean")
    mapped = V.apply_mappings(dims, rules)
    assert [(r.value, r.confidence, r.method) for r in mapped.collect()] == [("api", 1.0, "taxonomy_mapping")]

    def hashed(rows):
        items = rows.groupBy("item").agg(F.collect_list(F.struct("type", "value", "raw")).alias("dimensions")).withColumn("name", F.lit("n"))
        return items.select(V.semantic_hash(items, ["name"])).first()[0]

    assert hashed(dims) != hashed(mapped) == hashed(V.apply_mappings(dims, rules))
    assert V.apply_mappings(dims, rules.withColumn("enabled", F.lit(False))).first().value == "other"


def test_hash_is_free_of_the_order_of_dimensions(spark):
    dims = [("industry", "energy", "电网"), ("industry", "finance", "银行")]
    items = spark.createDataFrame([(1, "n", dims), (2, "n", dims[::-1]), (3, "n", dims[:1])], "item int, name string, dimensions array<struct<type:string,value:string,raw:string>>")
    a, b, c = (r[0] for r in items.orderBy("item").select(V.semantic_hash(items, ["name"])).collect())
    assert a == b != c


def test_one_entity_for_a_name_and_provider_on_two_platforms(spark):
    items = spark.createDataFrame([(1, "product", "Name A", "甲"), (2, "product", "ｎａｍｅ  a", "甲 "), (3, "component", "name a", "甲"), (4, "product", "name a", ""), (5, "product", "name a", None), (6, "product", "known", "乙"), (7, "product", "x", "y")], "item long, kind string, name string, provider string")
    entities = spark.createDataFrame([(900, "product", "KNOWN", "乙")], "entity long, kind string, name string, provider string")
    links = spark.createDataFrame([(7,)], "item long")
    got = {r.item: (r.entity, r.method, r.confidence) for r in V.link_entities(items, entities, links).collect()}
    assert got[1] == (1, "new_entity", 1.0) and got[2] == (1, "exact_name_provider", 0.995) and got[3] == (3, "new_entity", 1.0)
    assert got[4][0] == 4 and got[5][0] == 5 and got[6] == (900, "exact_name_provider", 0.995) and 7 not in got


def test_reviews(spark):
    items = spark.createDataFrame([(1, "api", 0.5, 0.9), (2, "api", 0.96, 0.1), (3, "api", None, 0.7), (4, "api", None, 0.8)], "item int, product_type string, type_confidence double, confidence double")
    got = V.review_rows(items, automatic=True).orderBy("item").collect()
    assert [(r.item, r.status, r.reviewer) for r in got] == [(1, "accepted", "automatic_classifier"), (3, "accepted", "automatic_classifier")]
    assert V.resolve_pending(V.review_rows(items), "x").where("resolved and status = 'accepted' and reviewer = 'x'").count() == 2


def test_states_merge(spark):
    old = spark.createDataFrame([("u", None, "", 5, "unknown", day(1), day(1), False), ("v", 3, "old", 1, "entry", day(1), day(2), True)], "url string, collection int, anchor string, depth int, role string, first_seen timestamp, last_seen timestamp, active boolean")
    seen = spark.createDataFrame([("u", 7, "one", 2, "unknown", day(3), 0), ("u", 8, "two", 4, "detail", day(3), 1), ("w", None, "", 1, "listing", day(3), 2)], "url string, collection int, anchor string, depth int, role string, at timestamp, nth int")
    got = {r.url: r for r in V.merge_states(old, seen).collect()}
    u = got["u"]
    assert (u.collection, u.anchor, u.depth, u.role, u.first_seen, u.last_seen, u.active) == (7, "one", 2, "detail", day(1), day(3), True)
    assert got["v"].anchor == "old" and got["v"].active and got["w"].collection is None and got["w"].first_seen == day(3)


def test_304_is_a_fetch_without_a_snapshot(spark):
    states = spark.createDataFrame([("u", 200, day(1), 2, "e1"), ("v", 500, day(1), 1, "e2")], "url string, http_status int, last_fetched timestamp, errors int, etag string")
    answers = spark.createDataFrame([("u", day(2), "new"), ("u", day(3), None)], "url string, at timestamp, new_etag string")
    got = {r.url: (r.http_status, r.last_fetched, r.errors, r.etag) for r in V.not_modified(states, answers).collect()}
    assert got == {"u": (304, day(3), 0, "new"), "v": (500, day(1), 1, "e2")}


def test_snapshots_are_written_once_and_a_revert_is_a_change(spark):
    rows = [("u", day(k), h, h, 1, "r") for k, h in enumerate(["a", "b", "a", "a"])]
    fetched = spark.createDataFrame(rows, "url string, at timestamp, content_hash string, semantic_hash string, platform int, run string")
    none = fetched.where("false")
    got = V.new_snapshots(fetched, none.select("url", "content_hash"), none.select("url", "content_hash", "semantic_hash"), 30).orderBy("at").collect()
    assert [(r.content_hash, r.changed) for r in got] == [("a", True), ("b", True)] and got[0].expires_at == day(30) and got[0].object_key.startswith("platform/1/2026/01/01/r/")
    known = spark.createDataFrame([("u", "a", "a")], "url string, content_hash string, semantic_hash string")
    got = V.new_snapshots(fetched, known.select("url", "content_hash"), known, 30).collect()
    assert [(r.content_hash, r.changed) for r in got] == [("b", True)]


def test_archive_checks_the_body(spark):
    rows = spark.createDataFrame([(1, day(1), "online", "x", "x"), (2, day(1), "online", "x", "y"), (3, day(9), "online", "x", "x"), (4, day(1), "archive", "x", "x")], "id int, expires_at timestamp, tier string, stored_hash string, body_hash string")
    got = {r.id: (r.outcome, r.tier, r.alert) for r in V.archived(rows, F.lit(day(2)), 10).collect()}
    assert got == {1: ("archived", "archive", None), 2: ("failed", "online", "snapshot_archive_failure")}


def test_runs_of_another_platform_are_no_misses(spark):
    seen = spark.createDataFrame([("A", "x", 1), ("B", "y", 1), ("B", "y", 5)], "platform string, item string, run int")
    runs = spark.createDataFrame([("A", k) for k in (1, 2, 3, 4)] + [("B", 1), ("B", 5)], "platform string, run int")
    assert [tuple(r) for r in V.absences(seen, runs, ["item"], "run", scope=("platform",)).collect()] == [("A", "x", 4)]


def test_a_sighting_behind_the_last_miss_comes_too_late(spark):
    seen = spark.createDataFrame([("a", 1), ("a", 5)], "item string, run int")  # run 5 is not complete
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "run int")
    assert [tuple(r) for r in V.absences(seen, runs, ["item"], "run").collect()] == [("a", 4)]


def test_evidence_belongs_to_its_version(spark):
    versions = spark.createDataFrame([("x", 1, "s1"), ("x", 2, "s2")], "item string, version_no int, snapshot string")
    fields = spark.createDataFrame([("x", 1, "name", "old name", "h1", "rule", 0.9), ("x", 2, "name", "new name", "json.name", "json", 0.8), ("x", 2, "price", "", "p", "json", 0.8)], "item string, version_no int, field string, value string, locator string, method string, confidence double")
    got = V.evidence_rows(versions, fields, ["item", "version_no"]).orderBy("version_no").collect()
    assert [tuple(r) for r in got] == [("x", 1, "name", "old name", "h1", "rule", 0.9, "s1"), ("x", 2, "name", "new name", "json.name", "json", 0.8, "s2")]


def test_one_rule_a_value_and_the_type_of_the_item(spark):
    dims = spark.createDataFrame([(1, "product_type", "API", "other", 0.4, "rule"), (2, "product_type", None, "other", 0.4, "rule")], "item int, type string, raw string, value string, confidence double, method string")
    rules = spark.createDataFrame([("product_type", "api", "first", 1.0, True, 1), ("product_type", " API ", "second", 0.9, True, 2)], "type string, raw string, mapped string, sure double, enabled boolean, id int")
    mapped = V.apply_mappings(dims, rules, "id")
    assert [(r.item, r.value) for r in mapped.orderBy("item").collect()] == [(1, "second"), (2, "other")]
    items = spark.createDataFrame([(1, "other"), (2, "other")], "item int, product_type string")
    assert sorted(map(tuple, V.mapped_types(items, mapped, "item").collect())) == [(1, "second"), (2, "other")]


def test_the_latest_decision_counts(spark):
    versions = spark.createDataFrame([(1, "t")], "item int, product_type string")
    dims = spark.createDataFrame([(1, "product_type", "t", 0.4, "rule")], "item int, type string, value string, confidence double, method string")
    decisions = spark.createDataFrame([(1, "accepted", "zeta", day(1)), (1, "accepted", "alpha", day(2)), (1, "rejected", "beta", day(3)), (1, "accepted", "", day(4))], "item int, status string, value string, at timestamp")
    out, rows = V.apply_decisions(versions, dims, decisions)
    assert out.first().product_type == "alpha" and tuple(rows.first()) == (1, "product_type", "alpha", 1.0, "manual_review")


def test_changes_carry_their_difference(spark):
    rows = spark.createDataFrame([("i", 1, "A/1", "A", "1"), ("i", 2, "A/1", "A", "1"), ("i", 3, "B/1", "B", "1"), ("i", 9, "B/2", "B", None)], "item string, at int, payload string, kind string, grade string")
    gone = spark.createDataFrame([("i", 6)], "item string, at int")
    log = V.change_events(V.history(rows, gone, ["item"], ["at"], "payload"), ["item"], ["at"], ["kind", "grade"]).orderBy("at").collect()
    assert [(r.event, r.payload) for r in log] == [("added", '{"diff":{}}'), ("updated", '{"diff":{"kind":{"old":"A","new":"B"}}}'), ("removed", '{"reason":"missing from complete full scans"}'), ("recovered", '{"diff":{"grade":{"old":"1","new":null}}}')]


def test_versions_at_many_instants(spark):
    versions = spark.createDataFrame([("a", day(1), 1, "v1"), ("a", day(3), 2, "v2"), ("a", day(3), 3, "v3"), ("b", day(40), 1, "w1"), (None, day(1), 1, "n")], "item string, since timestamp, no int, name string")
    asked = [(k, i, t) for k, (i, t) in enumerate([("a", day(0)), ("a", day(1)), ("a", day(2)), ("a", day(3)), ("a", day(90)), ("b", day(39)), ("b", day(400)), ("c", day(5)), (None, day(5)), ("a", None), ("a", day(2))])]
    instants = spark.createDataFrame(asked, "nth int, item string, at timestamp")
    want = {0: None, 1: "v1", 2: "v1", 3: "v3", 4: "v3", 5: None, 6: "w1", 7: None, 8: None, 9: None, 10: "v1"}
    for bucket in (None, "day", "month"):
        out = V.as_of_each(instants, versions, ["item"], "at", "since", ["no"], ["name"], bucket)
        assert {r.nth: r.name for r in out.collect()} == want and out.columns == ["nth", "item", "at", "name"]
    plan = V.as_of_each(instants, versions, ["item"], "at", "since", ["no"], ["name"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_pages_of_one_url_share_an_edge(spark):
    edge = "from_url string, to_url string, anchor string, relevance double, first_seen int, last_seen int"
    known = spark.createDataFrame([("u", "v", "old", 0.0, 1, 1)], edge)
    for rows in ([("b", 2.0), ("a", 1.0)], [("a", 1.0), ("b", 2.0)]):
        found = spark.createDataFrame([("u", "v", 3, a, r, 2) for a, r in rows], "from_url string, to_url string, place int, anchor string, relevance double, at int").coalesce(1)
        assert [tuple(r) for r in V.merge_links(known, found).collect()] == [("u", "v", "a", 1.0, 1, 2)]


def test_of_tags_at_one_time_the_largest_counts(spark):
    states = spark.createDataFrame([("u", 200, day(1), 2, "e1")], "url string, http_status int, last_fetched timestamp, errors int, etag string")
    for tags in (("t1", "t2", None), ("t2", None, "t1")):
        answers = spark.createDataFrame([("u", day(2), t) for t in tags], "url string, at timestamp, new_etag string").coalesce(1)
        assert V.not_modified(states, answers).first().etag == "t2"


def test_a_name_cut_at_a_blank_is_its_folded_name(spark, tmp_path):
    import duckdb

    from strataloom.plans import versions as PV

    text = "x" * 39
    spark.createDataFrame([(1, text, "en"), (2, text + " and more", "en"), (3, text + "y", "en")], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in PV.d10_entity_link(spark, str(tmp_path)).select("item", "entity", "method").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == [(1, 1, "new_entity"), (2, 1, "exact_name_provider"), (3, 3, "new_entity")]
    assert got == sorted(con.execute(f"select item, entity, method from ({PV.D10})").fetchall())

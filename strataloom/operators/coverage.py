"""Completeness of collections, status of platforms, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Results depend on them.
RANK = {"complete": 4, "partial": 3, "blocked": 2, "unknown": 1, "out_of_scope": 0}


def completeness(collections: DataFrame, counts: DataFrame, *, full, errors=0, hit_limit=False, cancelled=False, api=False, kept: tuple[str, ...] = ()) -> DataFrame:
    """Collections (platform, collection, expected, status, last_complete) after a run that ended at ``ended`` (a column of ``counts``:
    platform, collection, observed, declared, ended): expected, inferred, whole, status, last_complete. What happened in the run is a value, or a column of
    ``collections`` for several runs at once; ``kept`` names columns of theirs to be kept.

    A full run forgets the old expectation and takes the declared total or, if there is none and all went well, what was observed.
    Whole is what reached its expectation without errors, page limit or cancellation. An incremental run of an API keeps the old
    status; other incremental runs are judged like full ones, against the old expectation."""
    full, errors, hit_limit, cancelled, api = (v if isinstance(v, Column) else F.lit(v) for v in (full, errors, hit_limit, cancelled, api))
    well = (errors == 0) & ~hit_limit & ~cancelled
    rows = collections.hint("merge").join(counts, ["platform", "collection"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    known = F.coalesce("declared", F.when(~full, F.col("expected")))
    inferred = known.isNull() & (F.col("observed") > 0) & well & full
    expected = F.coalesce(known, F.when(inferred, F.col("observed")))
    reached = expected.isNotNull() & (F.col("observed") >= expected) & well
    keep = api & ~full
    whole = F.when(keep, F.coalesce(F.col("status") == "complete", F.lit(False))).otherwise(reached)
    return rows.select(*kept, "platform", "collection", "observed", expected.alias("expected"), inferred.alias("inferred"), whole.alias("whole"), F.when(keep, F.col("status")).otherwise(F.when(reached, "complete").otherwise("partial")).alias("status"), F.when(whole, F.col("ended")).otherwise(F.col("last_complete")).alias("last_complete"))


def run_status(cancelled: Column, blocked: Column, fetched: Column, errors: Column, hit_limit: Column) -> Column:
    """Status of a platform's run."""
    return F.when(cancelled, "cancelled").when(blocked & (fetched == 0), "blocked").when(fetched == 0, "failed").when((errors > 0) | hit_limit, "partial").otherwise("success")


def run_coverage(whole: Column, blocked: Column, fetched: Column) -> Column:
    """Coverage of a platform's run; ``whole``: it has collections and all are complete."""
    return F.when(whole, "complete").when(blocked & (fetched == 0), "blocked").otherwise("partial")


def status_from_evidence(reference: Column, observed: Column, fetched: Column, full: Column, blocked: Column, failed: Column, api: Column, before: Column) -> Column:
    """Onboarding status after a run: only a full run can find a source blocked or offline."""
    return (
        F.when(reference, "out_of_scope")
        .when((observed > 0) & (fetched > 0), "active")
        .when(full & api, F.when(failed & (fetched == 0), "offline").otherwise("blocked"))
        .when(full & blocked, "blocked")
        .when(full & (fetched == 0), "offline")
        .otherwise(before)
    )


def failure_notes(failures: DataFrame, first: int = 12) -> DataFrame:
    """(platform, note): the first failures (platform, at, text) of each platform, joined; ranked before they are gathered."""
    rank = F.row_number().over(Window.partitionBy("platform").orderBy("at"))
    own = failures.withColumn("rank", rank).where(F.col("rank") <= first)
    return own.groupBy("platform").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda f: f.text), "；").alias("note"))


def completeness_document(rows: DataFrame) -> DataFrame:
    """(platform, document): the outcome of ``completeness`` for each platform as JSON."""
    out = rows.groupBy("platform").agg(
        F.bool_and("whole").alias("coverage_complete"), F.count("*").alias("collections_total"), F.count("expected").alias("collections_with_expected_count"),
        F.array_sort(F.collect_list(F.when(F.col("inferred"), F.col("observed")))).alias("inferred_collection_counts"), F.sum("expected").alias("expected_count"), F.sum("observed").alias("observed_count"),
    )
    return out.select("platform", F.to_json(F.struct(*[c for c in out.columns if c != "platform"])).alias("document"))


def run_roll_up(results: DataFrame) -> DataFrame:
    """One row for a run: its status and eleven counts, of results (platform, status, pages, items_seen, items_new, items_updated, errors). A run is
    cancelled if a platform was, partial if some failed and some did not, failed if none went well."""
    is_ = lambda *s: F.col("status").isin(*s)
    counts = [F.count("*").alias("platforms"), *[F.count_if(is_(s)).alias(s) for s in ("success", "partial", "blocked", "failed", "no_url")]]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "items_seen", "items_new", "items_updated", "errors")]
    out = results.agg(*counts, *sums, F.count_if(is_("cancelled")).alias("cancelled"))
    bad, good = F.col("failed") + F.col("blocked") + F.col("partial") > 0, F.col("success") + F.col("no_url") + F.col("partial") > 0
    return out.withColumn("status", F.when(F.col("cancelled") > 0, "cancelled").when(bad & good, "partial").when(bad, "failed").otherwise("success")).drop("cancelled")


def alerts(results: DataFrame) -> DataFrame:
    """Alerts for failed (error) and blocked (warning) platforms."""
    return results.where("status in ('failed', 'blocked')").select("platform", F.when(F.col("status") == "failed", "error").otherwise("warning").alias("severity"), F.lit("crawl_platform_failure").alias("alert_type"), F.concat(F.lit("platform "), "platform", F.lit(" "), "status").alias("title"))


def first_pages(records: DataFrame, key: str, start: int, ids: int = 10) -> DataFrame:
    """(key, n_records, records_hash, first_ids) of the first page of each list of records (key, page_no, nth, id, record); a page is of bounded size."""
    rows = records.where(F.col("page_no") == start).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "id", "record"))).alias("r"))
    return rows.select(key, F.size("r").cast("long").alias("n_records"), F.sha2(F.array_join(F.transform("r", lambda x: x.record), "\n"), 256).alias("records_hash"), F.transform(F.slice("r", 1, ids), lambda x: x.id).alias("first_ids"))


def conclusion(all_complete: Column, any_blocked: Column, any_offline: Column, otherwise: Column) -> Column:
    return F.when(all_complete, "COMPLETE").when(any_blocked, "BLOCKED").when(any_offline, "OFFLINE").otherwise(F.upper(otherwise))


def onboarding(enabled: Column, url_status: Column, reference: Column, before: Column) -> Column:
    """Status when a registry row is loaded; a terminal status stays."""
    terminal = before.isin("active", "complete", "blocked", "offline", "out_of_scope")
    return (
        F.when(reference, "out_of_scope")
        .when(~enabled | (url_status == "missing_url"), "blocked")
        .when(url_status.isin("tls_cert_expired", "site_expired"), "offline")
        .when(terminal, before)
        .otherwise("pending_audit")
    )


def status_rank(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[status]


def merged_collections(rows: DataFrame, key: list[str], row_id: str, status: str, latest: list[str]) -> DataFrame:
    """Duplicates of a key merged into the row of the smallest id: best status, greatest of the ``latest`` columns, number of rows merged."""
    return rows.groupBy(*key).agg(F.min(row_id).alias("kept_id"), F.max_by(status, status_rank(F.col(status))).alias("status"), *[F.max(c).alias(c) for c in latest], F.count("*").alias("merged")).where("merged > 1")


def repointed(children: DataFrame, rows: DataFrame, key: list[str], row_id: str, parent: str) -> DataFrame:
    """Children whose parent is a duplicate, pointed to the row that was kept."""
    ids = rows.select(F.col(row_id).alias(parent), F.min(row_id).over(Window.partitionBy(*key)).alias("__kept")).where(f"{parent} <> __kept")
    return children.hint("merge").join(ids, parent, "left").withColumn(parent, F.coalesce("__kept", parent)).drop("__kept")


def registry_upsert(stored: DataFrame, rows: DataFrame, fields: list[str], update: bool = True) -> DataFrame:
    """The registry (id and fields) after rows of a seed, with ``action``: inserted, updated, skipped (``update`` is off) or kept (not in the seed). A null field of the seed
    is not given and leaves the old value; blanks are trimmed."""
    new = rows.select("id", F.lit(True).alias("__given"), *[F.col(f).alias(f"__{f}") for f in fields])
    old = stored.withColumn("__known", F.lit(True))
    both = old.hint("merge").join(new, "id", "full")
    given, known = F.col("__given").isNotNull(), F.col("__known").isNotNull()
    action = F.when(given & ~known, "inserted").when(given & known, "updated" if update else "skipped").otherwise("kept")
    clean = lambda f: F.trim(f"__{f}") if rows.schema[f].dataType.typeName() == "string" else F.col(f"__{f}")
    value = lambda f: F.when(~known, clean(f)).otherwise(F.coalesce(clean(f), F.col(f)) if update else F.col(f)).alias(f)
    return both.select("id", *[value(f) for f in fields], action.alias("action"))


def upsert_collections(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Collections (platform, code, name, kind, coverage) after rows (and at, the order of writing): the last row of a key wins, but a coverage that was found out
    stays: only an unknown or out-of-scope one is replaced."""
    last = rows.groupBy("platform", "code").agg(F.max_by(F.struct("name", "kind", "coverage"), "at").alias("n"))
    both = stored.hint("merge").join(last, ["platform", "code"], "full")
    open_ = F.col("coverage").isNull() | F.col("coverage").isin("unknown", "out_of_scope")
    return both.select("platform", "code", F.coalesce("n.name", "name").alias("name"), F.coalesce("n.kind", "kind").alias("kind"), F.when(open_, F.coalesce("n.coverage", "coverage")).otherwise(F.col("coverage")).alias("coverage"))


def metrics(responses: DataFrame, now: Column, fresh_hours: int = 26) -> DataFrame:
    """Rates and counts of responses (platform, collection, code, attempt, at) for each collection, each platform and in all (null keys)."""
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    classes = [F.count_if(F.floor(F.col("code") / 100) == k).alias(f"n_{k}xx") for k in range(2, 6)]
    fresh = F.col("at") >= now - F.make_dt_interval(hours=F.lit(fresh_hours))
    rates = [share(F.col("code") < 400).alias("success_rate"), share(F.col("code") == 304).alias("not_modified_rate"), share(F.col("attempt") > 1).alias("retry_rate")]
    return responses.rollup("platform", "collection").agg(F.count("*").alias("n"), *rates, *classes, share(fresh).alias("fresh_rate"), F.max("at").alias("latest"))


def staleness(runs: DataFrame, key: str, now: Column, hours: int = 26, days: int = 7) -> DataFrame:
    """(key, failed_twice, stale, no_full_scan) of runs (key, nth, at, failed, full_scan)."""
    before = F.lag("failed").over(Window.partitionBy(key).orderBy("nth"))
    late = lambda c, interval: F.coalesce(c < now - interval, F.lit(True))
    return runs.withColumn("__before", before).groupBy(key).agg(
        F.coalesce(F.bool_or(F.col("failed") & F.col("__before")), F.lit(False)).alias("failed_twice"), late(F.max("at"), F.make_dt_interval(hours=F.lit(hours))).alias("stale"), late(F.max(F.when(F.col("full_scan"), F.col("at"))), F.make_dt_interval(days=F.lit(days))).alias("no_full_scan")
    )

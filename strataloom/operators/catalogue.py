"""Search, facets, details, lists and roll-ups over catalogue tables.

Tables, as the functions take them: ``items`` (item, platform, collection, state, kind, status, external_id, first_seen, last_seen), ``versions``
(item, version_no, is_current, name, description, provider, product_type, published_at, detected_at, confidence), ``dims`` (item,
version_no, type, raw, value, confidence, method), ``platforms`` (platform, name, province, city, enabled, onboarding). More columns are
carried where that says so. Facts are aggregated before they are joined; texts are masked on the way out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import written

REGION_TYPES = ("platform_province", "platform_city", "coverage_region")
FACET_TYPES = ("industry", "platform_province", "coverage_region")


def page_of(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of a fully ordered result."""
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def shown(name: Column, otherwise: str = "unknown") -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(otherwise))


def like(columns: list[str], words: str) -> Column:
    """Any of the columns holds the words, whatever their case; per cent signs and underscores are patterns."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{words.strip()}%") for c in columns])


def search(items, versions, dims, platforms, *, q=None, kind=None, product_type=None, industry=None, region=None, provider=None, platform=None, status="active", published_from=None, published_to=None) -> DataFrame:
    """Current versions of items under all given filters, with the name of the platform and ``at``, the time they are ordered by. To
    be paged by ``page_of(rows, [F.desc("at"), "item"], ...)``."""
    own = items.select("item", "platform", "kind", "status", "first_seen", "last_seen")
    for column, wanted in (("status", status), ("kind", kind), ("platform", platform)):
        own = own.where(F.col(column) == wanted) if wanted is not None and wanted != "" else own
    current = versions.where("is_current").drop("is_current")
    current = current.where(F.col("product_type") == product_type) if product_type else current
    current = current.where(like(["provider"], provider)) if provider else current
    current = current.where(F.col("published_at") >= F.lit(published_from)) if published_from is not None else current
    current = current.where(F.col("published_at") <= F.lit(published_to)) if published_to is not None else current
    current = current.where(like(["name", "description", "provider"], q)) if q else current
    rows = own.join(current.hint("merge"), "item")
    for types, wanted in ((("industry",), industry), (REGION_TYPES, region)):
        if wanted:
            hits = dims.where(F.col("type").isin(*types) & (F.col("value") == wanted)).select("item", "version_no")
            rows = rows.join(hits.hint("merge"), ["item", "version_no"], "left_semi")
    names = platforms.select("platform", shown(F.col("name")).alias("platform_name"))
    rows = rows.join(names, "platform")
    return rows.withColumns({"description": T.redact(F.col("description")), "at": F.coalesce("published_at", "detected_at")})


def with_total(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """A page of rows, each with the count of all; the count is one row."""
    return page_of(rows, order, page, size).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def dimension_maps(dims: DataFrame) -> DataFrame:
    """(item, version_no, dimensions): value by type; of several the greatest. Rows are grouped, and so sorted, once only."""
    every = dims.groupBy("item", "version_no").agg(F.collect_set(F.struct("type", "value")).alias("d"))
    types = F.array_sort(F.array_distinct(F.transform("d", lambda d: d.type)))
    greatest = F.transform(types, lambda t: F.array_max(F.transform(F.filter("d", lambda d: d.type == t), lambda d: d.value)))
    return every.select("item", "version_no", F.map_from_arrays(types, greatest).alias("dimensions"))


def item_details(items, versions, dims, evidence, snapshots, links, platforms, chosen: DataFrame) -> DataFrame:
    """All that is known of the items in ``chosen`` (item): current version, platform, entity, the version's snapshot, dimensions and evidence as lists; masked.
    ``versions``: item, version_no, is_current, snapshot and more, among them perhaps the maps source_fields, whose values are masked, and normalized; ``evidence``: item,
    version_no, field, raw, locator, method, confidence, snapshot; ``snapshots``: snapshot, fetched_at, content_hash, object_key, tier; ``links``: item, entity.

    The chosen items with their versions are written first, as all lists are looked up for them only."""
    own = items.join(chosen.select("item").distinct().hint("merge"), "item", "left_semi")
    rows = written(own.join(versions.where("is_current").drop("is_current").hint("merge"), "item"))
    keys = rows.select("item", "version_no")
    listed = lambda df, *c: df.join(keys, ["item", "version_no"], "left_semi").groupBy("item").agg(F.array_sort(F.collect_list(F.struct(*c))))
    d = listed(dims, "type", "raw", "value", "confidence", "method").toDF("item", "dimensions")
    e = listed(evidence.withColumn("raw", T.redact(F.col("raw"))), "field", "raw", "locator", "method", "confidence", "snapshot").toDF("item", "evidence")
    shot = snapshots.select("snapshot", F.struct(F.col("snapshot").alias("id"), "fetched_at", "content_hash", "object_key", "tier").alias("__shot"))
    out = rows.join(platforms.select("platform", shown(F.col("name")).alias("platform_name")), "platform")
    out = out.join(d, "item", "left").join(e, "item", "left").join(links.select("item", "entity"), "item", "left").join(shot, "snapshot", "left").drop("snapshot").withColumnRenamed("__shot", "snapshot")
    masked = {"description": T.redact(F.col("description"))}
    if "source_fields" in out.columns:
        masked["source_fields"] = T.redact_fields(F.col("source_fields"), out.schema["source_fields"].dataType)
    return out.withColumns(masked)


def type_facet(items: DataFrame, versions: DataFrame) -> DataFrame:
    active = items.where("status = 'active'").select("item")
    return versions.where("is_current").select("item", "product_type").join(active.hint("merge"), "item").groupBy(F.col("product_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def platform_facet(items: DataFrame, platforms: DataFrame) -> DataFrame:
    counts = items.where("status = 'active'").groupBy("platform").agg(F.count("*").alias("n"))
    return platforms.select("platform", shown(F.col("name")).alias("value")).join(counts, "platform").orderBy(F.desc("n"), "platform")


def dimension_facet(items: DataFrame, dims: DataFrame, types=FACET_TYPES) -> DataFrame:
    """Items by dimension value, of all their versions; an item counts once."""
    active = items.where("status = 'active'").select("item")
    pairs = dims.where(F.col("type").isin(*types)).select("type", "value", "item").distinct()
    return pairs.join(active.hint("merge"), "item").groupBy("type", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type", "value")


def provider_facet(items: DataFrame, versions: DataFrame, top: int = 100) -> DataFrame:
    """The providers with the most active items; how many is the feature."""
    active = items.where("status = 'active'").select("item")
    named = versions.where("is_current and provider <> ''").select("item", "provider").join(active.hint("merge"), "item")
    return named.groupBy("provider").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "provider").limit(top)


def platform_list(platforms: DataFrame, items: DataFrame, collections: DataFrame, runs: DataFrame) -> DataFrame:
    """Platforms with active items, collections and their latest run; ``runs``: platform, started_at and more, as a struct."""
    counts = items.where("status = 'active'").groupBy("platform").agg(F.count("*").alias("active_items"))
    held = collections.groupBy("platform").agg(F.count("*").alias("collections"))
    rest = [c for c in runs.columns if c != "platform"]
    latest = runs.groupBy("platform").agg(F.max_by(F.struct(*rest), "started_at").alias("last_run"))
    rows = platforms.withColumn("name", shown(F.col("name")))
    for df in (counts, held, latest):
        rows = rows.join(df, "platform", "left")
    return rows.fillna(0, ["active_items", "collections"]).orderBy("platform")


def coverage_matrix(platforms, collections, items, versions, errors) -> DataFrame:
    """A row for each collection (platform, collection, expected, status, enabled): discovered, active, detail_success, versions, errors, and active
    over expected and detail_success over discovered (null where there is nothing to divide by)."""
    described = versions.groupBy("item").agg(F.count("*").alias("n"), F.bool_or("is_current").alias("current"))
    rows = items.select("item", "platform", "collection", "status").join(described.hint("merge"), "item", "left")
    facts = rows.groupBy("platform", "collection").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("status") == "active").alias("active"), F.count_if("current").alias("detail_success"), F.coalesce(F.sum("n"), F.lit(0)).alias("versions")
    )
    failed = errors.groupBy("platform", "collection").agg(F.count("*").alias("errors"))
    out = collections.join(facts, ["platform", "collection"], "left").join(failed, ["platform", "collection"], "left").join(platforms.select("platform", shown(F.col("name")).alias("platform_name"), "onboarding"), "platform")
    out = out.fillna(0, ["discovered", "active", "detail_success", "versions", "errors"])
    return out.withColumns({"reconciliation": F.try_divide("active", F.col("expected")), "detail_rate": F.try_divide("detail_success", F.col("discovered"))})


def conclusions(matrix: DataFrame) -> DataFrame:
    """(platform, conclusion): COMPLETE if all enabled collections are complete (and there is one), else BLOCKED or OFFLINE if one is, else the
    onboarding status."""
    is_ = lambda s: F.coalesce(F.bool_or(F.col("enabled") & (F.col("status") == s)), F.lit(False))
    rows = matrix.groupBy("platform").agg(F.first("onboarding").alias("onboarding"), F.bool_or("enabled").alias("some"), F.bool_and(~F.col("enabled") | (F.col("status") == "complete")).alias("whole"), is_("blocked").alias("blocked"), is_("offline").alias("offline"))
    name = F.when(F.col("some") & F.col("whole"), "COMPLETE").when(F.col("blocked"), "BLOCKED").when(F.col("offline"), "OFFLINE").otherwise(F.upper("onboarding"))
    return rows.select("platform", name.alias("conclusion"))


def acceptance(found: DataFrame, platforms: DataFrame, expected: int) -> DataFrame:
    """One row: sources, whether all are registered and all audited to an end, and the count of each conclusion as a map. Platforms without
    collections count with their onboarding status."""
    rows = platforms.select("platform", F.upper("onboarding").alias("own")).join(found, "platform", "left").select(F.coalesce("conclusion", "own").alias("conclusion"))
    counts = rows.groupBy("conclusion").agg(F.count("*").alias("n"))
    ended = F.col("conclusion").isin("COMPLETE", "BLOCKED", "OFFLINE", "OUT_OF_SCOPE")
    out = counts.agg(F.sum("n").alias("sources"), F.bool_and(ended).alias("ended"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("conclusion", "n")))).alias("counts"))
    return out.select("sources", (F.col("sources") == expected).alias("all_registered"), ((F.col("sources") == expected) & F.col("ended")).alias("all_audited"), "counts")


def dashboard(platforms, items, alerts, changes, runs, now: Column) -> DataFrame:
    """One row of counts, with what was added and updated in the 24 hours before ``now`` and the latest run (run, started_at)."""
    late = F.col("created_at") >= now - F.expr("interval 24 hours")
    one = platforms.agg(F.count("*").alias("platforms"), F.count_if("enabled").alias("active_platforms"))
    for part in (
        items.agg(F.count_if(F.col("status") == "active").alias("active_items")),
        alerts.agg(F.count_if(F.col("status") == "open").alias("open_alerts")),
        changes.agg(F.count_if(late & (F.col("event") == "added")).alias("items_added_24h"), F.count_if(late & (F.col("event") == "updated")).alias("items_updated_24h")),
        runs.agg(F.max_by("run", "started_at").alias("latest_run"), F.max("started_at").alias("latest_start")),
    ):
        one = one.join(F.broadcast(part))  # one row each
    return one


def run_detail(runs: DataFrame, errors: DataFrame, run, last: int = 500) -> tuple[DataFrame, DataFrame]:
    """A run's platforms in order, and its last errors."""
    return runs.where(F.col("run") == run).orderBy("platform"), errors.where(F.col("run") == run).orderBy(F.desc("at"), F.desc("id")).limit(last)


def newest(rows: DataFrame, status: str | None, top: int = 1000) -> DataFrame:
    """The newest rows (id, created_at, status) of a status; how many is the feature."""
    own = rows.where(F.col("status") == status) if status else rows
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(top)


def health(tables: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(table_name, n, needed, healthy): counts of tables against the numbers they must have."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n", F.lit(least.get(name, 0)).cast("long").alias("needed")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("healthy", F.col("n") >= F.col("needed"))

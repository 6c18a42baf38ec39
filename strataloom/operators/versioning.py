"""Versions of items over an observation log: classification, SCD-2 chains, field diffs, absences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def observed(rows: DataFrame, key: list[str], order: list[str], payload: str) -> DataFrame:
    """Adds ``before`` (the payload seen last) and ``event``: added, updated or unchanged."""
    own = Window.partitionBy(*key).orderBy(*order)
    before, nth = F.lag(payload).over(own), F.row_number().over(own)
    event = F.when(nth == 1, "added").when(F.col(payload).eqNullSafe(before), "unchanged").otherwise("updated")
    return rows.withColumns({"before": before, "event": event})


def chain(rows: DataFrame, key: list[str], order: list[str], payload: str, at: str) -> DataFrame:
    """SCD-2: a version for each change of the payload, closed where the next begins."""
    kept = observed(rows, key, order, payload).where("event <> 'unchanged'")
    own = Window.partitionBy(*key).orderBy(*order)
    out = kept.withColumns({"version_no": F.row_number().over(own), "valid_from": F.col(at), "valid_to": F.lead(at).over(own)})
    return out.withColumn("is_current", F.col("valid_to").isNull())


def diff(rows: DataFrame, key: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """A row for each changed field of each observation after the first, with old and new value as text."""
    own = Window.partitionBy(*key).orderBy(*order)
    both = rows.withColumns({f"old_{f}": F.lag(f).over(own) for f in fields} | {"nth": F.row_number().over(own)}).where("nth > 1")
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").cast("string").alias("old"), F.col(f).cast("string").alias("new")) for f in fields])
    changed = F.filter(changes, lambda c: ~c.old.eqNullSafe(c.new))
    return both.select(*key, *order, F.explode(changed).alias("c")).select(*key, *order, "c.field", "c.old", "c.new")


def absences(sightings: DataFrame, runs: DataFrame, key: list[str], run: str, limit: int = 3, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, key, run) where an item is retired: missed in ``limit`` complete full runs in a row; once for each gap, as any sighting
    begins anew. ``sightings``: scope, key, run, also of runs that are not complete; ``runs``: scope and run of the complete full ones. A run
    misses an item if it begins after the item was last seen. Only runs of the item's own ``scope`` (its platform) count.

    Each run gets the number of complete ones of its scope up to it and before it, in a table of one row for each run. Between two sightings of an
    item lie as many misses as complete runs behind the first and before the second, so no item x run grid is built. A sighting in a run
    that is not complete, behind the last miss, comes too late: the item was retired by then, and is recovered."""
    if not scope:
        one = F.lit(0).alias("__scope")
        return absences(sightings.select("*", one), runs.select("*", one), key, run, limit, ("__scope",)).drop("__scope")
    every = runs.select(*scope, run, F.lit(1).alias("__whole")).union(sightings.select(*scope, run, F.lit(0))).groupBy(*scope, run).agg(F.max("__whole").alias("__whole"))
    numbered = every.withColumn("__n", F.sum("__whole").over(Window.partitionBy(*scope).orderBy(run)))
    numbered = numbered.withColumn("__before", F.col("__n") - F.col("__whole"))
    placed = sightings.select(*scope, *key, run).distinct().join(numbered.select(*scope, run, "__n", "__before"), [*scope, run])
    seen = placed.withColumn("__next", F.lead("__before").over(Window.partitionBy(*scope, *key).orderBy(run)))
    total = numbered.groupBy(*scope).agg(F.max("__n").alias("__last"))
    missed = F.coalesce(F.col("__next"), F.col("__last")) - F.col("__n")
    gone = seen.join(total, [*scope]).where(missed >= limit).select(*scope, *key, (F.col("__n") + limit).alias("__n"))
    return gone.join(numbered.where("__whole = 1").select(*scope, "__n", run), [*scope, "__n"]).select(*scope, *key, run)


def history(sightings: DataFrame, removals: DataFrame | None, key: list[str], order: list[str], payload: str) -> DataFrame:
    """The state of items over time: ``sightings`` (key, order, payload and more) and ``removals`` (key, order) as one log with ``event``
    (added, unchanged, updated, recovered, removed), ``before`` (the payload seen last), ``version_no`` and ``new_version``.

    A sighting after a removal is a recovery, whatever its payload; only a changed payload makes a version. A removal sorts
    behind sightings of the same place in the order."""
    rows = sightings.withColumn("removed", F.lit(False))
    if removals is not None:
        rows = rows.unionByName(removals.select(*key, *order).withColumn("removed", F.lit(True)), allowMissingColumns=True)
    own = Window.partitionBy(*key).orderBy(*order, "removed")
    past = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "__last": F.last(F.when(~F.col("removed"), F.struct(F.col(payload).alias("p"))), ignorenulls=True).over(past),
        "__gone": F.coalesce(F.lag("removed").over(own), F.lit(False)),
    })
    same = F.col("__last").isNotNull() & F.col(payload).eqNullSafe(F.col("__last.p"))
    event = F.when(F.col("removed"), "removed").when(F.col("__last").isNull(), "added").when(F.col("__gone"), "recovered").when(same, "unchanged").otherwise("updated")
    rows = rows.withColumns({"event": event, "before": F.col("__last.p"), "new_version": ~F.col("removed") & ~same})
    return rows.withColumn("version_no", F.sum(F.col("new_version").cast("int")).over(own).cast("int")).drop("__last", "__gone")


def intervals(states: DataFrame, key: list[str], order: list[str], at: str) -> DataFrame:
    """The versions in a history: valid_from, valid_to (where the next begins), is_current."""
    own = Window.partitionBy(*key).orderBy(*order)
    out = states.where("new_version").withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(own)})
    return out.withColumn("is_current", F.col("valid_to").isNull())


def change_events(states: DataFrame, key: list[str], order: list[str], fields: list[str] | None = None) -> DataFrame:
    """The change log of a history: all but unchanged sightings, each with its version and its ``payload``, JSON text: for a removal the
    reason, else {"diff": {field: {"old", "new"}}} with the ``fields`` that differ from the sighting before (of an item's first one: none).
    Values are text; removals carry no fields of their own, so a recovery is compared with the last sighting before the removal."""
    fields = fields or []
    own = Window.partitionBy(*key).orderBy(*order, F.col("event") == "removed").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event") != "removed", F.struct(F.lit(1).alias("seen"), *[F.col(f).cast("string").alias(f) for f in fields])), ignorenulls=True).over(own)
    rows = states.withColumn("__last", last)
    each = [F.struct(F.lit(f).alias("key"), F.struct(F.col(f"__last.{f}").alias("old"), F.col(f).cast("string").alias("new")).alias("value")) for f in sorted(fields)]
    changed = F.filter(F.array(*each), lambda c: ~c.value.old.eqNullSafe(c.value.new)) if each else F.array().cast("array<struct<key:string,value:struct<old:string,new:string>>>")
    diff = F.when(F.col("__last").isNull(), F.slice(changed, 1, 0)).otherwise(changed)
    told = F.to_json(F.struct(F.map_from_entries(diff).alias("diff")), {"ignoreNullFields": "false"})
    reason = F.to_json(F.struct(F.lit("missing from complete full scans").alias("reason")))
    payload = F.when(F.col("event") == "removed", reason).otherwise(told)
    return rows.where("event <> 'unchanged'").select(*key, *order, "event", "version_no", payload.alias("payload"))


def semantic_hash(items: DataFrame, fields: list[str], dims: str = "dimensions") -> Column:
    """Hash of an item's fields and of its (type, value, raw) dimensions in any order: canonical JSON with keys in order."""
    rest = F.array_sort(F.transform(dims, lambda d: F.struct(d.type.alias("type"), d.value.alias("value"), d.raw.alias("raw"))))
    columns = sorted([*((f, F.col(f)) for f in fields), (dims, F.transform(rest, lambda d: F.array(d.type, d.value, d.raw)))], key=lambda c: c[0])
    columns = [(n, F.map_from_entries(F.array_sort(F.map_entries(c))) if n in items.columns and items.schema[n].dataType.typeName() == "map" else c) for n, c in columns]
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in columns]), {"ignoreNullFields": "false"}), 256)


def fold_raw(c: Column) -> Column:
    """Raw values as mappings compare them: case and white space do not matter."""
    return F.lower(T.normalize_text(F.coalesce(c, F.lit(""))))


def apply_mappings(dims: DataFrame, rules: DataFrame, nth: str | None = None) -> DataFrame:
    """Dimension rows (type, raw, value, confidence, method) under the enabled rules (type, raw, mapped, sure, enabled); case and
    white space of raw values do not matter. Of several rules for one value the last counts: the one with the largest ``nth``, a column of
    ``rules``, else the largest mapped value. To be applied before hashing. Spark broadcasts the rules if their size allows."""
    last = F.max_by(F.struct("mapped", "sure"), F.struct(nth, "mapped") if nth else F.struct("mapped", "sure"))
    own = rules.where("enabled").groupBy("type", fold_raw(F.col("raw")).alias("__raw")).agg(last.alias("__rule")).select("type", "__raw", "__rule.mapped", "__rule.sure")
    rows = dims.withColumn("__raw", fold_raw(F.col("raw"))).join(own, ["type", "__raw"], "left")
    hit = F.col("mapped").isNotNull()
    changed = {"value": F.coalesce("mapped", "value"), "confidence": F.coalesce("sure", "confidence"), "method": F.when(hit, "taxonomy_mapping").otherwise(F.col("method"))}
    return rows.withColumns(changed).drop("__raw", "mapped", "sure")


def mapped_types(items: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """``items`` (key, product_type) with the type that a mapping gave to the item's product_type dimension in ``mapped`` (key and what
    ``apply_mappings`` returns), so that item and dimension agree before they are hashed."""
    own = mapped.where("type = 'product_type' and method = 'taxonomy_mapping'").groupBy(key).agg(F.max("value").alias("__mapped"))
    return items.join(own.hint("merge"), key, "left").withColumn("product_type", F.coalesce("__mapped", "product_type")).drop("__mapped")


def evidence_rows(versions: DataFrame, fields: DataFrame, key: list[str]) -> DataFrame:
    """(key, version_no, field, raw, locator, method, confidence, snapshot): what the fields of each version rest on. ``key`` tells a version
    apart in both tables (item and version number, or item and content hash); ``fields`` (key, field, value, locator, method, confidence)
    keep how the extraction found them; ``snapshot`` is that of the version. Blank values rest on nothing."""
    own = versions.select(*dict.fromkeys([*key, "version_no", "snapshot"]))
    rows = own.join(fields.where("value is not null and value <> ''").hint("merge"), key)
    return rows.select(*key, *([] if "version_no" in key else ["version_no"]), "field", T.snippet(F.col("value"), 2000).alias("raw"), "locator", "method", "confidence", "snapshot")


def link_entities(items: DataFrame, entities: DataFrame, links: DataFrame) -> DataFrame:
    """New links (item, entity, method, confidence) of items (item, kind, name, provider) that ``links`` (item) does not have: to the known
    entity (entity, kind, name, provider) of the same kind and folded name and provider, else to one that the smallest such item
    founds. A blank provider links with nothing."""
    fold = lambda c: F.lower(T.normalize_text(F.coalesce(F.col(c), F.lit(""))))
    key = ["kind", "__name", "__provider"]
    named = lambda df: df.withColumns({"__name": fold("name"), "__provider": fold("provider")})
    fresh = named(items).join(links.select("item").hint("merge"), "item", "left_anti")
    alone = fresh.where("__provider = ''").select("item", F.col("item").alias("entity"), F.lit(True).alias("founder"))
    rows = fresh.where("__provider <> ''")
    known = named(entities).where("__provider <> ''").groupBy(*key).agg(F.min("entity").alias("known"))
    heads = rows.groupBy(*key).agg(F.min("item").alias("head")).join(known.hint("merge"), key, "left")
    rows = rows.join(heads.hint("merge"), key).select("item", F.coalesce("known", "head").alias("entity"), (F.col("known").isNull() & (F.col("item") == F.col("head"))).alias("founder"))
    out = rows.unionByName(alone)
    return out.select("item", "entity", F.when(F.col("founder"), "new_entity").otherwise("exact_name_provider").alias("method"), F.when(F.col("founder"), 1.0).otherwise(0.995).alias("confidence"))


def merge_states(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """URL states (url, collection, anchor, depth, role, first_seen, last_seen, active) after sightings (url, collection, anchor, depth, role, at, nth):
    depth is the least, collection and anchor are filled if empty, a role only from unknown; what was seen is active."""
    first = lambda c, good: F.min_by(c, F.when(good, F.struct("at", "nth")))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    new = seen.groupBy("url").agg(
        first("collection", F.col("collection").isNotNull()).alias("n_collection"), first("anchor", some("anchor")).alias("n_anchor"), F.min("depth").alias("n_depth"),
        first("role", F.col("role") != "unknown").alias("n_role"), F.min("at").alias("n_first"), F.max("at").alias("n_last"),
    )
    rows = stored.hint("merge").join(new, "url", "full")
    return rows.select(
        "url",
        F.coalesce("collection", "n_collection").alias("collection"),
        F.coalesce(F.nullif("anchor", F.lit("")), "n_anchor", F.lit("")).alias("anchor"),
        F.least("depth", "n_depth").alias("depth"),
        F.coalesce(F.nullif("role", F.lit("unknown")), "n_role", F.lit("unknown")).alias("role"),
        F.coalesce("first_seen", "n_first").alias("first_seen"),
        F.greatest("last_seen", "n_last").alias("last_seen"),
        (F.col("n_last").isNotNull() | F.coalesce("active", F.lit(False))).alias("active"),
    )


def not_modified(states: DataFrame, responses: DataFrame) -> DataFrame:
    """States (url, http_status, last_fetched, errors, etag) after 304 answers (url, at, new_etag): fetched, without errors, no snapshot. An answer
    without a tag leaves the old one; of tags that came at one time the largest counts."""
    last = responses.groupBy("url").agg(F.max("at").alias("at"), F.max_by("new_etag", F.when(F.col("new_etag").isNotNull(), F.struct("at", "new_etag"))).alias("new_etag"))
    rows = states.hint("merge").join(last, "url", "left")
    hit = F.col("at").isNotNull()
    return rows.select("url", F.when(hit, 304).otherwise(F.col("http_status")).alias("http_status"), F.coalesce("at", "last_fetched").alias("last_fetched"), F.when(hit, 0).otherwise(F.col("errors")).alias("errors"), F.coalesce("new_etag", "etag").alias("etag"))


def review_rows(items: DataFrame, threshold: float = 0.80, automatic: bool = False) -> DataFrame:
    """Reviews of items (item, product_type, type_confidence, confidence) whose type, or else whole, is too uncertain."""
    sure = F.coalesce("type_confidence", "confidence")
    rows = items.where(sure < threshold).select("item", F.lit("product_type").alias("field"), F.col("product_type").alias("proposed"), sure.alias("confidence"))
    return rows.withColumns({"status": F.lit("accepted" if automatic else "pending"), "reviewer": F.lit("automatic_classifier" if automatic else "")})


def resolve_pending(reviews: DataFrame, reviewer: str) -> DataFrame:
    """All pending reviews accepted; ``resolved`` marks them."""
    pending = F.col("status") == "pending"
    return reviews.withColumns({"resolved": pending, "reviewer": F.when(pending, reviewer).otherwise(F.col("reviewer")), "status": F.when(pending, "accepted").otherwise(F.col("status"))})


def apply_decisions(versions: DataFrame, dims: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions (item, product_type) and dimension rows (item, type, value, confidence, method) under decisions (item, status, value, at): the value
    accepted last (ties: the largest) overwrites both, with confidence 1; without a value only the status counts."""
    chosen = decisions.where("status = 'accepted' and value is not null and value <> ''").groupBy("item").agg(F.max_by("value", F.struct("at", "value")).alias("decided"))
    out = versions.hint("merge").join(chosen, "item", "left").withColumn("product_type", F.coalesce("decided", "product_type")).drop("decided")
    rows = dims.hint("merge").join(chosen, "item", "left")
    hit = F.col("decided").isNotNull() & (F.col("type") == "product_type")
    changed = {"value": F.when(hit, F.col("decided")).otherwise(F.col("value")), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence")), "method": F.when(hit, "manual_review").otherwise(F.col("method"))}
    return out, rows.withColumns(changed).drop("decided")


def new_snapshots(fetched: DataFrame, stored: DataFrame, states: DataFrame, keep_days: int) -> DataFrame:
    """Snapshots to be written: the first of each (url, content_hash) in ``fetched`` (url, at, content_hash, semantic_hash, platform, run) that is
    not in ``stored`` (url, content_hash). ``changed``: raw or semantic hash differ from the state before (``states``: url, content_hash,
    semantic_hash), a revert included. Bodies take no part: they are joined by hash when they are written."""
    own = Window.partitionBy("url").orderBy("at", "content_hash")
    old = states.select("url", F.col("content_hash").alias("c0"), F.col("semantic_hash").alias("s0"))
    rows = fetched.hint("merge").join(old, "url", "left")
    raw, meaning = F.coalesce(F.lag("content_hash").over(own), "c0"), F.coalesce(F.lag("semantic_hash").over(own), "s0")
    rows = rows.withColumn("changed", ~(F.col("content_hash").eqNullSafe(raw) & F.col("semantic_hash").eqNullSafe(meaning)))
    nth = F.row_number().over(Window.partitionBy("url", "content_hash").orderBy("at"))
    rows = rows.withColumn("nth", nth).where("nth = 1").drop("nth", "c0", "s0").join(stored.select("url", "content_hash").hint("merge"), ["url", "content_hash"], "left_anti")
    name = F.concat_ws("-", F.substring(F.sha2("url", 256), 1, 16), F.substring("content_hash", 1, 16))
    return rows.withColumns({"expires_at": F.col("at") + F.make_dt_interval(F.lit(keep_days)), "object_key": F.concat_ws("/", F.lit("platform"), "platform", F.date_format("at", "yyyy/MM/dd"), "run", name)})


def archived(snapshots: DataFrame, now: Column, limit: int) -> DataFrame:
    """Of snapshots (id, expires_at, tier, stored_hash, body_hash) the ``limit`` that expired first, with ``outcome``: archived if the body still has the
    hash it was stored with, else failed, which is an alert and leaves the tier."""
    due = snapshots.where((F.col("tier") != "archive") & (F.col("expires_at") <= now)).orderBy("expires_at", "id").limit(limit)
    fine = F.col("stored_hash").eqNullSafe(F.col("body_hash"))
    return due.withColumns({"outcome": F.when(fine, "archived").otherwise("failed"), "tier": F.when(fine, "archive").otherwise(F.col("tier")), "alert": F.when(~fine, "snapshot_archive_failure")})


def merge_links(known: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (from_url, to_url, anchor, relevance, first_seen, last_seen) after a batch (from_url, to_url, place, anchor, relevance, at): the first
    occurrence of a target counts (of two pages of one URL with it at one place: the smaller anchor, then relevance); a known edge takes the new relevance and
    a new anchor that is not empty."""
    nth = F.row_number().over(Window.partitionBy("from_url", "to_url").orderBy("place", "anchor", "relevance"))
    new = found.withColumn("nth", nth).where("nth = 1").select("from_url", "to_url", F.col("anchor").alias("n_anchor"), F.col("relevance").alias("n_relevance"), "at")
    rows = known.hint("merge").join(new, ["from_url", "to_url"], "full")
    return rows.select("from_url", "to_url", F.coalesce(F.nullif("n_anchor", F.lit("")), "anchor", F.lit("")).alias("anchor"), F.coalesce("n_relevance", "relevance").alias("relevance"), F.coalesce("first_seen", "at").alias("first_seen"), F.coalesce("at", "last_seen").alias("last_seen"))


def as_of(versions: DataFrame, at) -> DataFrame:
    """The versions that hold at a time."""
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.lit(at) < F.col("valid_to"))))


def as_of_each(instants: DataFrame, versions: DataFrame, key: list[str], at: str, since: str, order: list[str], fields: list[str], bucket: str | None = None) -> DataFrame:
    """``instants`` (key, at, ...) each with the ``fields`` of the version of its key that held then: the last with ``since`` <= ``at`` by (since, order); null
    before the first. An as-of join as one union, sorted by key and time, in which a row takes the last version before it: one shuffle, and no
    join that compares each instant with each version.

    A key with a large share of all rows is one sort in one task; ``bucket`` (a unit of date_trunc, such as "month") splits keys by
    time, and what held at a bucket's begin comes from a table of one row for each key and bucket. Instants of null time or key get nulls."""
    taken, name = F.struct(*fields), [f"__o{k}" for k in range(len(order))]
    old = versions.where(F.col(since).isNotNull()).select(*key, F.col(since).cast("timestamp").alias("__at"), F.lit(0).alias("__kind"), *[F.col(o).alias(n) for o, n in zip(order, name, strict=True)], taken.alias("__version"))
    new = instants.select(*key, F.col(at).cast("timestamp").alias("__at"), F.lit(1).alias("__kind"), F.struct(*[F.col(c) for c in instants.columns]).alias("__row"))
    rows = old.unionByName(new, allowMissingColumns=True)
    part = [*key]
    if bucket:
        rows, part = rows.withColumn("__bucket", F.date_trunc(bucket, "__at")), [*key, "__bucket"]
    own = Window.partitionBy(*part).orderBy("__at", "__kind", *name)
    held = rows.withColumn("__held", F.last("__version", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    if bucket:
        last = rows.groupBy(*part).agg(F.max_by("__version", F.when(F.col("__kind") == 0, F.struct("__at", *name))).alias("__last"))
        before = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = last.withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).where("__carried is not null").select(*part, "__carried")
        held = held.join(carried.hint("merge"), part, "left").withColumn("__held", F.coalesce("__held", "__carried"))
    known = F.col("__at").isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    return held.where("__kind = 1").select("__row.*", *[F.when(known, F.col(f"__held.{f}")).alias(f) for f in fields])


def unchanged_runs(rows: DataFrame, key: list[str], page: str, changed: str, length: int) -> DataFrame:
    """The first page that ends ``length`` consecutive pages without a change."""
    own = Window.partitionBy(*key).orderBy(page)
    group = F.sum(F.col(changed).cast("int")).over(own)
    run = rows.withColumn("island", group)
    nth = F.row_number().over(Window.partitionBy(*key, "island").orderBy(page)) - F.when(F.col("island") > 0, 1).otherwise(0)
    return run.withColumn("nth", nth).where(f"nth >= {length}").groupBy(*key).agg(F.min(page).alias("stop_page"))

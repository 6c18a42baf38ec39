"""Which URLs come next: best-first choice, due URLs, resumed pages, ends of paging, outcomes, known links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url as U

# Results depend on them.
BLOCKED = (401, 403, 418, 451)
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def best_first(links: DataFrame, visited: DataFrame, budget: int) -> DataFrame:
    """(host, to_url, score, rank, hit_limit): of links (to_url, score, seq) the ``budget`` best of each host that are not in ``visited``
    (url); a target counts once, with its best score and first discovery. hit_limit: the host has more."""
    fresh = links.groupBy("to_url").agg(F.max("score").alias("score"), F.min("seq").alias("seq")).join(visited.select(F.col("url").alias("to_url")).hint("merge"), "to_url", "left_anti")
    fresh = fresh.withColumn("host", U.host(F.col("to_url")))
    ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "seq"))).where(F.col("rank") <= budget + 1)
    more = F.max("rank").over(Window.partitionBy("host")) > budget  # at most budget + 1 rows of each host are left
    return ranked.withColumn("hit_limit", more).where(F.col("rank") <= budget).drop("seq")


def due(states: DataFrame, now: Column, limit: int) -> DataFrame:
    """Active URLs that were never scheduled or are due, earliest first."""
    return states.where(F.col("active") & (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now))).orderBy(F.asc_nulls_first("next_fetch_at"), "url").limit(limit)


def resume_page(states: DataFrame, marker: str = "_page") -> DataFrame:
    """(collection, resume_at): one more than the highest page that was fetched well, for each collection of ``states`` (collection, url,
    role, http_status); 1 if none was."""
    fine = (F.col("role") == "api") & F.col("http_status").between(200, 299)
    return states.groupBy("collection").agg((F.coalesce(F.max(F.when(fine, U.page_number(F.col("url"), marker))), F.lit(0)) + 1).alias("resume_at"))


def paging_end(pages: DataFrame, key: str, size: int, total: Column, count: Column) -> DataFrame:
    """(key, end_page, reason): where paging stops, of pages (key, page_no, n). The first of: empty page, all records of the stated
    total seen, stated page count reached, short page. Null totals and counts are not stated."""
    rows = pages.withColumns({"total": total, "pages": count}).withColumn("seen", F.sum("n").over(Window.partitionBy(key).orderBy("page_no")))
    reason = F.when(F.col("n") == 0, "empty_page").when(F.col("seen") >= F.col("total"), "total_reached").when(F.col("page_no") + 1 >= F.col("pages"), "page_count_reached").when(F.col("n") < size, "short_page")
    return rows.withColumn("reason", reason).where("reason is not null").groupBy(key).agg(F.min("page_no").alias("end_page"), F.min_by("reason", "page_no").alias("reason"))


def outcome(code: Column, role: Column, is_json: Column, business_ok: Column, has_records: Column) -> Column:
    """(outcome, retryable, blocked) of a response; the last three arguments are null where they do not apply."""
    no = ~F.coalesce(business_ok, F.lit(True))
    value = (
        F.when(code == 304, "not_modified")
        .when((role == "sitemap") & code.isin(404, 410), "ignored")
        .when(code >= 400, "http_status")
        .when(~F.coalesce(is_json, F.lit(True)), "not_json")
        .when(no, "business_status")
        .when(~F.coalesce(has_records, F.lit(True)), "schema")
        .otherwise("ok")
    )
    return F.struct(value.alias("outcome"), ((value == "http_status") & code.isin(*RETRYABLE)).alias("retryable"), ((value == "http_status") & code.isin(*BLOCKED) | value.isin("business_status", "schema")).alias("blocked"))


def without_covered(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links (adapter, to_url) that no rule (adapter, pattern) of their adapter covers."""
    own = rules.select(F.col("adapter").alias("__adapter"), F.col("pattern").alias("__pattern")).distinct()
    covered = (F.col("adapter") == F.col("__adapter")) & F.contains(F.lower("to_url"), F.col("__pattern"))
    return links.join(own, covered, "left_anti")


def stored_links(unchanged: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, to_url): active stored edges (from_url, to_url, active) of pages (page_id, url) that did not change."""
    out = edges.where("active").select("from_url", "to_url").distinct()
    return unchanged.hint("merge").join(out, F.col("url") == F.col("from_url")).select("page_id", "to_url").distinct()

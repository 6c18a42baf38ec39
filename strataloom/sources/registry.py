"""Registries, site rules and sitemaps as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import url as U
from ..functions.steps import settled

FIELDS = ("province", "city", "name", "operator", "source_url", "canonical_url", "url_status", "render_mode", "adapter", "notes")
RULE = "struct<adapter:string,render_mode:string,collections:array<struct<code:string,name:string,object_kind:string,entry_url:string,enabled:boolean,pagination_mode:string>>>"


def flag(value: Column, default: Column) -> Column:
    """1, true, yes, y and on are true, blank is the default, all else false."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(F.coalesce(value.cast("string"), F.lit("")) == "", default).otherwise(low.isin("1", "true", "yes", "y", "on"))


def registry(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Platforms of a CSV file (with or without byte order mark) or a JSON one (a list, or a list under ``platforms``): id, the fields that the file has as
    trimmed text, enabled. A source is enabled by default if it has a canonical URL."""
    if fmt == "csv":
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    else:
        text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
        kind = "map<string,string>"
        either = F.coalesce(F.from_json("value", f"array<{kind}>"), F.from_json("value", f"struct<platforms:array<{kind}>>").platforms)
        each = text.select(F.explode(F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{kind}>")).otherwise(either)).alias("row"))
        rows = each.select(*[F.col("row")[c].alias(c) for c in ("id", "enabled", *FIELDS)])
    own = [c for c in FIELDS if c in rows.columns]
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    known = blank("canonical_url") != "" if "canonical_url" in own else F.lit(False)
    enabled = flag(F.col("enabled"), known) if "enabled" in rows.columns else known
    return rows.select(F.col("id").cast("long").alias("id"), *[blank(c).alias(c) for c in own], enabled.alias("enabled"))


def site_rules(spark: SparkSession, path: str) -> DataFrame:
    """(platform, adapter, render_mode, collections) of a JSON file that maps platform ids to rules."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{RULE}>")).alias("id", "rule")).select(F.col("id").cast("long").alias("platform"), "rule.*")


def apply_site_rules(platforms: DataFrame, collections: DataFrame, rules: DataFrame, automatic: str = "public-catalog-auto") -> tuple[DataFrame, DataFrame]:
    """Platforms (platform, adapter, render_mode) under the rules, and collections (platform, code, name, kind, entry_url, enabled, coverage): those of the rules are
    added or replaced, the automatic one of a ruled platform is disabled. Rules come out of exploded JSON, so their joins are merge joins."""
    own = rules.select("platform", F.col("adapter").alias("__adapter"), F.col("render_mode").alias("__mode"))
    ruled = platforms.join(own.hint("merge"), "platform", "left")
    set_ = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    ruled = ruled.withColumns({"adapter": set_("__adapter", "adapter"), "render_mode": set_("__mode", "render_mode")}).drop("__adapter", "__mode")
    given = rules.join(platforms.select("platform").hint("merge"), "platform", "left_semi").select("platform", F.explode("collections").alias("c"))
    given = given.select("platform", "c.code", "c.name", F.col("c.object_kind").alias("kind"), "c.entry_url", F.coalesce("c.enabled", F.lit(True)).alias("enabled"), F.lit("unknown").alias("coverage"))
    old = collections.join(given.select("platform", "code").distinct().hint("merge"), ["platform", "code"], "left_anti")
    off = (F.col("code") == automatic) & F.col("__ruled").isNotNull()
    old = old.join(rules.select("platform", F.lit(True).alias("__ruled")).hint("merge"), "platform", "left")
    old = old.withColumns({"enabled": F.col("enabled") & ~F.coalesce(off, F.lit(False)), "coverage": F.when(off, "out_of_scope").otherwise(F.col("coverage"))}).drop("__ruled")
    return ruled, old.unionByName(given)


def sitemap_links(pages: DataFrame, key: str, column: str = "body") -> DataFrame:
    """(key, place, to_url, relevance): the addresses in sitemaps; each is worth 2.0 at least."""
    found = pages.select(key, "url", F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<(?:\w+:)?loc\b[^>]*>(.*?)</(?:\w+:)?loc>"), 1)).alias("place", "loc"))
    found = settled(found, {"to": U.resolved(F.col("url"), F.trim(T.unescaped(F.col("loc"))))}).select(key, "place", "to")
    found = settled(found, {"to_url": U.canonical_url(F.col("to"))}).drop("to").where("to_url <> ''")
    return found.withColumn("relevance", F.greatest(F.lit(2.0), U.link_relevance(F.col("to_url"), F.lit("sitemap"))))


def snapshots(online: DataFrame, archive: DataFrame, ids: DataFrame) -> DataFrame:
    """Snapshots (id and more) of the wanted ids from the online tier or else the archive."""
    rows = online.withColumn("tier", F.lit("online")).unionByName(archive.withColumn("tier", F.lit("archive")))
    wanted = rows.join(ids.select("id").distinct().hint("merge"), "id", "left_semi")
    best = wanted.groupBy("id").agg(F.max("tier").alias("tier"))  # 'online' sorts last
    return wanted.join(best.hint("merge"), ["id", "tier"])

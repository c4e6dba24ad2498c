"""Analyst annotations, keyed by the content hash of the event they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainspan.functions.text import normalize_tags, trimmed
from chainspan.operators.query import finding_keys, keys_with_tag

FINDING_SCHEMA = (
    "key string, flagged boolean, tags array<string>, note string, descriptor string, created_ns bigint, updated_ns bigint"
)

__all__ = [
    "annotation_hashes",
    "audit_findings",
    "finding_keys",
    "finding_stats",
    "keys_with_tag",
    "list_findings",
    "tag_counts",
    "upsert_findings",
]


def upsert_findings(old: DataFrame, new: DataFrame, now_ns: int) -> tuple[DataFrame, DataFrame]:
    """Apply ``new(key, flagged, tags, note, descriptor)``, one row per key; returns (findings, rejected).

    The creation time of a known finding stays, and its descriptor too when the new one is blank. A finding without
    flag, tags and note is deleted. A blank key is rejected.
    """
    key = trimmed(F.coalesce("key", F.lit("")))
    checked = new.withColumn("reason", F.when(key == "", "no key"))
    change = checked.filter(F.col("reason").isNull()).select(
        key.alias("key"),
        F.coalesce("flagged", F.lit(False)).alias("n_flagged"),
        normalize_tags(F.coalesce("tags", F.array().cast("array<string>"))).alias("n_tags"),
        trimmed(F.coalesce("note", F.lit(""))).alias("n_note"),
        trimmed(F.coalesce("descriptor", F.lit(""))).alias("n_descriptor"),
        F.lit(True).alias("changed"),
    )
    both = old.join(change, "key", "full_outer")
    changed = F.coalesce(F.col("changed"), F.lit(False))
    pick = lambda c: F.when(changed, F.col("n_" + c)).otherwise(F.col(c)).alias(c)
    out = both.select(
        "key",
        pick("flagged"),
        pick("tags"),
        pick("note"),
        F.when(changed & (F.col("n_descriptor") != ""), F.col("n_descriptor"))
        .otherwise(F.coalesce("descriptor", F.lit("")))
        .alias("descriptor"),
        F.coalesce("created_ns", F.lit(now_ns)).alias("created_ns"),
        F.when(changed, F.lit(now_ns)).otherwise(F.col("updated_ns")).alias("updated_ns"),
        changed.alias("_changed"),
    )
    empty = ~F.col("flagged") & (F.size("tags") == 0) & (F.coalesce("note", F.lit("")) == "")
    kept = out.filter(~(F.col("_changed") & empty)).drop("_changed")
    return kept, checked.filter(F.col("reason").isNotNull()).select("key", "reason")


def tag_counts(findings: DataFrame) -> DataFrame:
    return (
        findings.select(F.explode("tags").alias("tag"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "tag")
    )


def finding_stats(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(F.coalesce(F.col("note"), F.lit("")) != "").alias("noted"),
        F.count_if(F.size("tags") > 0).alias("tagged"),
    )


def list_findings(findings: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Newest change first, key on ties; or just the findings of ``keys``."""
    if keys is not None:
        findings = findings.join(keys.select("key").distinct(), "key", "left_semi")
    return findings.orderBy(F.col("updated_ns").desc(), "key")


def audit_findings(findings: DataFrame, events: DataFrame, written_version: int, recipe_version: int) -> DataFrame:
    """(key, problem): every key as ``stale`` when the hashes follow another recipe, else the keys without an event."""
    if written_version != recipe_version:
        return findings.select("key", F.lit("stale").alias("problem"))
    live = events.select(F.col("hash_normalized").alias("key"))
    return findings.select("key").join(live, "key", "left_anti").select("key", F.lit("orphan").alias("problem"))


def annotation_hashes(items: DataFrame) -> DataFrame:
    """Distinct event hashes notes are anchored to: ``items(anchors array<struct<kind, hash>>)``."""
    a = items.select(F.explode("anchors").alias("a"))
    return a.filter((F.col("a.kind") == "event") & (F.coalesce("a.hash", F.lit("")) != "")).select(F.col("a.hash").alias("key")).distinct()

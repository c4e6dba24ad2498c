"""Correlation slots: ten comparable values projected from an event's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainspan import model
from chainspan.functions.text import bound, slot_value, trimmed


def folded_fields(fields: Column) -> Column:
    """Field names trimmed and lower-cased; of names that differ only in case the smallest wins."""
    entries = F.sort_array(
        F.transform(
            F.map_entries(fields),
            lambda e: F.struct(F.lower(trimmed(e["key"])).alias("name"), e["key"].alias("key"), e["value"].alias("value")),
        )
    )

    def first(sorted_entries: Column) -> Column:
        kept = F.filter(
            sorted_entries,
            lambda e, i: (e["name"] != "") & ((i == 0) | (F.get(sorted_entries, i - 1)["name"] != e["name"])),
        )
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["name"], e["value"])))

    return bound(entries, first)


def slot_columns(folded: Column) -> dict[str, Column]:
    out = {}
    for slot, (kind, sources) in model.SLOT_RECIPE.items():
        names = list(dict.fromkeys(s.lower() for s in sources))
        values = [slot_value(F.try_element_at(folded, F.lit(n)), kind) for n in names]
        out[slot] = F.coalesce(*values)
    return out


def extract_slots(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Add the ten slot columns (NULL = absent) and ``corr_version``.

    The folded map is built once per row in its own projection; the slots are then plain map lookups.
    """
    folded = df.withColumn("_folded", folded_fields(F.col(fields)))
    return (
        folded.withColumns(slot_columns(F.col("_folded")))
        .withColumn("corr_version", F.lit(model.SLOT_VERSION))
        .drop("_folded")
    )


def is_current() -> Column:
    return F.coalesce(F.col("corr_version"), F.lit(0)) == model.SLOT_VERSION


def projection_status(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_current()).alias("current"),
        F.count_if(~is_current()).alias("stale"),
    )


def backfill_slots(df: DataFrame, payload: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recompute the slots of rows with an old projection from ``payload(id, fields)``.

    Current rows go through untouched; only stale ones are joined. A row without a readable payload stays stale.
    Returns the whole table and one row (updated, unreadable).
    """
    current = df.filter(is_current())
    stale = df.filter(~is_current())
    joined = stale.drop(*model.SLOTS).join(payload.select("id", F.col("fields").alias("_fields")), "id", "left")
    fresh = extract_slots(joined.filter(F.col("_fields").isNotNull()), "_fields").select(*df.columns)
    kept = stale.join(payload.filter(F.col("fields").isNotNull()).select("id"), "id", "left_anti").select(*df.columns)
    report = joined.agg(
        F.count("_fields").alias("updated"), F.count_if(F.col("_fields").isNull()).alias("unreadable")
    )
    return current.unionByName(fresh).unionByName(kept), report


def slot_coverage(df: DataFrame) -> DataFrame:
    """(slot, events): how many events carry each slot; one pass, ten counters."""
    counts = df.agg(*[F.count(s).alias(s) for s in model.SLOTS])
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("events")) for s in model.SLOTS])
    return counts.select(F.inline(pairs))
